"""From documents to a training mix: language, near duplicates, benchmark passages, personal data, weights.

Each stage takes all its predecessor kept and returns the columns of its input, the last one the mix.
Decisions are made on a key of a row's ``doc_id`` and text (for languages also what is declared), so that rows
that share a ``doc_id`` but not the text are judged one by one. Near duplicates need an order: there the key is
``doc_id``, or for rows without one, and where one has several texts, a negative hash. Stages are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscan.llm import decontaminate, language, minhash, mixing, pii
from shelfscan.llm.common import salted_lookup, staged, table

KEY = "coalesce(CAST(doc_id AS bigint), -2 - (xxhash64(text) & 9223372036854775807L) DIV 2)"
#: For rows whose ``doc_id`` has several texts.
VERSION = "-2 - (xxhash64(doc_id, text) & 9223372036854775807L) DIV 2"


def _marked(docs: DataFrame) -> DataFrame:
    """``docs`` with the key ``___key``: one per document, and per text where a ``doc_id`` has several."""
    texts = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.expr("min(xxhash64(text)) < max(xxhash64(text)) AS ___many"))
    several = staged(texts.filter("___many"), "repeated-ids")
    if several.isEmpty():
        return docs.withColumn("___key", F.expr(KEY))
    return salted_lookup(docs, several, ["doc_id"]).withColumn("___key", F.expr(f"if(___many, {VERSION}, {KEY})")).drop("___many")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` with ``___key`` less the rows whose key is in ``keys`` (``doc_id``)."""
    gone = keys.select(F.col("doc_id").alias("___gone")).distinct()
    return docs.join(gone, F.col("___key") == F.col("___gone"), "left_anti")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language (operator 10). The text, its declared language and its source are judged."""
    marked = docs.withColumn("___key", F.expr("xxhash64(doc_id, text, lang, source)"))
    found = language.language_id(marked.withColumn("doc_id", F.col("___key")))
    return _without(marked, found.filter("rejected")).drop("___key")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest key (operator 7): five words, 0.8."""
    marked = _marked(docs)
    found = minhash.near_duplicates(marked.selectExpr("___key AS doc_id", "text"), shingle=5, percent=80)
    kept = _without(marked, found.filter("NOT kept"))
    twice = staged(marked.groupBy(F.col("___key").alias("doc_id")).count().filter("count > 1").select("doc_id"), "repeated-keys")
    if twice.isEmpty():
        return kept.drop("___key")
    repeated = kept.join(twice.withColumnRenamed("doc_id", "___twice"), F.col("___key") == F.col("___twice"), "left_semi")
    return _without(kept, twice).unionByName(repeated.dropDuplicates(["___key"])).drop("___key")


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word run of a benchmark item (operator 9)."""
    marked = docs.withColumn("___key", F.expr("xxhash64(doc_id, text)"))
    found = decontaminate.find_hits(marked.selectExpr("___key AS doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return _without(marked, found.filter("size(hits) > 0")).drop("___key")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind (operator 6); ``n_chars`` follows."""
    weights = pii.train(docs)
    spans = pii.spans_of("text", weights)
    text = F.expr(f"if(text IS NULL, NULL, {pii.redacted('text', '__spans')})")
    new = docs.withColumn("text", F.col("text").cast("string")).withColumn("__spans", F.expr(spans)).withColumn("text", text).drop("__spans")
    return new.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else new


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents with their full epochs and the tokens of one more (operator 5)."""
    return mixing.mix(docs)


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_benchmark_passages),
    ("personal_data", redact_personal_data),
    ("mixing", mix_to_weights),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs


#: Language models and signatures are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None
