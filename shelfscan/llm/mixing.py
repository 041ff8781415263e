"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain, language, source; its leaves hold documents, and nodes of every level have weights. A
node's budget is shared out to its children by weight; a child that cannot use its share (its tokens times the
allowed epochs) takes what it can, and what it leaves goes to its siblings, by weight again. So a shortage
reaches an ancestor's other children only when a whole branch is exhausted. All of it is exact whole-number
arithmetic on the table of nodes, which has a row per source, not per document. Tokens that do not divide go
one each to the largest remainders (ties: larger weight, then ``md5(name)``), so budgets sum to the whole.

Children are ordered by what they can take for their weight. The sums over that order run over distinct
ratios in blocks of their leading digits, so a node with very many children is dealt to many tasks. Children
of equal weight have equal remainders, so the rest is given to classes of weights first.

A leaf reads its documents in seeded epochs: full epochs as often as its budget covers, then the prefix
of one more epoch in the order of ``md5(seed:epoch:doc_id)`` (without ``doc_id``: of the text's hash), up to the
last token. The running sum over a leaf works in ``4096`` blocks of that order, so a leaf with a third of all
rows is dealt to as many tasks.

Everything is DataFrame or SQL. Null or empty texts have no tokens and are not selected; null language
or source is the node ``unknown``, a null domain ``other``; nodes without a weight get ``OTHER``, and those of a weight
below 1 are left out with all below them; rows with equal keys are ordered by ``doc_id``, tokens and text, so
repeated rows are interchangeable. Only the named columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfscan.llm.common import salted_lookup, staged

#: The recipe of the registered query. Weights are whole numbers up to a million; unnamed nodes have ``OTHER``.
WEIGHTS = (
    ("domain", "web", 50), ("domain", "books", 30), ("domain", "code", 15), ("domain", "other", 5),
    ("lang", "en", 40), ("lang", "de", 20), ("lang", "fr", 20), ("lang", "es", 20),
    ("source", "src0", 30), ("source", "src8", 15), ("source", "src13", 20),
)
OTHER = 10
DOMAINS = {"web": ("src0", "src1", "src2", "src3", "src4", "src5", "src6", "src7"), "books": ("src8", "src9", "src10", "src11", "src12"), "code": ("src13", "src14", "src15", "src16")}
#: Domain of a document by its source; give another expression (such as a column) where a table names its domains.
DOMAIN = "CASE " + " ".join("WHEN source IN ({}) THEN '{}'".format(", ".join(f"'{s}'" for s in sources), domain) for domain, sources in DOMAINS.items()) + " ELSE 'other' END"
TREE = ("domain", "lang", "source")


def measured(docs: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """Narrow table of ``docs`` (``doc_id``, ``text``, ``lang``, ``source``): its leaf and its tokens (runs between white space)."""
    return docs.selectExpr(
        "doc_id",
        f"coalesce(CAST({domain} AS string), 'other') AS domain",
        "coalesce(CAST(lang AS string), 'unknown') AS lang",
        "coalesce(CAST(source AS string), 'unknown') AS source",
        r"CAST(regexp_count(coalesce(CAST(text AS string), ''), '[^\\x20\\x09-\\x0D]+') AS bigint) AS tokens",
        "md5(coalesce(CAST(text AS string), '')) AS body",
    )


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``parent``, ``name`` and ``budget`` of ``children`` (``parent``, ``name``, ``weight``, ``capacity``, ``total``: the parent's budget)."""
    # Capacity over weight, exactly: weights are below 10 ** 6, so different ratios differ within 12 digits.
    ratio = ["capacity DIV weight AS _q", "(capacity % weight) * 1000000000000 DIV weight AS _r"]
    children = staged(children.selectExpr(*parent, name, "CAST(weight AS bigint) AS weight", "CAST(capacity AS bigint) AS capacity", "CAST(total AS bigint) AS total").selectExpr("*", *ratio), "children")
    digits = "CAST(_q AS string)"
    ratios = children.groupBy(*parent, "_q", "_r").agg(F.expr("CAST(sum(CAST(capacity AS decimal(19,0))) AS decimal(20,0)) AS c"), F.expr("CAST(sum(weight) AS decimal(14,0)) AS w"), F.max("total").alias("total"))
    ratios = ratios.withColumn("_block", F.expr(f"100 * length({digits}) + CAST(rpad(substr({digits}, 1, 2), 2, '0') AS int)"))
    blocks = ratios.groupBy(*parent, "_block").agg(F.sum("c").alias("c"), F.sum("w").alias("w"))
    below = Window.partitionBy(*parent).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*parent, "_block", F.coalesce(F.sum("c").over(below), F.lit(0)).alias("taken"), (F.sum("w").over(Window.partitionBy(*parent)) - F.coalesce(F.sum("w").over(below), F.lit(0))).alias("open"))
    inside = Window.partitionBy(*parent, "_block").orderBy("_q", "_r").rowsBetween(Window.unboundedPreceding, -1)
    ordered = ratios.join(blocks, [*parent, "_block"]).withColumn("taken", F.expr("CAST(taken AS decimal(20,0))") + F.coalesce(F.sum("c").over(inside), F.lit(0)))
    ordered = ordered.withColumn("open", F.expr("CAST(open AS decimal(14,0))") - F.coalesce(F.sum("w").over(inside), F.lit(0)))
    full = "c * CAST(open AS decimal(14,0)) <= (CAST(total AS decimal(20,0)) - CAST(taken AS decimal(20,0))) * w"
    facts = ordered.withColumn("full", F.expr(full)).groupBy(*parent).agg(
        F.expr("CAST(max(total) - coalesce(sum(c) FILTER (WHERE full), 0) AS decimal(20,0)) AS rest"),
        F.expr("CAST(sum(w) FILTER (WHERE NOT full) AS decimal(14,0)) AS sharing"),
        F.expr("max(struct(_q, _r)) FILTER (WHERE full) AS level"),
    )
    told = staged(salted_lookup(children, staged(facts, "levels"), parent).selectExpr(*parent, name, "weight", "capacity", "rest", "sharing", "coalesce(struct(_q, _r) <= level, false) AS full"), "told")
    kinds = told.filter("NOT full").groupBy(*parent, "weight").agg(F.count(F.lit(1)).alias("n"), F.max("rest").alias("rest"), F.max("sharing").alias("sharing"))
    product = "(CAST(weight AS decimal(10,0)) * rest)"
    kinds = kinds.withColumn("part", F.expr(f"{product} DIV sharing")).withColumn("left", F.expr(f"CAST({product} % sharing AS decimal(14,0))"))
    larger = Window.partitionBy(*parent).orderBy(F.desc("left"), F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    spare = F.expr("CAST(rest AS bigint)") - F.sum(F.expr("part * n")).over(Window.partitionBy(*parent)) - F.coalesce(F.sum("n").over(larger), F.lit(0))
    kinds = staged(kinds.withColumn("lucky", F.greatest(F.lit(0), F.least("n", spare))).select(*parent, "weight", "part", "lucky"), "kinds")
    shared = salted_lookup(told.filter("NOT full"), kinds, [*parent, "weight"]).withColumn("place", F.md5(name)).withColumn("block", F.expr("substr(place, 1, 3)"))
    counts = shared.groupBy(*parent, "weight", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*parent, "weight").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*parent, "weight", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy(*parent, "weight", "block").orderBy("place", name)) + F.col("ahead")
    shared = shared.join(counts, [*parent, "weight", "block"]).withColumn("budget", F.col("part") + (rank <= F.col("lucky")).cast("bigint"))
    return told.filter("full").select(*parent, name, F.col("capacity").alias("budget")).union(shared.select(*parent, name, "budget"))


def recipe(spark: SparkSession, weights: tuple[tuple[str, str, int], ...] = WEIGHTS) -> DataFrame:
    """``weights`` as the table that ``mix`` takes: ``level``, ``name``, ``weight``."""
    names = ", ".join("('{}', '{}', {})".format(level, name.replace("\\", "\\\\").replace("'", "\\'"), int(weight)) for level, name, weight in weights)
    return spark.sql(f"SELECT * FROM VALUES {names} AS t(level, name, weight)" if names else "SELECT '' AS level, '' AS name, 0 AS weight WHERE false")


def plan_leaves(rows: DataFrame, share: tuple[int, int], epochs: int, weights: DataFrame) -> DataFrame:
    """A row per leaf: ``domain``, ``lang``, ``source``, ``supply``, ``budget``. ``share``: of all tokens, as a fraction."""
    leaves = rows.groupBy(*TREE).agg(F.sum("tokens").alias("supply")).filter("supply > 0")
    for level in TREE:
        of_level = weights.filter(F.col("level") == level).groupBy(F.col("name").alias(level)).agg(F.expr(f"CAST(least(max(weight), 1000000) AS bigint) AS {level}_weight"))
        leaves = leaves.join(of_level, level, "left").withColumn(f"{level}_weight", F.coalesce(f"{level}_weight", F.lit(OTHER)))
    leaves = staged(leaves.filter("domain_weight > 0 AND lang_weight > 0 AND source_weight > 0"), "leaves")
    whole = leaves.agg(F.expr(f"coalesce(sum(supply), 0) * {share[0]} DIV {share[1]}")).scalar()
    above, parent = None, ["_root"]
    for depth, level in enumerate(TREE):
        path = [*TREE[:depth]]
        nodes = leaves.groupBy(*path, level).agg((F.sum("supply") * epochs).alias("capacity"), F.max(f"{level}_weight").alias("weight")).withColumn("_root", F.lit(1))
        budgets = share_out(nodes.withColumn("total", whole) if above is None else nodes.join(above, parent), parent, level)
        above, parent = budgets.withColumnRenamed("budget", "total").drop("_root"), [*path, level]
    return leaves.select(*TREE, "supply").join(above.withColumnRenamed("total", "budget"), [*TREE])


def mix(docs: DataFrame, share: tuple[int, int] = (3, 5), epochs: int = 4, seed: int = 7, weights: DataFrame | None = None, domain: str = DOMAIN) -> DataFrame:
    """The documents to train on: ``doc_id``, leaf, ``tokens``, ``full_epochs`` and ``last_tokens`` (of one more, cut epoch).

    ``weights`` has ``level`` (domain, lang or source), ``name`` and ``weight``; the largest of several counts.
    """
    rows = staged(measured(docs, domain), "measured")
    leaves = staged(plan_leaves(rows, share, epochs, weights if weights is not None else recipe(docs.sparkSession)), "budgets").selectExpr(
        *TREE, "budget DIV supply AS full_epochs", "budget % supply AS prefix"
    )
    keyed = salted_lookup(rows.filter("tokens > 0"), leaves, list(TREE)).filter("prefix IS NOT NULL").selectExpr(
        "doc_id", *TREE, "tokens", "body", "full_epochs", "prefix", f"md5(concat_ws(':', '{seed}', full_epochs + 1, coalesce(CAST(doc_id AS string), body))) AS place"
    )
    keyed = keyed.withColumn("block", F.expr("substr(place, 1, 3)"))
    blocks = keyed.filter("prefix > 0").groupBy(*TREE, "block").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy(*TREE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*TREE, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(*TREE, "block").orderBy("place", "doc_id", "tokens", "body").rowsBetween(Window.unboundedPreceding, -1)
    run = keyed.join(blocks, [*TREE, "block"], "left").withColumn("ahead", F.expr("coalesce(ahead, 0)") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return run.selectExpr("doc_id", *TREE, "tokens", "full_epochs", "greatest(0, least(tokens, prefix - ahead)) AS last_tokens").filter("full_epochs > 0 OR last_tokens > 0")
