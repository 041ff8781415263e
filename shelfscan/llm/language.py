"""Language identification by Bayesian fusion of evidence.

The text's likelihood under each language comes from byte trigrams (A-Z lower-cased) in ``BUCKETS`` hashed
buckets, fitted on at most ``PER_LANGUAGE`` labelled rows of every declared language, chosen by hash; ``und`` is the model of no language, with all buckets alike. All rows are then scored, and grouped
counts over all rows give the other evidence: how a declared language goes with what texts say, and priors
per host, smoothed by the address suffix's and those by the whole corpus's. The posterior adds the logs
of all of them; the text's is tempered, as its trigrams are not independent.

A declaration counts by its first subtag, in lower case ("de-AT" is ``de``); one that is not formed like a
language subtag (two to eight letters or digits, a letter first) is the evidence "malformed" and has no
model, nor has ``und``. The model is sparse: a language has a weight only for the buckets that its sample
holds. Languages are dealt into parts of at most ``PART`` weights; one part is shipped and held at a time.
A row carries its ``BEST`` languages by text, the declared one and ``und``, and at fusion the ``LEAD``
commonest of its host; a language of the host that is not among the best has the least score kept. Where
there are fewer than ``BEST`` languages, all are carried.

A row is rejected where the best language is ``und``, is not among ``allowed``, or has a posterior under
``least``. Null, empty or white text is ``und`` and rejected. Null declared languages, hosts or suffixes are
a value of their own. Repeated rows give repeated rows; a null ``doc_id`` stays null. Equal posteriors go to
the language that sorts first, ``und`` last. Without labelled rows all is ``und``. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscan.functions import markup
from shelfscan.llm import words
from shelfscan.llm.common import chunks, salted_lookup, ship, staged, text_buffers

BUCKETS = 1 << 15
#: Bound of the labelled sample of a language that its text model is fitted on.
PER_LANGUAGE = 500
#: Weights of the model that are shipped together, 8 bytes each.
PART = 8_000_000
#: Languages that a row carries, and those of its host that are weighed too.
BEST, LEAD = 32, 4
SALTS = 32
TEMPER = 0.2
#: Rows that a parent's prior counts for, and what an unseen declaration counts for.
SMOOTHING, UNSEEN = 20.0, 1.0
UND = "und"
#: The most that one trigram can speak for ``und`` against a language, so that a name or code outweighs no sentence.
UNKNOWN = 2.0
#: Letters, white space and everything beyond ASCII.
TOLD = ~words.SPACED | (words.ALNUM & ~np.isin(np.arange(256), range(0x30, 0x3A)))


def _trigrams(data: np.ndarray) -> np.ndarray:
    """The bucket of the three bytes from each place on; the last two places have none.

    Digits and punctuation speak for no language: places with any are in the extra bucket ``BUCKETS``.
    """
    if len(data) < 3:
        return np.zeros(0, np.int64)
    told = TOLD[data]
    x = words.LOWER[data].astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return np.where(told[:-2] & told[1:-1] & told[2:], (h >> np.uint32(17)).astype(np.int64), BUCKETS)


def said(declared: str) -> str:
    """The language that a declaration names: null for none, empty for a malformed one."""
    return rf"lower(regexp_extract(trim({declared}), '^([A-Za-z][A-Za-z0-9]{{1,7}})(?:[-_].*)?$', 1))"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams by language and bucket of the labelled rows, added up within a megabyte of text."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        langs = batch.column(0).dictionary_encode()
        ids = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in chunks(offsets, 1 << 20):
            cells = [ids[i] * (BUCKETS + 1) + _trigrams(data[offsets[i] : offsets[i + 1]]) for i in range(a, b)]
            cell, n = np.unique(np.concatenate(cells), return_counts=True)
            lang, bucket = np.divmod(cell, BUCKETS + 1)
            real = bucket < BUCKETS
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[real])).cast(pa.string()), pa.array(bucket[real]), pa.array(n[real].astype(np.int64))], names=["lang", "bucket", "n"])


def fit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model as two tables: ``lang``, ``n``, ``least`` and ``lang``, ``bucket``, ``weight``.

    ``least`` is a language's log probability of a bucket that its sample lacks, ``weight`` what a bucket of the sample
    has beyond that, both above the floor that ``UNKNOWN`` sets. ``n`` is the number of weights. ``rows``: ``key``, ``text``, ``said``.
    """
    ship(rows.sparkSession)
    labelled = rows.filter(f"said <> '' AND said <> '{UND}' AND text IS NOT NULL")
    narrow = labelled.select("said", F.xxhash64("key", "declared").alias("h"))
    for keys in (["said", F.expr("pmod(h, 64)")], ["said"]):
        narrow = narrow.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).filter(f"_n <= {PER_LANGUAGE}").drop("_n")
    edges = staged(narrow.groupBy(F.col("said").alias("lang")).agg(F.max("h").alias("edge")), "sample-edges")
    sample = labelled.join(edges, F.expr("said = lang AND xxhash64(key, declared) <= edge")).select("lang", "text")
    counts = staged(sample.mapInArrow(_counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    over = math.log(BUCKETS) + UNKNOWN
    # A sample without any trigram still makes a language.
    totals = edges.join(counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("n")), "lang", "left").selectExpr("lang", "coalesce(total, 0L) AS total", "coalesce(n, 0L) AS n")
    totals = totals.selectExpr("*", f"greatest(0D, ln(0.05D / (total + {0.05 * BUCKETS}D)) + {over!r}D) AS least")
    weights = counts.join(totals.drop("n"), "lang").selectExpr("lang", "CAST(bucket AS int) AS bucket", f"CAST(greatest(0D, ln((n + 0.05D) / (total + {0.05 * BUCKETS}D)) + {over!r}D) - least AS float) AS weight")
    return staged(totals.select("lang", "n", "least"), "languages"), staged(weights, "weights")


@dataclass
class Part:
    """Weights of some languages by bucket: those of bucket b are at ``start[b]`` to ``start[b + 1]``."""

    names: list[str]
    first: int
    least: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    weight: np.ndarray


def _parts(languages: list, weights: DataFrame) -> Iterator[Part]:
    """The model in parts, each put together on the driver when its turn comes."""
    first = 0
    while first < len(languages) or first == 0:
        last, size = first, 0
        while last < len(languages) and (last == first or size + languages[last]["n"] <= PART):
            size += languages[last]["n"]
            last += 1
        names = [r["lang"] for r in languages[first:last]]
        lang, bucket, weight = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)
        if names:
            got = weights.filter(F.col("lang").between(names[0], names[-1])).toArrow()
            place = {name: i for i, name in enumerate(names)}
            encoded = got["lang"].combine_chunks().dictionary_encode()
            ids = np.array([place[x] for x in encoded.dictionary.to_pylist()], np.int32)
            bucket = got["bucket"].to_numpy()
            order = np.argsort(bucket, kind="stable")
            lang = ids[encoded.indices.to_numpy(zero_copy_only=False)][order] if len(ids) else lang
            bucket, weight = bucket[order], got["weight"].to_numpy()[order]
        yield Part(names, first, np.array([r["least"] for r in languages[first:last]]), np.searchsorted(bucket, np.arange(BUCKETS + 1)), lang, weight)
        first = last
        if not names:
            return


def literal(value: str) -> str:
    """A SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _scores(grams: np.ndarray, owner: np.ndarray, rows: int, part: Part) -> np.ndarray:
    """Log likelihood above the floor of each of ``rows`` texts in each language of ``part``."""
    width = len(part.names)
    counts = part.start[grams + 1] - part.start[grams]
    total = np.bincount(owner, minlength=rows)[:, None] * part.least[None, :]
    ends = np.cumsum(counts)
    at = 0
    while at < len(grams):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + (1 << 21), "right")))
        n = counts[at:to]
        index = np.arange(int(ends[to - 1]) - done) + np.repeat(part.start[grams[at:to]] - (ends[at:to] - n - done), n)
        cells = np.repeat(owner[at:to], n) * width + part.lang[index]
        total += np.bincount(cells, weights=part.weight[index], minlength=rows * width).reshape(rows, width)
        at = to
    return total


_SCORED = "declared string, said string, host string, suffix string, salt int, scores array<struct<j: int, s: double>>, text_hash long"


def _likelihoods(shipped: Broadcast, place: Broadcast, n: int):
    """The tempered log likelihoods of a text's best languages in this part, its declared one and ``und``; none where there is no letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, places = shipped.value, place.value
        width = len(part.names)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            declared = [places.get(x, -1) for x in batch.column(3).to_pylist()]
            js: list[np.ndarray] = []
            ss: list[np.ndarray] = []
            worded = np.zeros(batch.num_rows, bool)
            sizes = np.zeros(batch.num_rows + 1, np.int64)
            for a, b in blocks(offsets, max(1, (1 << 20) // max(width, 1))):
                text, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                worded[a:b] = np.diff(words.bounds(text, at, words.ALNUM)[2]) > 0
                grams = _trigrams(text)
                owner = np.repeat(np.arange(b - a), np.diff(at))[: len(grams)]
                use = (grams < BUCKETS) & (np.arange(len(grams)) + 2 < at[owner + 1])
                grams, owner = grams[use], owner[use]
                und = TEMPER * UNKNOWN * np.bincount(owner, minlength=b - a)
                score = TEMPER * _scores(grams, owner, b - a, part)
                for i in range(a, b):
                    if not worded[i]:
                        continue
                    row = score[i - a]
                    keep = np.arange(width)
                    if width >= BEST:
                        # Ties at the edge go to the language that sorts first.
                        edge = np.partition(row, width - BEST)[width - BEST]
                        above = np.flatnonzero(row > edge)
                        keep = np.sort(np.concatenate([above, np.flatnonzero(row == edge)[: BEST - len(above)]]))
                        mine = declared[i] - part.first
                        if 0 <= mine < width and mine not in keep:
                            keep = np.sort(np.append(keep, mine))
                    js.append(np.append(keep + part.first, n))
                    ss.append(np.append(row[keep], und[i - a]))
                    sizes[i + 1] = len(keep) + 1
            values = pa.StructArray.from_arrays([pa.array(np.concatenate(js) if js else [], pa.int32()), pa.array(np.concatenate(ss) if ss else [], pa.float64())], names=["j", "s"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), values, mask=pa.array(~worded))
            salt = pa.array(np.arange(batch.num_rows) % SALTS, pa.int32())
            columns = [*(batch.column(i) for i in (0, 2, 3, 4, 5)), salt, lists, batch.column(6)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "declared", "said", "host", "suffix", "salt", "scores", "text_hash"])

    return run


def blocks(offsets: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows and a megabyte, or of one longer row."""
    for a, b in chunks(offsets, 1 << 20):
        for i in range(a, b, rows):
            yield i, min(b, i + rows)


def _scored(rows: DataFrame, languages: list, weights: DataFrame) -> DataFrame:
    """Every row's scores, the largest being 0. One pass over the texts per part; what the passes find is put together by row."""
    kind = rows.schema["key"].dataType.simpleString()
    context = rows.sparkSession.sparkContext
    place = context.broadcast({r["lang"]: i for i, r in enumerate(languages)})
    narrow = rows.selectExpr("key", "text", "declared", "said", "host", "suffix", "xxhash64(text, length(text)) AS text_hash")
    passes = []
    for part in _parts(languages, weights):
        shipped = context.broadcast(part)
        passes.append(staged(narrow.mapInArrow(_likelihoods(shipped, place, len(languages)), f"key {kind}, {_SCORED}"), "likelihoods"))
        shipped.unpersist()
    if len(passes) == 1:
        scored = passes[0]
    else:
        row = ["key", "declared", "said", "host", "suffix", "text_hash"]
        once = [p.groupBy(*row).agg(F.first("scores").alias("scores"), F.count("*").alias("n")) for p in passes]
        met = reduce(DataFrame.union, once).groupBy(*row).agg(F.flatten(F.collect_list("scores")).alias("all"), F.max("n").alias("n"))
        # Of all parts' best the best; und comes from each part.
        ranked = "array_sort(array_distinct(all), (x, y) -> CASE WHEN x.s > y.s THEN -1 WHEN x.s < y.s THEN 1 ELSE x.j - y.j END)"
        kept = f"filter(ranked, (x, i) -> i < {BEST} OR x.j = {len(languages)} OR x.j = mine)"
        names = rows.sparkSession.createDataFrame([(r["lang"], i) for i, r in enumerate(languages)], "said string, mine int")
        met = met.join(names, "said", "left").withColumn("ranked", F.expr(ranked)).withColumn("scores", F.expr(f"if(size(all) = 0, NULL, {kept})"))
        scored = staged(met.select(*row[:5], F.explode(F.expr("sequence(1L, n)")).alias("copy"), "scores").selectExpr("key", "declared", "said", "host", "suffix", f"CAST(pmod(copy + xxhash64(key), {SALTS}) AS int) AS salt", "scores"), "likelihoods")
    top = "array_max(transform(scores, c -> c.s))"
    return scored.withColumn("scores", F.expr(f"transform(scores, c -> named_struct('j', c.j, 's', greatest(-700D, c.s - {top})))"))


def _counts(scored: DataFrame, by: list[str]) -> DataFrame:
    """Rows per group and language, by their texts' likelihoods: ``found``, a map, and ``rows``, its sum. One row per group."""
    whole = "aggregate(scores, 0D, (a, c) -> a + exp(c.s))"
    shares = scored.selectExpr(*by, f"inline(transform(scores, c -> named_struct('j', c.j, 'w', exp(c.s) / {whole})))").filter("w > 1e-9")
    per = shares.groupBy(*by, "j").agg(F.expr("round(sum(w), 6)").alias("c"))
    return per.groupBy(*by).agg(F.expr("map_from_entries(sort_array(collect_list(struct(j, c))))").alias("found"), F.expr("sum(c)").alias("rows"))


def _array(values: list) -> str:
    """A literal array of doubles, looked up by place."""
    return f"CAST(split('{','.join(map(repr, values))}', ',') AS array<double>)"


def identify(rows: DataFrame, allowed: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """``key``, ``language``, ``probability``, ``text_language``, ``declared`` and ``rejected`` of ``rows``.

    ``rows`` has ``key``, ``text``, ``declared``, ``host`` and ``suffix``, which may be null. The driver holds a name and
    two numbers for each language, and one part of the model.
    """
    rows = rows.selectExpr("key", "CAST(text AS string) AS text", "CAST(declared AS string) AS declared", "CAST(host AS string) AS host", "CAST(suffix AS string) AS suffix")
    rows = rows.selectExpr("*", f"{said('declared')} AS said")
    totals, weights = fit(rows)
    languages = totals.orderBy("lang").collect()
    names = [*(r["lang"] for r in languages), UND]
    n = len(names)
    scored = _scored(rows, languages, weights)
    told = scored.filter("scores IS NOT NULL")
    sums = {r["j"]: r["c"] for r in told.selectExpr("inline(scores)", "aggregate(scores, 0D, (a, c) -> a + exp(c.s)) AS whole").groupBy("j").agg(F.expr("round(sum(exp(s) / whole), 6)").alias("c")).collect()}
    whole = [sums.get(j) or 0.0 for j in range(n)]
    prior = _array([(x + 1.0) / (sum(whole) + n) for x in whole])
    suffixes = staged(_counts(told, ["suffix"]).selectExpr("suffix AS _s", "found AS suffix_found", "rows AS suffix_rows"), "suffix-priors")
    lead = f"slice(transform(array_sort(map_entries(found), (x, y) -> CASE WHEN x.value > y.value THEN -1 WHEN x.value < y.value THEN 1 ELSE x.key - y.key END), e -> e.key), 1, {LEAD}) AS lead"
    hosts = staged(_counts(told, ["suffix", "host"]).join(suffixes, F.expr("suffix <=> _s")).selectExpr("*", lead).drop("_s"), "host-priors")
    declared = staged(_counts(told, ["said"]).selectExpr("said", "found AS goes"), "declarations")
    by_host = salted_lookup(scored, hosts, ["suffix", "host"], SALTS, "salt")
    missing = "filter(coalesce(lead, array()), j -> NOT exists(scores, c -> c.j = j))"
    floor = "array_min(transform(scores, c -> c.s))"
    weighed = f"concat(scores, transform({missing}, j -> named_struct('j', j, 's', {floor})))"
    of_suffix = f"(coalesce(suffix_found[c.j], 0D) + {SMOOTHING} * {prior}[c.j]) / (suffix_rows + {SMOOTHING})"
    of_host = f"(coalesce(found[c.j], 0D) + {SMOOTHING} * {of_suffix}) / (rows + {SMOOTHING})"
    logs = by_host.selectExpr("key", "declared", "said", "salt", "scores", f"transform({weighed}, c -> named_struct('j', c.j, 's', c.s + ln({of_host}))) AS weighed")
    fused = salted_lookup(logs, declared, ["said"], SALTS, "salt")
    goes = f"(coalesce(goes[c.j], 0D) + {UNSEEN}) / ({_array(whole)}[c.j] + {UNSEEN * (n + 1)})"
    fused = fused.selectExpr("key", "declared", "scores", f"transform(weighed, c -> named_struct('j', c.j, 's', c.s + ln({goes}))) AS logs")
    listed = f"split({literal(','.join(names))}, ',')"
    first = "array_min(transform(filter({0}, c -> c.s = array_max(transform({0}, d -> d.s))), c -> c.j))"
    best = fused.selectExpr("*", "array_max(transform(logs, c -> c.s)) AS top")
    out = best.selectExpr(
        "key",
        f"if(scores IS NULL, '{UND}', {listed}[{first.format('logs')}]) AS language",
        "if(scores IS NULL, 1D, round(1 / aggregate(logs, 0D, (a, c) -> a + exp(c.s - top)), 6)) AS probability",
        f"if(scores IS NULL, '{UND}', {listed}[{first.format('scores')}]) AS text_language",
        "declared",
    )
    permitted = "true" if allowed is None else f"language IN ({', '.join(map(literal, allowed))})"
    return out.withColumn("rejected", F.expr(f"language = '{UND}' OR NOT {permitted} OR probability < {least}"))


def of_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents as rows of ``identify``: the language column is the declaration, the source the host."""
    return docs.selectExpr(f"{key} AS key", "text", "lang AS declared", "source AS host", "CAST(NULL AS string) AS suffix")


def of_pages(pages: DataFrame) -> DataFrame:
    """Pages as rows of ``identify``: visible text, character references decoded, declared markup language, host and address suffix."""
    bare = markup.page_text(markup.without_raw_blocks("html"))
    host = r"lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1))"
    return pages.selectExpr("page_id AS key", f"{bare} AS text", r"nullif(lower(regexp_extract(html, '(?i)<html[^>]*\\blang=.?([A-Za-z]+)', 1)), '') AS declared", f"{host} AS host", rf"regexp_extract({host}, '([^.]+)$', 1) AS suffix")


def language_id(docs: DataFrame) -> DataFrame:
    return identify(of_documents(docs)).withColumnRenamed("key", "doc_id")


def language_of_tables(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """``table``, ``doc_id`` or ``page_id``, and what ``identify`` finds: every row of both, each table by its own evidence."""
    key = {f: t.schema[f].dataType.simpleString() for f, t in (("doc_id", docs), ("page_id", pages))}
    columns = ["language", "probability", "text_language", "declared", "rejected"]
    of_docs = identify(of_documents(docs)).selectExpr("'documents' AS table", "key AS doc_id", f"CAST(NULL AS {key['page_id']}) AS page_id", *columns)
    return of_docs.union(identify(of_pages(pages)).selectExpr("'pages' AS table", f"CAST(NULL AS {key['doc_id']}) AS doc_id", "key AS page_id", *columns))
