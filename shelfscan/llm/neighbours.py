"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors form one node. A forest of random hyperplanes gives each node first neighbours; then rounds
of NN-descent join every node's neighbours and reverse neighbours with one another, so that neighbours of
neighbours meet, and keep the best. A query starts from its own node's list and goes greedily through the
graph: each hop joins its best unvisited candidates with the graph, until none of the best ``k``
change. Its best candidates are then scored exactly on the original vectors.

Nearness is the inner product. A node keeps its direction, one byte a component, and its length; planes cut
directions, so a few long vectors do not blur the rest, and candidates are scored by direction and length. As the
longest vectors are near to many at once, the ``LONGEST`` longest are offered to every node from the start. Rounds go
on until at most ``STILL`` of all lists change, hops until no query's best change. Recall against brute force is
measured in the tests, on unit, lognormal, clustered vectors and with outliers.

Vectors that are null, zero, of another dimension than most, or hold null or non-finite components take no
part, nor do rows without ``vec_id``; repeated rows count once. Ties go to the smaller ``vec_id``. Only the named
columns are read. Tables with fewer vectors than asked give all there are; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscan.llm import words
from shelfscan.llm.common import ship, staged

TREES, LEAF = 16, 512
DEGREE, REVERSE = 32, 16
OFFER, STILL = 8, 0.05
BEAM, KEEP = 64, 256
LONGEST = 512


def _valid(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``v`` (array<double>) of the rows that take part."""
    rows = vectors.selectExpr("CAST(vec_id AS bigint) AS vec_id", "CAST(embedding AS array<double>) AS v")
    good = "vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)"
    return rows.filter(good)


def _firsts(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` smallest ids of every vector, cut in three steps so that a hot vector never meets in one task."""
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    for salts in (64, 8, 1):
        part = Window.partitionBy("h1", "h2", F.expr(f"pmod(xxhash64(vec_id), {salts})")).orderBy("vec_id")
        rows = rows.withColumn("_n", F.row_number().over(part)).filter(f"_n <= {n}").drop("_n")
    return rows


def _packed(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long binaries as rows of signed bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, width)


def _planes(trees: int, depth: int, width: int) -> np.ndarray:
    """Fixed pseudo-random hyperplanes with nearly normal components."""
    n = trees * depth * width
    bits = words.mix(np.arange(1, 12 * n + 1, dtype=words.U)).reshape(12, n)
    return ((bits >> words.U(40)).astype(np.float32).sum(axis=0) / (1 << 24) - 6).reshape(trees, depth, width)


def _prepared(largest: float, trees: int, depth: int):
    """The direction of every node in bytes, the factor that gives its vector back (in units of ``largest``), and its
    leaf in every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            top = np.abs(x).max(axis=1)
            x = x / top[:, None]
            packed = np.rint(x * 127).astype(np.int8)
            planes = _planes(trees, depth, x.shape[1])
            leaves = ((x @ planes.reshape(-1, x.shape[1]).T > 0).reshape(len(x), trees, depth) * (1 << np.arange(depth))).sum(axis=2) if depth else np.zeros((len(x), trees), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p.tobytes() for p in packed], pa.binary()), pa.array((top / largest).astype(np.float32)), pa.array(np.sqrt((x * x).sum(axis=1)) * (top / largest)), pa.array(list(leaves.astype(np.int64)), pa.list_(pa.int64()))],
                names=["id", "p", "f", "length", "leaves"],
            )

    return run


def _best(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` largest scores, largest first."""
    if len(scores) > n:
        top = np.argpartition(-scores, n - 1)[:n]
        return top[np.argsort(-scores[top], kind="stable")]
    return np.argsort(-scores, kind="stable")


def _lists(ids: list, scores: list, names: tuple[str, ...], heads: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(heads, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float32()))], names=list(names))


def _met(width: int, offer: int):
    """Of every row's members (id, vector, threshold): for each, the best others beyond its threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, at = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ids = flat.field("id").to_numpy()
            floor = flat.field("floor").to_numpy()
            vectors = _packed(flat.field("p"), width).astype(np.float32) * (flat.field("f").to_numpy() / 127)[:, None]
            heads, found, scored = [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                some = ids[a:b]
                score = vectors[a:b] @ vectors[a:b].T
                score[some[:, None] == some[None, :]] = -np.inf
                score[score <= floor[a:b, None]] = -np.inf
                n = min(offer, b - a)
                top = np.argpartition(-score, n - 1, axis=1)[:, :n] if n < b - a else np.tile(np.arange(b - a), (b - a, 1))
                best = np.take_along_axis(score, top, 1)
                for i in np.flatnonzero(best.max(axis=1) > -np.inf).tolist():
                    good = best[i] > -np.inf
                    heads.append(some[i])
                    found.append(some[top[i][good]])
                    scored.append(best[i][good])
                if len(heads) > 20_000:
                    yield _lists(found, scored, ("id", "ids", "scores"), heads)
                    heads, found, scored = [], [], []
            if heads:
                yield _lists(found, scored, ("id", "ids", "scores"), heads)

    return run


def _merged(degree: int):
    """The best distinct neighbours of every node, out of all lists offered to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, scores = [], []
            for i, s in zip(batch.column(1), batch.column(2)):
                x, y = i.values.flatten().to_numpy(), s.values.flatten().to_numpy()
                x, first = np.unique(x, return_index=True)
                y = y[first]
                top = _best(y, degree)
                ids.append(x[top])
                scores.append(y[top])
            yield _lists(ids, scores, ("id", "ids", "scores"), batch.column(0))

    return run


def _grown(graph: DataFrame, offers: DataFrame, name: str) -> DataFrame:
    lists = offers if graph is None else graph.select("id", "ids", "scores").union(offers)
    both = lists.groupBy("id").agg(F.collect_list("ids").alias("ids"), F.collect_list("scores").alias("scores"))
    return staged(both.mapInArrow(_merged(DEGREE), "id long, ids array<long>, scores array<float>"), name)


def _around(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per node ``at``: its neighbours and up to REVERSE reverse ones, with vectors and their own thresholds."""
    there = graph.selectExpr("id", "explode(ids) AS other")
    back = there.withColumn("_n", F.row_number().over(Window.partitionBy("other").orderBy(F.xxhash64("id", "other")))).filter(f"_n <= {REVERSE}")
    pairs = there.selectExpr("id AS at", "other AS id").union(back.selectExpr("other AS at", "id")).distinct()
    floors = graph.selectExpr("id AS _g", f"if(size(scores) < {DEGREE}, float('-infinity'), scores[size(scores) - 1]) AS floor")
    known = staged(nodes.select("id", "p", "f").join(floors, F.col("id") == F.col("_g"), "left").selectExpr("id", "p", "f", "coalesce(floor, float('-infinity')) AS floor"), "known")
    return pairs.join(known, "id").groupBy("at").agg(F.collect_list(F.struct("id", "p", "f", "floor")).alias("members"))


def build_graph(nodes: DataFrame, width: int) -> DataFrame:
    """``id`` with the ``ids`` and ``scores`` (of byte vectors) of its neighbours; ``nodes`` has id, p, f, length, leaves."""
    placed = nodes.select("id", "p", "f", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = staged(placed.groupBy("tree", "leaf").agg(F.expr(f"CAST(ceil(count(*) / {2 * LEAF}) AS int) AS parts")), "leaf-sizes")
    leaves = placed.join(sizes, ["tree", "leaf"]).groupBy("tree", "leaf", F.expr("pmod(xxhash64(id), parts)").alias("part"))
    members = leaves.agg(F.collect_list(F.expr("named_struct('id', id, 'p', p, 'f', f, 'floor', float('-infinity'))")).alias("members"))
    schema = "id long, ids array<long>, scores array<float>"
    longest = nodes.orderBy(F.desc("length"), "id").limit(LONGEST).select("id", "p", "f").collect()
    first = members.select("members").mapInArrow(_met(width, DEGREE * 5 // 8), schema)
    graph = _grown(None, first.union(nodes.select("id", "p", "f").mapInArrow(_offered(longest, width), schema)), "graph")
    n = graph.count()
    while True:
        offers = _around(graph, nodes).select("members").mapInArrow(_met(width, OFFER), schema)
        after = _grown(graph, offers, "graph")
        changed = after.join(graph.selectExpr("id", "ids AS _before"), "id").filter("ids <> _before").count()
        graph = after
        if changed <= STILL * n:
            return graph


def _offered(longest: list, width: int):
    """To every node, the best of the ``longest``: a stated number of rows whatever the table."""
    names = np.array([r.id for r in longest], np.int64)
    vectors = np.frombuffer(b"".join(bytes(r.p) for r in longest), np.int8).reshape(-1, width).astype(np.float32) * np.array([r.f / 127 for r in longest], np.float32)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            own = _packed(batch.column(1), width).astype(np.float32) * (batch.column(2).to_numpy() / 127)[:, None]
            score = own @ vectors.T
            score[ids[:, None] == names[None, :]] = -np.inf
            tops = [_best(row, DEGREE) for row in score]
            tops = [t[row[t] > -np.inf] for t, row in zip(tops, score)]
            yield _lists([names[t] for t in tops], [row[t] for t, row in zip(tops, score)], ("id", "ids", "scores"), batch.column(0))

    return run


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's neighbours as ids and one binary of their vectors."""
    for batch in batches:
        ids, vectors, factors = [], [], []
        for members in batch.column(1):
            flat = members.values
            ids.append(flat.field("id").to_numpy())
            vectors.append(b"".join(flat.field("p").to_pylist()))
            factors.append(flat.field("f").to_numpy())
        columns = [batch.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(vectors, pa.binary()), pa.array(factors, pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "ids", "vectors", "factors"])


def _scored(width: int):
    """Candidates (ids, scores) that a visited node offers to a query; columns: query, q, ids, vectors, factors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int8).reshape(-1, width).astype(np.float32)
            scores = [np.frombuffer(v.as_buffer(), np.int8).reshape(-1, width).astype(np.float32) @ q * f.values.to_numpy() for v, q, f in zip(batch.column(3), queries, batch.column(4))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.list_(pa.float32()))], names=["query", "ids", "scores"])

    return run


def _step(k: int):
    """Merge what a hop found into each query's candidates; choose the next to visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for ids, scores, seen, more, more_scores in zip(*(batch.column(i) for i in range(2, 7))):
                old = ids.values.to_numpy() if ids.is_valid else np.zeros(0, np.int64)
                x, y = [old], [scores.values.to_numpy() if scores.is_valid else np.zeros(0, np.float32)]
                if more.is_valid and len(more):
                    x.append(more.values.flatten().to_numpy())
                    y.append(more_scores.values.flatten().to_numpy())
                x, first = np.unique(np.concatenate(x), return_index=True)
                y = np.concatenate(y)[first]
                top = _best(y, KEEP)
                x, y = x[top], y[top]
                visited = seen.values.to_numpy() if seen.is_valid else np.zeros(0, np.int64)
                go = x[~np.isin(x, visited)][:BEAM]
                changed = not np.array_equal(x[:k], old[:k])
                out[0].append(x)
                out[1].append(y)
                out[2].append(np.concatenate([visited, go]))
                out[3].append(go)
                out[4].append(changed)
            kinds = (pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(out, kinds)]], names=["query", "q", "ids", "scores", "seen", "go", "changed"])

    return run


STATE = "query long, q binary, ids array<long>, scores array<float>, seen array<long>, go array<long>, changed boolean"


def _search(graph: DataFrame, nodes: DataFrame, starts: DataFrame, width: int, k: int) -> DataFrame:
    """Best candidates (``query``, ``id``) of each start node (``id``, ``q``)."""
    adjacency = staged(_around(graph, nodes).mapInArrow(_adjacent, "at long, ids array<long>, vectors binary, factors array<float>"), "adjacency")
    own = starts.selectExpr("id AS query", "q", "array(id) AS go0")
    state = staged(own.selectExpr("query", "q", "CAST(array() AS array<bigint>) AS ids", "CAST(array() AS array<float>) AS scores", "go0 AS seen", "go0 AS go", "true AS changed"), "search")
    hop = 0
    while True:
        visits = state.filter("changed").selectExpr("query", "q", "explode(go) AS at").join(adjacency, "at").select("query", "q", "ids", "vectors", "factors")
        found = visits.mapInArrow(_scored(width), "query long, ids array<long>, scores array<float>")
        found = found.groupBy("query").agg(F.collect_list("ids").alias("more"), F.collect_list("scores").alias("more_scores"))
        step = state.select("query", "q", "ids", "scores", "seen").join(found, "query", "left")
        state = staged(step.mapInArrow(_step(k), STATE), "search")
        if hop and not state.filter("changed").limit(1).count():
            break
        hop += 1
    return state.selectExpr("query", "explode(slice(ids, 1, {}))".format(3 * k) + " AS id")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The ``k`` nearest rows of each row whose ``vec_id`` is divisible by ``every``: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    ship(vectors.sparkSession)
    valid = _valid(vectors)
    usual = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dimension = usual[0]["d"] if usual else 1
    rows = valid.filter(F.size("v") == dimension).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = staged(rows, "vectors")
    largest = rows.agg(F.expr("max(array_max(transform(v, x -> abs(x)))) AS largest")).first()["largest"] or 1.0
    firsts = _firsts(rows, k + 1).groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("members"), F.first("v").alias("v"))
    classes = staged(firsts, "vector-classes")
    depth = max(0, math.ceil(math.log2(max(1, classes.count()) / LEAF)))
    nodes = staged(classes.select("id", "v").mapInArrow(_prepared(largest, TREES, depth), "id long, p binary, f float, length double, leaves array<long>"), "nodes")
    graph = build_graph(nodes, dimension)
    hashed = rows.filter(F.expr(f"vec_id % {int(every)} = 0")).selectExpr("vec_id AS query_id", "xxhash64(v) AS h1", "xxhash64(1, v) AS h2")
    asked = staged(hashed.join(classes.select("h1", "h2", "id"), ["h1", "h2"]).select("query_id", F.col("id").alias("query")), "asked")
    starts = nodes.join(asked.select(F.col("query").alias("id")).distinct(), "id").selectExpr("id", "p AS q")
    found = _search(graph, nodes, starts, dimension, k).union(asked.selectExpr("query", "query AS id").distinct()).distinct()
    ends = staged(classes.selectExpr("id", "v", "members"), "ends")
    scored = found.join(ends, "id").join(ends.selectExpr("id AS query", "v AS qv"), "query")
    scored = scored.selectExpr("query", "members", "aggregate(zip_with(v, qv, (x, y) -> x * y), 0D, (a, x) -> a + x) AS score")
    each = scored.selectExpr("query", "explode(members) AS vec_id", "score")
    top = each.groupBy("query").agg(F.expr(f"slice(array_sort(collect_list(named_struct('s', -score, 'vec_id', vec_id))), 1, {k + 1}) AS best"))
    final = asked.join(staged(top, "best"), "query").selectExpr("query_id", f"posexplode(slice(filter(best, b -> b.vec_id <> query_id), 1, {k})) AS (rank, b)")
    return final.selectExpr("query_id", "CAST(rank + 1 AS int) AS rank", "b.vec_id AS vec_id", "-b.s AS score")
