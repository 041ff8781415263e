"""Connected components by large-star and small-star steps, for tables of links of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.llm.common import staged


def _smallest(edges: DataFrame, name: str) -> DataFrame:
    """Edges (u, v) with ``m``, the smallest of u and its neighbours. Staged, so that hot nodes can be split."""
    mins = staged(edges.groupBy("u").agg(F.min("v").alias("m")), name).withColumnRenamed("u", "_u")
    return edges.join(mins, F.col("u") == F.col("_u")).selectExpr("u", "v", "least(m, u) AS m")


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every node of ``links`` (``a``, ``b``).

    Each round hangs all larger neighbours of a node on its smallest neighbour, then all smaller ones, until
    every node hangs on its component's smallest; the number of rounds grows with the logarithm of the
    longest path. Self-links and null ends are ignored.
    """
    pairs = links.filter("a <> b").selectExpr("least(a, b) AS v", "greatest(a, b) AS u").distinct()
    edges = staged(pairs, "edges")
    while True:
        both = edges.select("u", "v").union(edges.selectExpr("v AS u", "u AS v"))
        large = _smallest(both, "large").filter("v > u").selectExpr("v AS u", "m AS v").distinct()
        large = staged(large.filter("u <> v"), "large-star")
        marked = _smallest(large, "small")
        small = marked.selectExpr("v AS u", "m AS v").union(marked.selectExpr("u", "m AS v")).filter("u <> v").distinct()
        after = staged(small, "small-star")
        # Done when the edges are stars: no node both hangs on one and carries others, and none hangs twice.
        counts = after.groupBy("u").agg(F.count("*").alias("n"))
        twice = counts.filter("n > 1").limit(1).count()
        chained = 0 if twice else after.select(F.col("v").alias("u")).distinct().join(counts, "u", "left_semi").limit(1).count()
        edges = after
        if not twice and not chained:
            break
    return edges.selectExpr("u AS id", "v AS component").union(edges.selectExpr("v AS id", "v AS component").distinct())
