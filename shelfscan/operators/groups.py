"""Per-group operations that hold up when one group has a third of all rows.

No function here puts a whole group of unknown size into one task: groups are cut into
salts or blocks first, and only bounded or pre-aggregated remains meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64
BLOCK = 4096


def salt_of(*columns: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def first_per_group(df: DataFrame, keys: list[str], order: list, n: int | None, spread_by: list[str]) -> DataFrame:
    """The first ``n`` rows of every group by ``order``; all rows where ``n`` is None.

    Cut per salted part of a group, then once more: the second cut sees at most
    ``SALTS * n`` rows of a group. ``spread_by`` columns must vary within a group.
    """
    if n is None:
        return df
    salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt_of(*spread_by))
        .withColumn("_rn", F.row_number().over(salted))
        .filter(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(whole))
        .filter(F.col("_rn") <= n)
        .drop("_salt", "_rn")
    )


def attach(df: DataFrame, facts: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner") -> DataFrame:
    """Join one small row of ``facts`` per key to every row of ``df``.

    Each fact is repeated once per salt, so the rows of a hot key land in ``SALTS``
    partitions instead of one.
    """
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", salt_of(*spread_by)).join(copies, [*keys, "_salt"], how).drop("_salt")


def first_seen(df: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """One row per key with its smallest ``order`` (as ``pos``); combines before the shuffle."""
    return df.groupBy(*keys).agg(F.min(order).alias("pos"))


def numbered(df: DataFrame, keys: list[str], block: str, order: list[str], name: str = "pos") -> DataFrame:
    """Adds the 0-based position of every row within its ``keys``, by ``block`` and then ``order``.

    ``block`` (SQL text) rises with the order. Rows are counted per block; only one row
    per block meets in the window over a whole key, and blocks are numbered apart.
    """
    marked = df.withColumn("_block", F.expr(block))
    sizes = marked.groupBy(*keys, "_block").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_block", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    placed = marked.withColumn("_in", F.row_number().over(inside)).join(offsets, [*keys, "_block"])
    return placed.withColumn(name, (F.col("_offset") + F.col("_in") - 1).cast("bigint")).drop("_block", "_in", "_offset")


def page_runs(pages: DataFrame, keys: list[str], last: Column | None = None) -> DataFrame:
    """Runs of consecutive page numbers.

    ``pages`` has one row per (``keys``, page BIGINT) with a count ``n``. Adds ``stop``, the
    last page of the run that a page belongs to, and ``before``, the sum of ``n`` over
    all smaller pages of the key. ``last`` marks pages that end a run although the next
    one exists. Pages are handled in blocks of ``BLOCK`` numbers; only one row per block
    meets in the window over a whole key.
    """
    following = pages.select(*keys, (F.col("page") - 1).alias("page"), F.lit(True).alias("_next"))
    marked = pages.join(following, [*keys, "page"], "left").withColumn(
        "_end", F.when(F.col("_next").isNull() | (F.lit(False) if last is None else last), F.col("page"))
    )
    marked = marked.withColumn("_block", F.floor(F.col("page") / BLOCK))
    per_block = marked.groupBy(*keys, "_block").agg(
        F.min("_end").alias("_first_end"), F.sum("n").alias("_block_n")
    )
    later = Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.select(
        *keys,
        "_block",
        F.min("_first_end").over(later).alias("_later_end"),
        F.coalesce(F.sum("_block_n").over(earlier), F.lit(0)).alias("_offset"),
    )
    ahead = Window.partitionBy(*keys, "_block").orderBy(F.desc("page")).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*keys, "_block").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return (
        marked.withColumn("_near_end", F.min("_end").over(ahead))
        .withColumn("_near_n", F.coalesce(F.sum("n").over(behind), F.lit(0)))
        .join(per_block, [*keys, "_block"])
        .withColumn("stop", F.coalesce("_near_end", "_later_end"))
        .withColumn("before", F.col("_offset") + F.col("_near_n"))
        .drop("_next", "_end", "_block", "_near_end", "_near_n", "_later_end", "_offset")
    )
