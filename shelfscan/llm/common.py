"""Helpers that the operators share: staging in the shared folder and Arrow text columns."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python, once per application."""
    context = spark.sparkContext
    if getattr(context, "_shelfscan_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="ship-")) / "shelfscan_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    context._shelfscan_shipped = True


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_lookup(df: DataFrame, facts: DataFrame, keys: list[str], salts: int = 32, salt: str | None = None) -> DataFrame:
    """Left join of one small row of ``facts`` per key; a hot key's rows are dealt to ``salts`` tasks.

    Nulls in ``keys`` match. ``facts`` holds groups (hosts, leaves), not documents. ``salt`` names a column of ``df`` from 0
    to ``salts`` - 1 to deal by; it stays. Without one rows are dealt by their order, so ``df`` must come from a staged table.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    right = facts.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c for c in facts.columns if c not in keys])
    right = right.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = df.withColumn("_salt1", F.col(salt) if salt else F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    on: Column = F.col("_salt1") == F.col("_salt2")
    for k, n in zip(keys, names):
        on = on & F.col(k).eqNullSafe(F.col(n))
    return left.join(right, on, "left").drop("_salt1", "_salt2", *names)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow text column without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes, or of one longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last
