"""Session settings and staging."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from shelfscan import rules

SETTINGS = {
    # A key repeated inside one JSON object must not make the whole block unreadable.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Lets a per-site limit of usual size be cut on the map side, before its shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": str(rules.MAX_URLS),
    "spark.sql.session.timeZone": "UTC",
    # Pages go to Python in batches that are small whatever their length.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    # Arrays of a page are put together sorted by page: one page at a time in memory, no hash map of
    # pages and no second sort when that map overflows.
    "spark.sql.execution.useObjectHashAggregateExec": "false",
    # Each side of a union has tasks of its own; otherwise one task holds the sort buffers of all sides at once.
    "spark.sql.unionOutputPartitioning": "false",
    # Many small folders are listed by tasks with several each; a task for every folder costs far more than its listing.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "512",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python, once per application; a local master has it already."""
    context = spark.sparkContext
    if context.master.startswith("local[") or getattr(context, "_engine_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="ship-")) / "engine_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    context._engine_shipped = True


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by ``keys`` into the session's full number of shuffle partitions.

    Shredding a page multiplies its bytes, so partitions must not be merged by the
    size they have before it.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def fill_cores(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle only where the input has fewer partitions than the cluster has cores.

    Large archives arrive in many splits and pass through; a small file of pages would
    otherwise be parsed by one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can reach, as named by the cluster; one of its own on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several later steps read one costly result. The written table
    outlives a lost executor.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
