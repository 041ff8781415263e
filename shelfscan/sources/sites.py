"""Site lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfscan.functions.urls import normalise_site
from shelfscan.session import prepare


def read_sites(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """(site) from a list of addresses or a text file with one address per line."""
    prepare(spark)
    if isinstance(source, str):
        lines = spark.read.text(source)
    else:
        lines = spark.createDataFrame([(s,) for s in source], "value STRING")
    return clean_sites(lines, "value")


def clean_sites(df: DataFrame, column: str) -> DataFrame:
    sites = df.filter(f"trim({column}) <> ''").selectExpr(f"{normalise_site(column)} AS site")
    return sites.filter("site <> ''").distinct()
