import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfscan.session import prepare, shared_folder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    shared_folder(session)
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def ev(spark):
    """Evaluate SQL expression texts over one row of named strings."""

    def evaluate(expression, **values):
        row = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} STRING" for k in values) or "one INT")
        return row.selectExpr(f"{expression} AS x").first()["x"]

    return evaluate
