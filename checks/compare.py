"""Run queries and their SQL side by side: ``python -m checks.compare <sf_dir> [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def main(sf_dir: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for t in TABLES.split():
        if Path(f"{sf_dir}/{t}.parquet").exists():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            got, columns = rows_of(df.columns, df.collect())
            took = time.time() - start
            if name not in ORACLES:
                print(f"-- {name}: {sum(got.values())} rows, {took:.1f}s, no SQL", flush=True)
                continue
            result = db.execute(ORACLES[name])
            want, expected = rows_of([d[0] for d in result.description], result.fetchall())
            ok = columns == expected and got == want
            print(f"{'ok' if ok else 'BAD'} {name}: {sum(got.values())} rows, {took:.1f}s", flush=True)
            if not ok:
                bad += 1
                print("   columns", columns, expected, "rows", sum(want.values()))
                print("   only here", list((got - want).items())[:3])
                print("   only SQL ", list((want - got).items())[:3], flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"BAD {name}: {type(e).__name__} {str(e)[:1500]}", flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
