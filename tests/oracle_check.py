"""Run registered queries and their oracle SQL side by side; also a command-line tool.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    return repr(value) if value is not None else "~"


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, connection, folder, build, sql):
    df = build(spark, folder)
    left = normal(df.columns, [tuple(row) for row in df.collect()])
    result = connection.execute(sql)
    right = normal([d[0] for d in result.description], result.fetchall())
    if left[0] != right[0]:
        return f"columns differ: {left[0]} / {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows differ: {len(left[1])} / {len(right[1])}"
    wrong = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left[1])} rows differ, e.g. {wrong[0]}"
    return None if left[1] else "no rows"


def session(app: str = "oracle-check"):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").appName(app)
    spark = (
        builder.config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    from chronoweave.plans import ORACLES, QUERIES

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    spark, connection = session(), duck(folder)
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, connection, folder, QUERIES[name], ORACLES[name])
            else:
                problem = None if QUERIES[name](spark, folder).collect() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
