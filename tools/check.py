"""Compare every registered query with its reference SQL in DuckDB.

usage: python tools/check.py [data_folder] [name-prefix ...]
"""

import datetime
import decimal
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wardlens.plans.catalogue import ORACLES, PLANS  # noqa: E402
from wardlens.session import get_spark  # noqa: E402
from wardlens.sources.tables import RAW_SCHEMAS, Tables  # noqa: E402


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return 0.0 if value == 0 else float(f"{value:.9g}")
    if isinstance(value, int):
        return float(value) if abs(value) < 2**53 else value
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def connect(folder):
    connection = duckdb.connect()
    for name in RAW_SCHEMAS:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def compare(connection, tables, name):
    """Return (ok, spark_rows, detail) for one query."""
    frame = PLANS[name](tables)
    names, got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    if name not in ORACLES:
        return True, len(got), "rows only"
    cursor = connection.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    oracle_names, want = rows(columns, cursor.fetchall())
    if names != oracle_names:
        return False, len(got), f"columns {names} != {oracle_names}"
    if got != want:
        left, right = set(map(repr, got)), set(map(repr, want))
        return False, len(got), (
            f"{len(got)} vs {len(want)} rows; spark only {sorted(left - right)[:3]}; sql only {sorted(right - left)[:3]}"
        )
    return True, len(got), "equal"


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = get_spark(master="local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, tables, failed = connect(folder), Tables(spark, folder), []
    for name in PLANS:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            ok, count, detail = compare(connection, tables, name)
        except Exception as error:
            ok, count, detail = False, -1, "".join(traceback.format_exception_only(error))[:1500]
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} rows={count} {time.time() - started:.2f}s {detail}", flush=True)
    print("failed:", failed)
