"""Runs registered queries next to their SQL on DuckDB and compares schema and values.

    python tests/oracle_check.py [sf] [name prefix ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads=8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _kind(type_name: str) -> str:
    t = type_name.lower()
    for kind, names in {
        "int": ("int", "integer"), "long": ("bigint", "long"), "double": ("double",), "string": ("varchar", "string"),
        "bool": ("boolean",), "date": ("date",), "timestamp": ("timestamp",),
    }.items():
        if t in names:
            return kind
    return t


def _rows(cols, raw):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in raw]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark_df, con, sql: str) -> str:
    cols = spark_df.columns
    left = _rows(cols, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    rcols = [d[0] for d in cur.description]
    rtypes = {d[0]: str(d[1]) for d in cur.description}
    right = _rows(rcols, cur.fetchall())
    if sorted(cols) != sorted(rcols):
        return f"COLUMNS {sorted(cols)} != {sorted(rcols)}"
    kinds = [(c, _kind(t), _kind(rtypes[c])) for c, t in spark_df.dtypes]
    bad = [k for k in kinds if k[1] != k[2] and "array" not in k[1] and "[]" not in k[2]]
    note = f" TYPES {bad}" if bad else ""
    if len(left) != len(right):
        return f"ROWS {len(left)} != {len(right)}{note}"
    if left != right:
        diff = [(a, b) for a, b in zip(left, right) if a != b]
        return f"VALUES {len(diff)}/{len(left)} differ, e.g. {diff[0]}{note}"
    return (f"ok {len(left)} rows" if not bad else "BADTYPES") + note


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("oracle-check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    import __spark_entry__ as entry

    sf = argv[0] if argv else "sf0.01"
    prefixes = tuple(argv[1:])
    sf_dir = f"/root/testdata/{sf}"
    spark, con = session(), connect(sf_dir)
    sqls, fails = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                res = compare(df, con, sqls[name])
            else:
                res = f"rows-only {len(df.collect())}"
        except Exception as e:  # report and go on with the next query
            res = "ERROR " + " ".join(str(e).split())[:600]
        good = res.startswith(("ok", "rows-only"))
        fails += not good
        print(f"{'   ' if good else '***'} {name:38s} {time.time() - t:6.1f}s {res}", flush=True)
    print("failures:", fails)
    return fails


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
