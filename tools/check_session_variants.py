"""Run every registered query the way an outside caller would, under different session settings.

Loads ``__spark_entry__.py`` by file path (so it must work from any working
directory), builds a plain session with the given extra settings, and compares
each query with its DuckDB oracle.  Usage:

    python tools/check_session_variants.py [sf_dir] [key=value ...]
    e.g.  python tools/check_session_variants.py /root/testdata/sf0.01 spark.sql.ansi.enabled=false
"""

from __future__ import annotations

import importlib.util
import math
import os
import sys
import time
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

ENTRY = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return str(v)
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in recs]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    extra = dict(a.split("=", 1) for a in sys.argv[2:])
    spec = importlib.util.spec_from_file_location("spark_entry_under_test", ENTRY)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    builder = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    for k, v in extra.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    print("entry rows:", mod.entry(spark).count())
    oracle, bad, t0 = mod.oracle_sql(), 0, time.time()
    for name, fn in mod.queries().items():
        df = fn(spark, sf)
        recs = df.collect()
        if name in oracle:
            res = con.execute(oracle[name])
            oc = [d[0] for d in res.description]
            if sorted(oc) != sorted(df.columns) or _rows(df.columns, recs) != _rows(oc, res.fetchall()):
                print("MISMATCH", name)
                bad += 1
    print(f"{len(mod.queries())} queries, {bad} mismatches, {time.time() - t0:.1f} s, settings={extra}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
