"""Run registered queries against their DuckDB oracle (row count, column names,
order-insensitive values).  ``python tests/oracle_check.py [sf_dir] [key ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def canon(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(canon(x) for x in v)
    if isinstance(v, (float, np.floating)):
        f = float(v)
        return None if math.isnan(f) else f
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (np.bool_,)):
        return bool(v)
    return v


def rows_of(pdf) -> list:
    cols = sorted(pdf.columns)
    out = [tuple(canon(x) for x in row) for row in pdf[cols].itertuples(index=False, name=None)]
    return sorted(out, key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, key: str, fn, sql: str | None, sf_dir: str, con) -> dict:
    t0 = time.time()
    df = fn(spark, sf_dir)
    types, sdf = dict(df.dtypes), df.toPandas()
    t1 = time.time()
    res = {"key": key, "rows": len(sdf), "spark_s": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    ddf = con.execute(sql).df()
    res["oracle_rows"] = len(ddf)
    if sorted(sdf.columns) != sorted(ddf.columns):
        res["status"] = f"COLUMNS {sorted(sdf.columns)} vs {sorted(ddf.columns)}"
        return res
    for c, t in ddf.dtypes.items():  # whole numbers with nulls: pandas makes floats of Spark's
        if str(t) == "Int64" and types.get(c) == "bigint":
            sdf[c] = sdf[c].astype("Int64")
    st = {c: str(t) for c, t in sdf.dtypes.items()}
    dt = {c: str(t) for c, t in ddf.dtypes.items()}
    if st != dt:
        res["status"] = f"TYPES {st} vs {dt}"
        return res
    a, b = rows_of(sdf), rows_of(ddf)
    if a == b:
        res["status"] = "match"
    else:
        bad = sum(1 for x, y in zip(a, b) if x != y)
        res["status"] = f"MISMATCH {bad} rows"
        for x, y in zip(a, b):
            if x != y:
                res["example"] = (repr(x)[:300], repr(y)[:300])
                break
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    import __spark_entry__ as E
    from kiln.session import build_session

    if os.environ.get("PLAIN_SESSION"):  # what a driver with default settings would give
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    else:
        spark = build_session("local[8]", conf={"spark.sql.shuffle.partitions": "8"})
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for k, fn in qs.items():
        if only and k not in only:
            continue
        try:
            r = compare(spark, k, fn, sqls.get(k), sf_dir, con)
        except Exception as e:  # noqa: BLE001
            r = {"key": k, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{bad} failing of {len([k for k in qs if not only or k in only])}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
