"""Run registered queries in Spark and their oracle SQL in DuckDB, compare.

Usage: python tools/oracle_check.py [sf_dir] [key-substring ...]
Rows are compared as multisets after rounding doubles to 6 dp.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tidemark.plans.registry import oracle_sql, queries  # noqa: E402
from tidemark.session import get_spark  # noqa: E402
from tidemark.sources.readers import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    spark = get_spark()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, orc = queries(), oracle_sql()
    bad = 0
    for k, fn in qs.items():
        if pats and not any(p in k for p in pats):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            cols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SPARK {k}: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in orc:
            print(f"ROWS-ONLY {k}: {len(srows)} rows {ts:.1f}s cols={cols}")
            continue
        try:
            rel = con.sql(orc[k])
            ocols = rel.columns
            orows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SQL {k}: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        if sorted(cols) != sorted(ocols):
            print(f"SCHEMA {k}: spark={cols} oracle={ocols}")
            bad += 1
            continue
        tmap = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT"}
        stypes = {f.name: tmap.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
        otypes = dict(zip(ocols, [str(t) for t in rel.types]))
        tdiff = {c: (stypes[c], otypes.get(c)) for c in cols if stypes[c] != otypes.get(c)}
        if tdiff:
            print(f"TYPES {k}: {tdiff}")
        a, b = _rows(cols, srows), _rows(ocols, orows)
        if a == b:
            print(f"OK {k}: {len(a)} rows {ts:.1f}s")
        else:
            bad += 1
            diff_a = [r for r in a if r not in set(b)][:3]
            diff_b = [r for r in b if r not in set(a)][:3]
            print(f"MISMATCH {k}: spark {len(a)} rows, oracle {len(b)} rows; cols={sorted(cols)}")
            print("   spark-only:", diff_a)
            print("   oracle-only:", diff_b)
    print(f"done, {bad} problems")


if __name__ == "__main__":
    main()
