"""Compare registered queries with their SQL on DuckDB: python tools/check_oracle.py [sf_dir] [name ...]."""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from eventloom.queries import ORACLES, QUERIES  # noqa: E402
from eventloom.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df.reindex(sorted(df.columns), axis=1)
    out = {}
    for c in df.columns:
        s = df[c]
        if pd.api.types.is_bool_dtype(s):
            s = s.astype("int64")
        if pd.api.types.is_numeric_dtype(s):
            s = s.astype("float64").round(6) + 0.0
        else:
            s = s.map(lambda v: None if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)) else str(v)[:10] if hasattr(v, "year") else str(v))
        out[c] = s
    df = pd.DataFrame(out)
    return df.sort_values(list(df.columns), na_position="last").reset_index(drop=True) if len(df.columns) else df


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = normal(got), normal(want)
    for c in a.columns:
        if pd.api.types.is_numeric_dtype(a[c]) and pd.api.types.is_numeric_dtype(b[c]):
            bad = ~(((a[c] - b[c]).abs() < 2e-6) | (a[c].isna() & b[c].isna()))
        else:
            bad = ~((a[c].astype(str) == b[c].astype(str)) | (a[c].isna() & b[c].isna()))
        if bad.any():
            i = bad.idxmax()
            return f"{int(bad.sum())} of {len(a)} differ in {c}: {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return None


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = args or list(QUERIES)
    spark, con = local_session(8), connect(sf)
    failed = []
    for name in names:
        t = time.time()
        try:
            got = QUERIES[name](spark, sf).toPandas()
            took = time.time() - t
            if name not in ORACLES:
                print(f"rows  {name:32s} {len(got):7d} rows {took:6.2f}s", flush=True)
                continue
            t = time.time()
            problem = difference(got, con.execute(ORACLES[name]).fetchdf())
            print(f"{'FAIL' if problem else 'ok  '}  {name:32s} {len(got):7d} rows {took:6.2f}s duck {time.time() - t:5.2f}s {problem or ''}", flush=True)
        except Exception as e:
            problem = str(e).split("JVM stacktrace")[0][:600]
            print(f"ERR   {name}: {problem}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if problem:
            failed.append(name)
        problem = None
    print("failed:", failed)


if __name__ == "__main__":
    main()
