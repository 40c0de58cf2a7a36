"""Run a catalog query on Spark and its SQL twin on DuckDB and compare the two results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def _kind(v):
    return {"bool": "bool", "int": "int", "float": "float", "str": "str"}.get(type(v).__name__, type(v).__name__)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else a short description."""
    names = sorted(spark_df.columns)
    left = [tuple(_plain(r[n]) for n in names) for r in spark_df.collect()]
    cur = con.execute(sql)
    got = [d[0] for d in cur.description]
    if sorted(got) != names:
        return f"columns {names} vs {sorted(got)}"
    at = [got.index(n) for n in names]
    right = [tuple(_plain(r[i]) for i in at) for r in cur.fetchall()]
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    key = lambda r: tuple((v is None, str(v)) for v in r)
    left.sort(key=key)
    right.sort(key=key)
    for a, b in zip(left, right):
        if a != b:
            return f"{names}: {a} vs {b}"
        if [_kind(x) for x in a] != [_kind(x) for x in b]:
            return f"types {names}: {a} vs {b}"
    return None


def main(patterns):
    from tests.conftest import make_session

    import __spark_entry__ as entry

    spark = make_session()
    queries, oracles = entry.queries(), entry.oracle_sql()
    sf = "/root/testdata/sf0.01"
    con = duck(sf)
    bad = 0
    for name, fn in queries.items():
        if patterns and not any(p in name for p in patterns):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                diff = difference(df, con, oracles[name])
            else:
                rows = df.collect()
                diff = None if rows else "no rows"
                print(f"   rows only: {len(rows)}, e.g. {str(rows[:1])[:150]}")
        except Exception as exc:  # noqa: BLE001
            diff = f"{type(exc).__name__}: {str(exc)[:1200]}"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name} {time.time() - t:.1f}s {(diff or '')[:1500]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
