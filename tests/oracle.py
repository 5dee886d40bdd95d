"""Run registered queries and compare them with their DuckDB SQL.

python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def bag(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when both give the same rows, else a short account of the difference."""
    got_columns, got = bag(df.columns, df.collect())
    found = con.execute(sql)
    want_columns, want = bag([d[0] for d in found.description], found.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got != want:
        more, less = got - want, want - got
        return (
            f"{sum(got.values())} rows, wanted {sum(want.values())}\n  only Spark: {list(more.items())[:2]}\n"
            f"  only DuckDB: {list(less.items())[:2]}"
        )
    return None


def main() -> None:
    import __spark_entry__ as entry
    from shelfmark.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        started = time.time()
        try:
            df = queries[name](spark, folder)
            told = difference(df, con, sql[name]) if name in sql else f"no SQL, {len(df.collect())} rows"
        except Exception as e:  # noqa: BLE001 - reported below
            told = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += told is not None and not told.startswith("no SQL")
        print(f"{'ok' if told is None else told[:1800]:40s} {name} {time.time() - started:.1f}s", flush=True)
    print(f"{bad} different")


if __name__ == "__main__":
    main()
