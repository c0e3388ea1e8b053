"""Compare registered queries with their SQL counterparts in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


SPLIT = [0.0, 0.0]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else float(f"{value:.10g}")
    if isinstance(value, decimal.Decimal):
        return float(value) if value % 1 else int(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(frame, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    start = time.time()
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    middle = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows(names, cursor.fetchall())
    SPLIT[:] = [middle - start, time.time() - middle]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for mine, other in zip(got, want):
        if mine != other:
            return f"first difference {mine} against {other}"
        for a, b in zip(mine, other):
            if type(a) is not type(b):
                return f"types {type(a)} against {type(b)} in {mine}"
    return None


def main(folder: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from stowfind.session import local_session

    spark = local_session()
    con = connect(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, function in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            frame = function(spark, folder)
            if name in sql:
                problem = compare(frame, con, sql[name])
            else:
                problem = None if frame.count() else "no rows"
        except Exception as failure:  # noqa: BLE001 - report and go on
            problem = f"{type(failure).__name__}: {str(failure)[:1500]}"
        bad += problem is not None
        print(f"{name:32s} {time.time() - start:6.2f}s ({SPLIT[0]:.2f} + {SPLIT[1]:.2f}) {'ok' if problem is None else problem}"
              f"{'' if name in sql else ' (rows only)'}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
