"""Runs queries beside their SQL, as the driver does: `python -m tests.oracle [--sf DIR] NAME...`."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path if path.is_file() else f'{path}/*.parquet'}')")
    return con


def plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return str(value) if hasattr(value, "isoformat") or type(value).__name__ == "Decimal" else value


def rows_of(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, folder: str, name: str, query, sql: str | None) -> str:
    began = time.time()
    df = query(spark, folder)
    ours = df.collect()
    took = f"{len(ours)} rows, {time.time() - began:.1f} s"
    if sql is None:
        return f"ok (no SQL) {took}"
    result = views(folder).sql(sql)
    if sorted(result.columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} against {sorted(result.columns)}"
    a, b = rows_of(df.columns, ours), rows_of(result.columns, result.fetchall())
    if a != b:
        only, missing = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"DIFFERENT {len(a)} and {len(b)} rows; ours {only}; theirs {missing}"
    return f"ok {took}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tracewood.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args[:1] == ["--sf"] and args.pop(0) else "/root/testdata/sf0.01"
    queries, sql = entry.queries(), entry.oracle_sql()
    spark = local_session(8)
    for name in [n for n in queries if not args or any(n == a or a.endswith("*") and n.startswith(a[:-1]) for a in args)]:
        try:
            print(name, compare(spark, folder, name, queries[name], sql.get(name)), flush=True)
        except Exception as e:  # noqa: BLE001 - one query's failure must not hide the others
            print(name, "ERROR", str(e)[:1500], flush=True)
