"""Run registered queries against their SQL in DuckDB. ``python -m tests.compare [sf_dir] [name ...]``"""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time

import duckdb

from smeltery.sources.adapter import RAW

ALL_RAW = (*RAW, "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
KINDS = {
    "tinyint": "TINYINT",
    "smallint": "SMALLINT",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
    "float": "FLOAT",
    "binary": "BLOB",
    "array<string>": "VARCHAR[]",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in ALL_RAW:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.9g}" if abs(float(value)) > 1e-12 else "0"
    if isinstance(value, int):
        return f"{value}"
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def compare(con, spark, sf_dir: str, fn, sql: str) -> list[str]:
    """Problems found; empty when schema and rows agree."""
    df = fn(spark, sf_dir)
    got = df.collect()
    names = sorted(df.columns)
    kinds = {n: KINDS.get(k, k) for n, k in df.dtypes}
    rel = con.execute(sql)
    described = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    wanted_names = [d[0] for d in rel.description]
    problems = []
    if sorted(wanted_names) != names:
        return [f"columns {names} vs {sorted(wanted_names)}"]
    for n in names:
        if kinds[n].upper() != described[n].upper():
            problems.append(f"type {n}: {kinds[n]} vs {described[n]}")
    spot = {n: i for i, n in enumerate(wanted_names)}
    a = sorted(tuple(_plain(r[n]) for n in names) for r in got)
    b = sorted(tuple(_plain(r[spot[n]]) for n in names) for r in want)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} vs {len(b)}")
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        problems.append(f"values ({names})\n   spark {only_a}\n   sql   {only_b}")
    return problems


def main() -> int:
    import __spark_entry__ as entry
    from tests.conftest import make_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = make_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        start = time.time()
        try:
            if name in oracles:
                problems = compare(con, spark, sf_dir, fn, oracles[name])
                note = "ok"
            else:
                problems, note = [], f"rows only: {fn(spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:700]}"]
        took = time.time() - start
        if problems:
            bad += 1
            print(f"BAD  {name} {took:.1f}s\n   " + "\n   ".join(problems), flush=True)
        else:
            print(f"good {name} {took:.1f}s {note}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
