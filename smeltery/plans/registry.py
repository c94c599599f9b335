"""Named queries: each takes the test tables and pairs with SQL over the same inputs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from smeltery.sources.adapter import PORTABLE, RAW, TestTables, plain_sql

QUERIES: dict[str, Callable[[TestTables], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Helper tables of the SQL side: name to SELECT text.
SQL_TABLES: dict[str, str] = {}

_WORD = re.compile(r"\b[a-z_0-9]+\b")


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` and the SQL it must equal."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def sql_table(name: str, text: str) -> None:
    if name in SQL_TABLES or name in PORTABLE:
        raise ValueError(f"two SQL tables named {name}")
    SQL_TABLES[name] = text


def _body(name: str) -> str:
    return SQL_TABLES[name] if name in SQL_TABLES else plain_sql(name)


def with_inputs(text: str) -> str:
    """Put every derived table the text names in front of it, parents first."""
    known = set(SQL_TABLES) | set(PORTABLE)
    order: list[str] = []
    open_names: set[str] = set()

    def visit(sql: str) -> None:
        for word in _WORD.findall(sql):
            if word in known and word not in order and word not in RAW and word not in open_names:
                open_names.add(word)
                visit(_body(word))
                order.append(word)

    visit(text)
    if not order:
        return text
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({_body(name)})" for name in order)
    inner = text.lstrip()
    if inner.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{inner[15:]}"
    if inner.upper().startswith("WITH "):
        return f"WITH {ctes},\n{inner[5:]}"
    return f"WITH {ctes}\n{text}"


def present(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so both engines compare in the same type."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(QUERIES[name](TestTables(spark, sf_dir)))

    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runnable(name) for name in QUERIES}


def all_oracles() -> dict[str, str]:
    return {name: with_inputs(text) for name, text in ORACLES.items()}
