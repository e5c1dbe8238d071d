"""Registration of queries together with their SQL text.

``cols`` lists the output columns with a one-letter type: ``l`` BIGINT, ``d`` DOUBLE
(rounded to 6 places), ``s`` VARCHAR, ``b`` BOOLEAN. The same list shapes both sides, so
names, types and rounding always agree.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship_package
from .fixtures import Fixtures
from .sql_tables import SQL_TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SPARK_TYPES = {"l": "bigint", "d": "double", "s": "string", "b": "boolean"}
_SQL_TYPES = {"l": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN"}


def _columns(cols: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in cols.split()]


def shape(df: DataFrame, cols: str) -> DataFrame:
    out = []
    for name, kind in _columns(cols):
        c = F.col(name).cast(_SPARK_TYPES[kind])
        if kind == "d":
            c = F.round(c, 6) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def with_tables(body: str) -> str:
    """Prefix ``body`` with the derived tables it mentions, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, definition in SQL_TABLES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(definition)
                if name not in needed:
                    needed.append(name)

    visit(body)
    order = [n for n in SQL_TABLES if n in needed]
    if not order:
        return body
    ctes = ", ".join(f"{n} AS ({SQL_TABLES[n].strip()})" for n in order)
    return f"WITH {ctes} {body.strip()}"


def sql_text(body: str, cols: str) -> str:
    picked = []
    for name, kind in _columns(cols):
        c = f"CAST({name} AS {_SQL_TYPES[kind]})"
        if kind == "d":
            c = f"round({c}, 6) + 0.0"
        picked.append(f"{c} AS {name}")
    return with_tables(f"SELECT {', '.join(picked)} FROM ({body.strip()}) AS result_rows")


def query(name: str, cols: str, sql: str | None = None):
    """Register ``fn(fixtures) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Fixtures], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return shape(fn(Fixtures(spark, sf_dir)), cols)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql_text(sql, cols)
        return fn

    return register
