"""Registered core queries and the SQL that checks them."""

from __future__ import annotations

import re

from ..session import Engine

QUERIES = {}
ORACLE = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def register(name, sql):
    """Decorator: adds a query together with its oracle SQL (None: not expressible)."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def engine(spark, sf_dir, text: str) -> Engine:
    """An engine with the tables that text names."""
    e = Engine(spark)
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            e.add_table(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    return e


def dialect(name, text, sql=None, types=None):
    """Adds a query in the SQL dialect; sql is its oracle where DuckDB words it otherwise,
    types the casts of columns whose integers DuckDB makes wider."""
    if types:
        casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in types.items())
        sql = f"SELECT * REPLACE ({casts}) FROM ({sql or text})"

    def run(spark, sf_dir):
        return engine(spark, sf_dir, text).sql(text)

    register(name, sql or text)(run)


from . import graph_queries, operator_queries, sql_queries  # noqa: E402, F401
