"""Query registry: a Spark callable per operator, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from earmark.plans.views import VIEWS

QUERIES: dict = {}
ORACLES: dict = {}


def with_views(body: str, *views: str) -> str:
    """Prefix ``body`` with the named views and what they depend on, as CTEs."""
    order: list[str] = []

    def add(name):
        needs, _ = VIEWS[name]
        for n in needs:
            add(n)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    ctes = ",\n".join(f"{v} AS ({VIEWS[v][1]})" for v in order)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None, *views: str):
    """Register ``fn(spark, sf_dir)`` under ``name``."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn
    return register


def tidy(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Doubles rounded, infinities as NULL, whole numbers as BIGINT."""
    out = []
    for f in df.schema:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            finite = ~(F.abs(c) == float("inf"))
            c = F.round(F.when(finite, c.cast("double")), decimals)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)
