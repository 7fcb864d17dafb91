"""Query registry: a Spark callable and, where SQL can say it, an equivalent text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, text: str) -> None:
    CTES[name] = text.strip()


def compose(select: str) -> str:
    """Prepend the named common tables a statement uses, dependencies first."""
    order: list[str] = []

    def need(text: str, seen: tuple = ()) -> None:
        for name in CTES:
            if name in seen or name in order:
                continue
            if re.search(rf"\b{name}\b", text):
                need(CTES[name], (*seen, name))
                if name not in order:
                    order.append(name)

    need(select)
    if not order:
        return select
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    return f"WITH RECURSIVE {head}\n{select}"


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``covers`` lists survey ids."""

    def deco(fn):
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


def us(c: str | Column) -> Column:
    """Timestamps leave queries as epoch microseconds."""
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def r6(c: str | Column, digits: int = 6) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def big(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def out(df: DataFrame, *cols) -> DataFrame:
    """Project to plain types: ints to bigint, dates to text, decimals to double."""
    if cols:
        df = df.select(*cols)
    fixed = []
    for f in df.schema.fields:
        t, c = f.dataType.simpleString(), F.col(f.name)
        if t in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif t.startswith("decimal"):
            c = F.round(c.cast("double"), 6)
        elif t == "date":
            c = c.cast("string")
        elif t == "timestamp":
            c = F.unix_micros(c)
        elif t == "double":
            c = F.round(c, 6)
        fixed.append(c.alias(f.name))
    return df.select(*fixed)
