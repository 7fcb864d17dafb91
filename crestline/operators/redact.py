"""Redaction of nested records: sensitive field names and known secret texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDACTED = "[REDACTED]"
# Field names whose value is always hidden.
SENSITIVE = re.compile(
    r"(authorization|api[-_]?key|api[-_]?token|token|secret|cookie|set-cookie|password|account[-_]?id|billing)", re.I
)
MIN_SECRET = 6


def _mask_text(c: Column, secrets: list[str]) -> Column:
    for s in secrets:
        c = F.replace(c, F.lit(s), F.lit(REDACTED))
    return c


def _redact(c: Column, t: T.DataType, secrets: list[str]) -> Column:
    if isinstance(t, T.StructType):
        fields = [
            (F.lit(REDACTED) if SENSITIVE.search(f.name) else _redact(c[f.name], f.dataType, secrets)).alias(f.name)
            for f in t.fields
        ]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _redact(x, t.elementType, secrets))
    if isinstance(t, T.MapType):
        return F.map_from_entries(
            F.transform(
                F.map_entries(c),
                lambda e: F.struct(
                    e["key"].alias("key"),
                    F.when(e["key"].rlike(f"(?i){SENSITIVE.pattern}"), F.lit(REDACTED))
                    .otherwise(_redact(e["value"], t.valueType, secrets).cast("string"))
                    .alias("value"),
                ),
            )
        )
    if isinstance(t, T.StringType):
        return _mask_text(c, secrets)
    return c


def redact(df: DataFrame, secrets: list[str] | None = None) -> DataFrame:
    """Every column redacted by its schema; secrets shorter than six characters are ignored."""
    usable = [s for s in (secrets or []) if len(s) >= MIN_SECRET]
    return df.select(
        *[
            (F.lit(REDACTED) if SENSITIVE.search(f.name) else _redact(F.col(f.name), f.dataType, usable)).alias(f.name)
            for f in df.schema.fields
        ]
    )
