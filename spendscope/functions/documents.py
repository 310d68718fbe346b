"""Columns that hold JSON text, read as VARIANT: what is not JSON is NULL and can be told apart from what is absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: str | Column) -> Column:
    return F.try_parse_json(F.col(text) if isinstance(text, str) else text)


def field(document: Column, path: str, kind: str = "string") -> Column:
    """The value at a path such as ``$.changes[0].level``; NULL where it is missing, JSON null or of another kind."""
    return F.try_variant_get(document, path, kind)


def is_broken(text: str | Column) -> Column:
    """There is text, but it is no JSON."""
    c = F.col(text) if isinstance(text, str) else text
    return c.isNotNull() & parsed(c).isNull()
