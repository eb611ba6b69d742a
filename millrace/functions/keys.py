"""Business keys: pre-processed parts, concatenated, hashed or named."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, TimestampNTZType, TimestampType

from .dates import parse_date
from .hashing import name_uuid


def key_part(expression: str, kind: DataType | None = None) -> Column:
    """``column`` (upper-cased), ``format_date(column)`` or ``remove_mi(column)`` as key text; times are unix seconds."""
    m = re.fullmatch(r"(\w+)\((\w+)\)", expression.strip())
    name, column = (m[1], F.col(m[2])) if m else ("", F.col(expression.strip()))
    if name == "format_date":
        return F.date_format(parse_date(column.cast("string")), "yyyyMMdd")
    if name == "remove_mi":
        return F.regexp_replace(F.upper(column.cast("string")), r" [A-Z]$", "")
    if name:
        raise ValueError(f"unknown key function: {name}")
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.unix_seconds(column.cast("timestamp")).cast("string")
    return F.upper(column.cast("string"))


def composite_key(parts: list[str], separator: str = "") -> Column:
    """The parts that aren't null, joined; null when all are. Without a separator ("1", "11") equals ("11", "1")."""
    own = [key_part(p) for p in parts]
    return F.when(F.coalesce(*own).isNotNull(), F.concat_ws(separator, *own))


def domain_key(parts: list[str], algorithm: str = "none", namespace: str = "03847036-1ef4-4c24-8815-7aab5064c3ce", separator: str = "") -> Column:
    """The composite key itself (``none``), or its UUID version 5 (``sha1``) or 3 (``md5``)."""
    key = composite_key(parts, separator)
    if algorithm == "none":
        return key
    if algorithm not in ("sha1", "md5"):
        raise ValueError(f"unknown key algorithm: {algorithm}")
    return name_uuid(key, namespace, 5 if algorithm == "sha1" else 3)
