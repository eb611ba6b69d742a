"""Structured queries and reports.

A query names its tables, columns, conditions, order, limit and offset; values
never become SQL text. Reports are named SQL statements with environment names
filled in as parameters.
"""

from __future__ import annotations

import re
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _condition(w: dict[str, Any]) -> Column:
    """{"column", and one of "in", "not_in", "like", "ge", "le", "eq", "join_with"}, or {"or": [...]}."""
    if "or" in w:
        out = F.lit(False)
        for x in w["or"]:
            out = out | _condition(x)
        return out
    c = F.col(w["column"])
    if "in" in w:
        return c.isin(list(w["in"]))
    if "not_in" in w:
        return ~c.isin(list(w["not_in"]))
    if "like" in w:
        return c.like(w["like"])
    if "ge" in w:
        return c >= F.lit(w["ge"])
    if "le" in w:
        return c <= F.lit(w["le"])
    if "join_with" in w:
        return c == F.col(w["join_with"])
    return c == F.lit(w["eq"])


def select(tables: dict[str, DataFrame], query: dict[str, Any]) -> DataFrame:
    """{"with": {name: query}, "from": [tables], "columns": [{"column", "as"}], "distinct_on", "where", "order_by", "limit", "offset"}."""
    tables = dict(tables)
    for name, q in query.get("with", {}).items():
        tables[name] = select(tables, q)
    conditions = list(query.get("where", []))
    names = query["from"]
    df = tables[names[0]].alias(names[0])
    for n in names[1:]:
        other = tables[n].alias(n)
        keys = [w for w in conditions if "join_with" in w and {w["column"].split(".")[0], w["join_with"].split(".")[0]} & {n}]
        on = F.lit(True)
        for w in keys:
            on = on & _condition(w)
            conditions.remove(w)
        if not keys:
            raise ValueError(f"{n} has no join condition")
        df = df.join(other, on)
    for w in conditions:
        df = df.where(_condition(w))
    order = [F.col(o["column"]).desc() if o.get("descending") else F.col(o["column"]).asc() for o in query.get("order_by", [])]
    if query.get("distinct_on"):
        df = df.withColumn("_n", F.row_number().over(W.partitionBy(*query["distinct_on"]).orderBy(*order))).where("_n = 1")
    if order:
        df = df.orderBy(*order)
    df = df.offset(query["offset"]) if query.get("offset") else df
    df = df.limit(query["limit"]) if query.get("limit") is not None else df
    return df.select(*(F.col(c["column"]).alias(c.get("as", c["column"].split(".")[-1])) for c in query["columns"]))


def report_statements(text: str) -> dict[str, str]:
    """Pairs of ``--name;`` and statement, separated by semicolons."""
    parts = [p.strip() for p in text.split(";") if p.strip()]
    out = {}
    for a, b in zip(parts[::2], parts[1::2], strict=False):
        if not a.startswith("--"):
            raise ValueError(f"not a report name: {a}")
        out[a[2:].strip()] = b
    return out


def report_name(template: str, env: dict[str, str], day: date) -> str:
    """``{NAME}`` from the environment, ``{D:YYYY_MM_DD}`` from the day."""
    fill = lambda m: day.strftime(m[1][2:].replace("YYYY", "%Y").replace("MM", "%m").replace("DD", "%d")) if m[1].startswith("D:") else str(env[m[1]])
    return re.sub(r"\{([^}]+)\}", fill, template)


def run_report(spark: SparkSession, statement: str, env: dict[str, Any]) -> DataFrame:
    """The statement with each ``$NAME`` passed as a parameter."""
    used = {n: env[n] for n in re.findall(r"\$(\w+)", statement) if n in env}
    return spark.sql(re.sub(r"\$(\w+)", lambda m: f":{m[1]}" if m[1] in used else m[0], statement), args=used)
