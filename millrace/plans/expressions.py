"""Expression trees compiled to column expressions.

A node is one of

    {"value": "..."}             a constant, see ``env.constant``
    {"select": "column"}         a column; {"select_pos": k} by position
    {"static_list": [...]}       a list for IN
    {"function": "CURRENT_YEAR"}
    {"op": "...", "arg": node}   an operator of one
    {"op": "...", "lhs": node, "rhs": node}  or of two operands

and may have ``as_rdf_type`` (a cast) and ``default`` (a node taken where the
operator is in error; a null that is no error stays null). Truth is the
integer 0 or 1, never null: a comparison with null is 0, and so is NOT NULL.
Types are static, so coercions are chosen while compiling.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, NumericType, FractionalType, StringType, StructType, TimestampNTZType, TimestampType

from ..functions.cleansing import java_regex
from ..functions.dates import distance_months, parse_date, parse_datetime
from .env import constant



@dataclass(frozen=True)
class Expr:
    """A column, its kind (string, int, double, date, timestamp, array, null) and where it is in error."""

    col: Column
    kind: str
    error: Column | None = None
    values: tuple = ()


def kind_of(t: DataType) -> str:
    if isinstance(t, StringType):
        return "string"
    if isinstance(t, FractionalType):
        return "double"
    if isinstance(t, (NumericType, BooleanType)):
        return "int"
    if isinstance(t, DateType):
        return "date"
    if isinstance(t, (TimestampType, TimestampNTZType)):
        return "timestamp"
    return "array" if isinstance(t, ArrayType) else "null"


def either(*errors: Column | None) -> Column | None:
    found = [e for e in errors if e is not None]
    out = found[0] if found else None
    for e in found[1:]:
        out = out | e
    return out


def literal(v: Any) -> Expr:
    if v is None:
        return Expr(F.lit(None).cast("string"), "null")
    if isinstance(v, bool):
        return Expr(F.lit(int(v)), "int")
    return Expr(F.lit(v), {str: "string", int: "int", float: "double"}.get(type(v), "string"))


# --- casts ------------------------------------------------------------------

RDF_TYPES = {
    "text": "string", "string": "string", "resource": "string", "date": "date", "datetime": "timestamp", "double": "double", "float64": "double",
    "int": "int", "integer": "int", "int64": "int", "long": "int", "uint": "int", "uint64": "int", "ulong": "int", "bool": "bool",
}


def cast(e: Expr, rdf_type: str) -> Expr:
    to = RDF_TYPES.get(rdf_type)
    if to is None:
        raise ValueError(f"unknown type: {rdf_type}")
    c = e.col
    if to == "string":
        if e.kind == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        return Expr(F.nullif(F.trim(c.cast("string")), F.lit("")), "string", e.error)
    if to == "date":
        return Expr(parse_date(c) if e.kind == "string" else c.cast("date"), "date", e.error)
    if to == "timestamp":
        return Expr(parse_datetime(c) if e.kind == "string" else c.cast("timestamp"), "timestamp", e.error)
    if to == "double":
        return Expr(c.try_cast("double"), "double", e.error)
    if to == "bool":
        true = F.lower(F.trim(c)).isin("true", "t", "1") if e.kind == "string" else c > 0
        return Expr(F.when(c.isNotNull(), true.cast("int")), "int", e.error)
    if e.kind in ("date", "timestamp"):
        return Expr(F.unix_millis(c.cast("timestamp")), "int", e.error)
    if e.kind == "string":
        c = F.trim(c).try_cast("double")
    return Expr(F.when(~F.isnan(c.cast("double")), c.try_cast("long")) if e.kind in ("string", "double") else c.cast("long"), "int", e.error)


# --- operators --------------------------------------------------------------


def _flag(condition: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), 1).otherwise(0)


def _number(e: Expr) -> tuple[Column, Column | None]:
    """As a number; a text that is none is an error."""
    if e.kind == "string":
        n = F.trim(e.col).try_cast("double")
        return n, either(e.error, e.col.isNotNull() & n.isNull())
    return e.col, e.error


def _pair(a: Expr, b: Expr) -> tuple[Column, Column, str, Column | None]:
    """Both sides in one kind."""
    kinds = {a.kind, b.kind}
    if kinds & {"date", "timestamp"}:
        to = "timestamp" if "timestamp" in kinds else "date"
        x, y = ((parse_datetime(e.col) if to == "timestamp" else parse_date(e.col)) if e.kind == "string" else e.col.cast(to) for e in (a, b))
        bad = [e.col.isNotNull() & v.isNull() for e, v in ((a, x), (b, y)) if e.kind == "string"]
        return x, y, to, either(a.error, b.error, *bad)
    if kinds & {"int", "double"}:
        x, bad_x = _number(a)
        y, bad_y = _number(b)
        return x, y, "int" if kinds == {"int"} else "double", either(bad_x, bad_y)
    return a.col, b.col, "string", either(a.error, b.error)


def _near(x: Column, y: Column) -> Column:
    """Equal within a part in 10^10."""
    return (x == y) | (F.abs(x - y) <= F.greatest(F.abs(x), F.abs(y)) * 1e-10)


def _equal(a: Expr, b: Expr) -> Expr:
    x, y, kind, bad = _pair(a, b)
    return Expr(_flag(_near(x, y) if kind == "double" else x == y), "int", bad)


def _unequal(a: Expr, b: Expr) -> Expr:
    e = _equal(a, b)
    return Expr(_flag(a.col.isNotNull() & b.col.isNotNull() & (e.col == 0)), "int", e.error)


def _ordered(f: Callable[[Column, Column], Column]) -> Callable[[Expr, Expr], Expr]:
    def op(a: Expr, b: Expr) -> Expr:
        x, y, _, bad = _pair(a, b)
        return Expr(_flag(f(x, y)), "int", bad)

    return op


def truth(e: Expr) -> Column:
    """TRUE as text, numbers over 0; null is no truth."""
    return F.coalesce(F.upper(e.col) == "TRUE" if e.kind == "string" else e.col > 0, F.lit(False)) if e.kind != "null" else F.lit(False)


def _is(a: Expr, b: Expr) -> Expr:
    both_nan = F.isnan(a.col) & F.isnan(b.col) if a.kind == b.kind == "double" else F.lit(False)
    return Expr(_flag((a.col.isNull() & b.col.isNull()) | both_nan), "int", either(a.error, b.error))


def _logic(f: Callable[[Column, Column, Expr, Expr], Column]) -> Callable[[Expr, Expr], Expr]:
    return lambda a, b: Expr(_flag(f(truth(a), truth(b), a, b)), "int", either(a.error, b.error))


def _plus(a: Expr, b: Expr) -> Expr:
    for x, y in ((a, b), (b, a)):
        if x.kind in ("date", "timestamp") and y.kind in ("int", "string"):
            days = y.col.try_cast("int") if y.kind == "string" else y.col.cast("int")
            moved = F.date_add(x.col, days) if x.kind == "date" else x.col + F.make_dt_interval(days)
            return Expr(moved, x.kind, either(a.error, b.error))
    if a.kind == b.kind == "string":
        return Expr(F.concat(a.col, b.col), "string", either(a.error, b.error))
    x, y, kind, bad = _pair(a, b)
    return Expr(F.try_add(x, y), kind, bad)


def _minus(a: Expr, b: Expr) -> Expr:
    if a.kind in ("date", "timestamp") and b.kind in ("int", "string"):
        days = b.col.try_cast("int") if b.kind == "string" else b.col.cast("int")
        return Expr(F.date_sub(a.col, days) if a.kind == "date" else a.col - F.make_dt_interval(days), a.kind, either(a.error, b.error))
    x, bx = _number(a)
    y, by = _number(b)
    return Expr(F.try_subtract(x, y), "int" if a.kind == b.kind == "int" else "double", either(bx, by))


def _times(a: Expr, b: Expr) -> Expr:
    x, bx = _number(a)
    y, by = _number(b)
    return Expr(F.try_multiply(x, y), "int" if a.kind == b.kind == "int" else "double", either(bx, by))


def _over(a: Expr, b: Expr) -> Expr:
    x, bx = _number(a)
    y, by = _number(b)
    y = y.cast("double")
    return Expr(F.when(F.abs(y) < 1e-10, F.when(x.isNotNull(), F.lit(float("nan")))).otherwise(F.try_divide(x.cast("double"), y)), "double", either(bx, by))


def _in(fold: bool) -> Callable[[Expr, Expr], Expr]:
    def op(a: Expr, b: Expr) -> Expr:
        if b.kind != "list":
            raise ValueError("IN needs a static_list")
        own = [v.upper() if fold and isinstance(v, str) else v for v in b.values]
        own = [str(v) for v in own] if a.kind == "string" else [v for v in own if isinstance(v, (int, float))]
        return Expr(_flag((F.upper(a.col) if fold and a.kind == "string" else a.col).isin(own)), "int", a.error)

    return op


def _format(a: Expr, b: Expr) -> Expr:
    how = b.values[0]
    if a.kind in ("date", "timestamp") and "%" not in how:
        return Expr(F.date_format(a.col, how), "string", a.error)
    if a.kind in ("date", "timestamp"):
        parts = [f(a.col) for f in (F.year, F.month, F.dayofmonth)][: how.count("%")]
        return Expr(F.when(a.col.isNotNull(), F.format_string(how, *parts)), "string", a.error)
    return Expr(F.when(a.col.isNotNull(), F.format_string(how, a.col)), "string", a.error)


def _array(a: Expr, b: Expr) -> Expr:
    x, y = (e.col if e.kind == "array" else F.array(e.col.cast("string")) for e in (a, b))
    return Expr(F.when(a.col.isNotNull() & b.col.isNotNull(), F.concat(x, y)), "array", either(a.error, b.error))


def _to_date(a: Expr) -> Expr:
    if a.kind == "string":
        d = parse_date(a.col)
        return Expr(d, "date", either(a.error, a.col.isNotNull() & d.isNull()))
    if a.kind in ("int", "double"):
        return Expr(F.timestamp_seconds(a.col), "timestamp", a.error)
    return a


BINARY: dict[str, Callable[[Expr, Expr], Expr]] = {
    "==": _equal,
    "!=": _unequal,
    "IS": _is,
    "IS NOT": lambda a, b: Expr(1 - _is(a, b).col, "int", either(a.error, b.error)),
    "<": _ordered(lambda x, y: x < y),
    "<=": _ordered(lambda x, y: x <= y),
    ">": _ordered(lambda x, y: x > y),
    ">=": _ordered(lambda x, y: x >= y),
    "AND": _logic(lambda x, y, a, b: x & y),
    "OR": _logic(lambda x, y, a, b: (x | (y & b.col.isNotNull())) & a.col.isNotNull()),
    "+": _plus,
    "-": _minus,
    "*": _times,
    "/": _over,
    "IN": _in(False),
    "IN_NO_CASE": _in(True),
    "DISTANCE_MONTHS": lambda a, b: Expr(distance_months(*(parse_date(e.col) if e.kind == "string" else e.col for e in (a, b))), "int", either(a.error, b.error)),
    "APPLY_FORMAT": _format,
    "APPLY_REGEX": lambda a, b: Expr(F.regexp_substr(a.col.cast("string"), F.lit(java_regex(b.values[0]))), "string", a.error),
    "FIND_AND_REPLACE": lambda a, b: Expr(F.replace(a.col.cast("string"), F.lit(b.values[0]), F.lit(b.values[1])), "string", a.error),
    "TO_ARRAY": _array,
}
UNARY: dict[str, Callable[[Expr], Expr]] = {
    "NOT": lambda a: Expr(_flag(a.col.isNotNull() & ~truth(a)), "int", a.error),
    "ABS": lambda a: Expr(F.coalesce(F.abs(_number(a)[0]), F.lit(0)), "double" if a.kind != "int" else "int", _number(a)[1]),
    "LENGTH": lambda a: Expr(F.coalesce(F.octet_length(a.col.cast("string")), F.lit(0)), "int", a.error),
    "NEW_UUID": lambda a: Expr(F.expr("uuid()"), "string"),
    "TO_DATE": _to_date,
}


def compile_expression(node: dict[str, Any], schema: StructType, env: dict[str, Any] | None = None) -> Expr:
    env = env or {}
    if "proxy" in node:
        return compile_expression(env[node["proxy"].lstrip("$")], schema, env)
    if "value" in node:
        e = literal(constant(node["value"], env))
        e = Expr(e.col, e.kind, e.error, (constant(node["value"], env),))
    elif "select" in node or "select_pos" in node:
        name = schema.names[node["select_pos"]] if "select_pos" in node else str(env.get(node["select"].lstrip("$"), node["select"]) if node["select"].startswith("$") else node["select"])
        if name not in schema.names:
            if "default" in node:
                return compile_expression(node["default"], schema, env)
            raise ValueError(f"unknown column: {name}")
        t = schema[name].dataType
        e = Expr(F.col(f"`{name}`").cast("int") if isinstance(t, BooleanType) else F.col(f"`{name}`"), kind_of(t))
    elif "static_list" in node:
        return Expr(F.lit(None), "list", None, tuple(constant(v, env) for v in node["static_list"]))
    elif "function" in node:
        if node["function"] != "CURRENT_YEAR":
            raise ValueError(f"unknown function: {node['function']}")
        e = Expr(F.year(F.current_date()), "int")
    elif node.get("op") in UNARY and "arg" in node:
        e = UNARY[node["op"]](compile_expression(node["arg"], schema, env))
    elif node.get("op") in BINARY:
        e = BINARY[node["op"]](compile_expression(node["lhs"], schema, env), compile_expression(node["rhs"], schema, env))
    else:
        raise ValueError(f"unknown expression: {node}")
    if "as_rdf_type" in node:
        e = cast(e, node["as_rdf_type"])
    if "default" in node and e.error is not None:
        d = compile_expression(node["default"], schema, env)
        e = Expr(F.when(F.coalesce(e.error, F.lit(False)), d.col).otherwise(e.col), e.kind, d.error)
    return e


def predicate(node: dict[str, Any], schema: StructType, env: dict[str, Any] | None = None) -> Column:
    """A filter condition that keeps Catalyst's pushdown: conjunctions of comparisons of columns with constants stay plain."""
    if node.get("op") == "AND":
        return predicate(node["lhs"], schema, env) & predicate(node["rhs"], schema, env)
    plain = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "==": "__eq__"}
    if node.get("op") in plain and "default" not in node:
        a, b = (compile_expression(node[k], schema, env) for k in ("lhs", "rhs"))
        if a.kind == b.kind and a.kind in ("int", "string", "date") or {a.kind, b.kind} <= {"int", "double"} and node["op"] != "==":
            return getattr(a.col, plain[node["op"]])(b.col)
    return truth(compile_expression(node, schema, env))
