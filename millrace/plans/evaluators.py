"""Column evaluators: how one output column comes from an input row, or from a group.

Row evaluators: select, multi_select, value, eval, map, case, hash. Aggregates:
count, distinct_count, sum, min, max, avg. Three kinds need more than a column
and are made by the operators that use them: lookup (a join), avrg (the order
of rows) and map_reduce (aggregates of aggregates).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from ..functions.cleansing import cleanse
from ..functions.hashing import partition_of
from ..functions.keys import composite_key, domain_key, key_part
from .env import constant
from .expressions import Expr, cast, compile_expression, kind_of, literal, truth

Named = list[tuple[str, Column]]
AGGREGATES = ("count", "distinct_count", "sum", "min", "max", "avg", "avrg")


def _input(spec: dict[str, Any], schema: StructType) -> Expr:
    name = spec["expr"]
    if name not in schema.names:
        raise ValueError(f"unknown column: {name}")
    e = Expr(F.col(f"`{name}`"), kind_of(schema[name].dataType))
    return cast(e, spec["as_rdf_type"]) if spec.get("as_rdf_type") else e


def _mapped(spec: dict[str, Any], schema: StructType, env: dict[str, Any]) -> tuple[Column, Column]:
    """Cleansed, else the default, cast, translated; and where cleansing was in error."""
    m = spec.get("map_expr", {})
    x, error = F.col(f"`{spec['expr']}`").cast("string"), F.lit(False)
    if m.get("cleansing_function"):
        x, error = cleanse(m["cleansing_function"], x, m.get("argument", ""))
    if m.get("default") is not None:
        x = F.coalesce(x, literal(constant(str(m["default"]), env)).col.cast("string"))
    if m.get("code_values"):
        pairs = {k: v for k, v in m["code_values"].items() if k != "__DEFAULT__"}
        table = F.create_map(*(F.lit(y) for k, v in pairs.items() for y in (k, v))) if pairs else F.create_map()
        x = F.coalesce(F.try_element_at(table, x), F.lit(m["code_values"].get("__DEFAULT__")))
    if m.get("rdf_type"):
        x = cast(Expr(x, "string"), m["rdf_type"]).col
    return x, F.coalesce(error, F.lit(False))


def row_columns(spec: dict[str, Any], schema: StructType, env: dict[str, Any] | None = None) -> tuple[Named, Column | None]:
    """The named columns of a row evaluator, and where it is in error."""
    env, kind, name = env or {}, spec["type"], spec.get("name", "")
    if kind == "select":
        e = _input(spec, schema)
        return [(name, e.col)], e.error
    if kind == "multi_select":
        return [(name, F.array(*(_input({"expr": c, "as_rdf_type": spec.get("as_rdf_type")}, schema).col for c in spec["expr_array"])))], None
    if kind == "value":
        e = literal(constant(spec["expr"], env))
        return [(name, (cast(e, spec["as_rdf_type"]) if spec.get("as_rdf_type") else e).col)], None
    if kind == "eval":
        e = compile_expression(spec["eval_expr"], schema, env)
        return [(name, e.col)], e.error
    if kind == "map":
        x, error = _mapped(spec, schema, env)
        return [(name, x)], error
    if kind == "case":
        names = list(dict.fromkeys(t["name"] for c in [*spec["case_expr"], {"then": spec.get("else_expr", [])}] for t in c["then"]))
        out = {}
        for n in names:
            col = None
            for c in spec["case_expr"]:
                value = next((compile_expression(t["expr"], schema, env).col for t in c["then"] if t["name"] == n), F.lit(None))
                when = truth(compile_expression(c["when"], schema, env))
                col = F.when(when, value) if col is None else col.when(when, value)
            last = next((compile_expression(t["expr"], schema, env).col for t in spec.get("else_expr", []) if t["name"] == n), None)
            out[n] = col if last is None else col.otherwise(last)
        return list(out.items()), None
    if kind == "hash":
        return [(name, hashed(spec["hash_expr"], schema))], None
    raise ValueError(f"unknown column type: {kind}")


def hashed(h: dict[str, Any], schema: StructType) -> Column:
    """The partition, or domain key, of a ``hash_expr``."""
    given = [k for k in ("expr", "composite_expr", "domain_key") if h.get(k)]
    if len(given) != 1:
        raise ValueError("a hash needs one of expr, composite_expr and domain_key")
    spare = composite_key(h["alternate_composite_expr"]) if h.get("alternate_composite_expr") else None
    if h.get("domain_key"):
        return domain_key(h["domain_key"], h.get("algorithm", "none"))
    integer = False
    if h.get("expr"):
        plain = h["expr"] in schema.names
        integer = plain and isinstance(schema[h["expr"]].dataType, IntegralType)
        key = F.col(f"`{h['expr']}`") if integer else key_part(h["expr"], schema[h["expr"]].dataType if plain else None)
    else:
        key = composite_key(h["composite_expr"])
    if spare is not None:
        key, integer = F.coalesce(key.cast("string"), spare), False
    return partition_of(key, h["nbr_partitions"], integer)


def aggregate(spec: dict[str, Any], schema: StructType, env: dict[str, Any] | None = None) -> Column:
    """One aggregate; ``where`` limits its rows. ``avrg`` isn't one: it depends on the order of rows (``transforms.blended``)."""
    kind, where = spec["type"], truth(compile_expression(spec["where"], schema, env)) if spec.get("where") else F.lit(True)
    if kind == "count":
        own = where if spec["expr"] == "*" else where & F.col(f"`{spec['expr']}`").isNotNull()
        return F.nullif(F.count_if(own), F.lit(0).cast("long"))
    x = values_of(spec, schema, env)
    if kind == "distinct_count":
        return F.count_distinct(x.cast("string"))
    if kind == "sum":
        return F.sum(x.try_cast("double") if _input(spec, schema).kind == "string" else x)
    if kind in ("min", "max", "avg"):
        return getattr(F, kind)(x)
    raise ValueError(f"unknown aggregate: {kind}")


def values_of(spec: dict[str, Any], schema: StructType, env: dict[str, Any] | None = None) -> Column:
    """The values that an aggregate takes: null where its ``where`` doesn't hold."""
    where = truth(compile_expression(spec["where"], schema, env)) if spec.get("where") else F.lit(True)
    return F.when(where, _input(spec, schema).col)
