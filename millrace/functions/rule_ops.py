"""The operators of rule filters and consequents, as column functions by name.

Truth is 0 or 1. Numbers are longs or doubles by their column's type; ``as
int`` operators round towards zero. Multi-valued properties are arrays. Seeds
of name-based UUIDs are parameters. Look-ups are joins (``transforms.lookup``
for one row, ``multi_lookup`` for all).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dates
from .cleansing import amount_text, java_regex
from .hashing import name_uuid

#: Fixed value: the default seed of name-based UUIDs.
SEED = "03847036-1ef4-4c24-8815-7aab5064c3ce"


def flag(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)


def truth(c: Column) -> Column:
    return F.coalesce(c.cast("double") > 0, F.lit(False))


def near(a: Column, b: Column) -> Column:
    """Equal doubles within a part in 10^10."""
    return (a == b) | (F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * 1e-10)


def equal(a: Column, b: Column) -> Column:
    """Equal, doubles nearly so."""
    double = F.typeof(a).isin("double", "float") | F.typeof(b).isin("double", "float")
    return (a == b) | (double & near(a.cast("string").try_cast("double"), b.cast("string").try_cast("double")))


def add(a: Column, b: Column, text: bool = False) -> Column:
    """The sum; with ``text`` one text after the other."""
    return F.concat(a.cast("string"), b.cast("string")) if text else F.try_add(a, b)


def whole(x: Column) -> Column:
    """Cut towards zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")


def apply_format(x: Column, how: str) -> Column:
    """A number by a printf pattern, a date or time by a date pattern."""
    if "%" in how:
        return F.format_string(how, x)
    return F.date_format(x.cast("timestamp"), how)


def divide(a: Column, b: Column, integers: bool = False) -> Column:
    """Integers divide to integers; by zero is NaN."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    q = F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("double") if integers else q
    return F.when(F.abs(b.cast("double")) < 1e-10, F.when(a.isNotNull(), F.lit(float("nan")))).otherwise(q)


def substring_of(x: Column, start: int, length: int) -> Column:
    """Bytes from ``start``; a negative length leaves so many off the end."""
    size = F.octet_length(x)
    n = F.least(size - start, F.lit(length)) if length >= 0 else size - start + length
    return F.when(n > 0, F.decode(F.substring(F.encode(x, "UTF-8"), F.lit(start + 1), n), "UTF-8")).otherwise(F.when(x.isNotNull(), ""))


def replace_chars(x: Column, chars: str, new: str) -> Column:
    return F.regexp_replace(x, "[" + "".join(f"\\{c}" if not c.isalnum() else c for c in chars) + "]", F.lit(new.replace("\\", "\\\\").replace("$", "\\$")))


def head_of(objects: Column, values: Column, least: bool) -> Column:
    """The object whose value is least, or greatest; ties go to the earlier."""
    best = F.array_min(values) if least else F.array_max(values)
    return F.get(F.filter(objects, lambda o, i: F.get(values, i) == best), F.lit(0))


def sum_values(values: Column, compat: bool = False) -> Column:
    """The sum; ``compat`` cuts each addend to an integer, as a sum that starts from an integer does."""
    start, kind = (F.lit(0).cast("long"), "long") if compat else (F.lit(0.0), "double")
    return F.aggregate(values, start, lambda s, v: s + v.cast(kind))


def _is_resource(x: Column) -> Column:
    """A resource is a struct with one field ``resource`` (``create_resource``); all else is a literal."""
    return F.typeof(x).startswith("struct<resource:")


def resource(x: Column) -> Column:
    return F.struct(x.cast("string").alias("resource"))


BINARY: dict[str, Callable[..., Column]] = {
    ">": lambda a, b: flag(a > b),
    ">=": lambda a, b: flag(a >= b),
    "<": lambda a, b: flag(a < b),
    "<=": lambda a, b: flag(a <= b),
    "==": lambda a, b: flag(equal(a, b)),
    "!=": lambda a, b: 1 - flag(equal(a, b)),
    "and": lambda a, b: flag(truth(a) & truth(b) & a.isNotNull() & b.isNotNull()),
    "or": lambda a, b: flag(truth(a) | truth(b)),
    "+": add,
    "-": lambda a, b: F.try_subtract(a, b),
    "*": lambda a, b: F.try_multiply(a, b),
    "/": divide,
    "min_of": lambda a, b=None: F.array_min(a) if b is None else F.least(a, b),
    "max_of": lambda a, b=None: F.array_max(a) if b is None else F.greatest(a, b),
    "min_head_of": lambda objects, values: head_of(objects, values, True),
    "max_head_of": lambda objects, values: head_of(objects, values, False),
    "sorted_head": lambda objects, values, operator="<": head_of(objects, values, operator == "<"),
    "sum_values": sum_values,
    "literal_regex": lambda x, pattern: F.regexp_extract(x, java_regex(pattern), 0),
    "apply_regex": lambda x, pattern: F.regexp_extract(x, java_regex(pattern), 0),
    "apply_format": apply_format,
    "contains": lambda x, y: flag(F.contains(x, y)),
    "starts_with": lambda x, y: flag(F.startswith(x, y)),
    "ends_with": lambda x, y: flag(F.endswith(x, y)),
    "substring_of": substring_of,
    "char_at": lambda x, k: F.substring(x, k + 1, F.lit(1)),
    "replace_char_of": replace_chars,
    "range": lambda start, count: F.slice(F.sequence(start, start + count), F.lit(1), F.greatest(count, F.lit(0)).cast("int")),
    "exist": lambda value, _=None: flag(value.isNotNull()),
    "exist_not": lambda value, _=None: flag(value.isNull()),
    "size_of": lambda values, _=None: F.coalesce(F.array_size(values), F.lit(0)),
    "age_as_of": dates.age,
    "age_in_months_as_of": dates.age_months,
}
UNARY: dict[str, Callable[..., Column]] = {
    "not": lambda a: flag(a.isNotNull() & ~truth(a)),
    "abs": F.abs,
    "to_upper": F.upper,
    "to_lower": F.lower,
    "trim": lambda x: F.regexp_replace(x, r"^[\s\u0085\u00a0]+|[\s\u0085\u00a0]+$", ""),
    "length_of": F.octet_length,
    "parse_usd_currency": amount_text,
    "uuid_md5": lambda x, seed=SEED: name_uuid(x, seed, 3),
    "uuid_sha1": lambda x, seed=SEED: name_uuid(x, seed, 5),
    "to_int": lambda x: x.try_cast("long"),
    "to_double": lambda x: x.try_cast("double"),
    "to_text": lambda x: x.cast("string"),
    "to_date": dates.parse_date,
    "to_datetime": dates.parse_datetime,
    "to_timestamp": lambda x: F.unix_seconds(x.cast("timestamp")),
    "month_period_of": dates.month_period,
    "week_period_of": dates.week_period,
    "day_period_of": lambda x, compat=False: dates.day_period(x, compat),
    "create_entity": lambda x: F.coalesce(F.nullif(x.cast("string"), F.lit("")), F.expr("uuid()")),
    "create_literal": lambda x: x,
    "create_resource": resource,
    "create_uuid_resource": lambda x=None: resource(F.expr("uuid()")),
    "is_null": lambda x: flag(x.isNull()),
    "is_literal": lambda x: flag(x.isNotNull() & ~_is_resource(x)),
    "is_resource": lambda x: flag(x.isNotNull() & _is_resource(x)),
    "raise_exception": lambda x: F.raise_error(x),
}


def multi_lookup(df: DataFrame, table: DataFrame, keys: list[str], table_keys: list[str], name: str = "found") -> DataFrame:
    """All rows of equal keys as an array; null where there are none."""
    own = table.groupBy(*(F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(table_keys))).agg(F.array_sort(F.collect_list(F.struct(*table.columns))).alias(name))
    keyed = df.select("*", *(F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(keys)))
    ks = [f"_k{i}" for i in range(len(keys))]
    return keyed.join(own, ks, "left").drop(*ks)


#: Operators whose second argument is a constant, not a column.
_CONSTANT = ("literal_regex", "apply_regex", "apply_format", "replace_char_of", "substring_of")


def compiled(node: object, at: Callable[[str], Column]) -> Column:
    """A filter or consequent from a configuration: ``[operator, argument, ...]``, ``?variable``, ``'text'``, or a number."""
    if isinstance(node, (list, tuple)):
        name, *args = node
        if name not in BINARY and name not in UNARY:
            raise ValueError(f"unknown rule operator: {name}")
        first = compiled(args[0], at) if args else F.lit(None)
        if name in _CONSTANT:
            return BINARY[name](first, *args[1:])
        if name == "+" and any(isinstance(x, str) and x.startswith("'") for x in args):
            return add(*(compiled(x, at) for x in args), text=True)
        f = BINARY[name] if len(args) > 1 else UNARY.get(name) or BINARY[name]
        return f(first, *(compiled(x, at) for x in args[1:]))
    if isinstance(node, str):
        return at(node) if node.startswith("?") else F.lit(node.strip("'"))
    return F.lit(node)


def multi_lookup_rand(df: DataFrame, table: DataFrame, key: str, name: str = "found", seed: int | None = None) -> DataFrame:
    """All rows of a look-up table that have the key of a random row of it, for each row."""
    drawn = lookup_rand(df, table.select(key), "_drawn", seed).withColumn("_key", F.col(f"_drawn.{key}")).drop("_drawn")
    return multi_lookup(drawn, table, ["_key"], [key], name).drop("_key")


def lookup_rand(df: DataFrame, table: DataFrame, name: str = "found", seed: int | None = None) -> DataFrame:
    """A random row of a look-up table for each row."""
    n = table.count()
    if not n:
        return df.withColumn(name, F.lit(None))
    from ..operators.transforms import numbered

    own = numbered(table.withColumn("_h", F.xxhash64(*table.columns)), "_h", "_k").select(F.struct(*table.columns).alias(name), "_k")
    return df.withColumn("_k", F.floor(F.rand(seed) * n)).join(own, "_k", "left").drop("_k")
