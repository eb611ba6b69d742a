"""Anonymisation and de-identification of columns, with a crosswalk of keys.

Texts become prefixed FNV-1a hashes, dates the first of their month (or of
January for a date of birth or death), de-identified texts a row of a lookup
table or a hashed value. ``NULL`` and blank markers are null before anything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.hashing import fnv1a_hex, fnv1a_mod
from .transforms import numbered


@dataclass(frozen=True)
class Action:
    """``how``: text, date, date_to_jan1, dob, dod, hashed_value (alphanumeric_hashed_value), numeric_hashed_value, lookup, blank.

    A look-up table's rows have ``table_key`` 1, 2 and so on as text, or are
    numbered if it has none.
    """

    column: str
    how: str
    prefix: str = ""
    date_format: str = "yyyy-MM-dd"
    default_date: str | None = None
    cap_years: int | None = None
    table: DataFrame | None = None
    table_column: str = ""
    table_key: str = ""


def actions_from_metadata(columns: list[str], metadata: list[dict[str, str]], texts: set[str], dates: dict[str, str], deid_lookups: dict[str, DataFrame] | None = None, deid_functions: dict[str, str] | None = None, deid: bool = False, **more: object) -> list[Action]:
    """An action for each column whose classification asks for one.

    ``metadata`` is a profile, a row for each column: ``column_pos``,
    ``data_classification``, ``key_prefix``, ``date_format`` and
    ``numeric_pct``, the last three optional. ``texts`` are the classifications
    to hide, ``dates`` those to cut, with their rule. Hidden texts get a
    prefixed hash, or with ``deid`` a row of their classification's look-up
    table, its function's value (numeric where over 95 % of the values are), or
    nothing.
    """
    lookups, functions, out = deid_lookups or {}, deid_functions or {}, []
    for row in sorted(metadata, key=lambda r: int(r["column_pos"])):
        name, kind = columns[int(row["column_pos"])], row.get("data_classification")
        if kind in dates:
            out.append(Action(name, dates[kind], date_format=row.get("date_format") or "yyyy-MM-dd", **more))
        elif kind in texts and not deid:
            out.append(Action(name, "text", row.get("key_prefix") or ""))
        elif kind in texts and kind in lookups:
            table = lookups[kind]
            out.append(Action(name, "lookup", table=table, table_column=table.columns[-1], table_key=table.columns[0] if len(table.columns) > 1 else ""))
        elif kind in texts:
            how = functions.get(kind, "blank")
            numeric = how == "hashed_value" and float(row.get("numeric_pct") or 0) > 95
            out.append(Action(name, "numeric_hashed_value" if numeric else how))
    return out


def widened(widths: dict[str, int], actions: list[Action], date_width: int = 10) -> dict[str, int]:
    """Widths of a fixed-width layout that hold what the actions write: 16 hex digits, and 12 more for a prefix."""
    need = {a.column: {"text": 28 if a.prefix else 16, "hashed_value": 16, "alphanumeric_hashed_value": 16}.get(a.how, 0) for a in actions}
    return {c: max(n, need.get(c, 0)) for c, n in widths.items()}


def _original(a: Action, blanks: tuple[str, ...]) -> Column:
    x = F.col(f"`{a.column}`").cast("string")
    return F.when(~F.upper(F.trim(x)).isin("NULL", "", *(b.upper() for b in blanks)), x)


def _anonymized(a: Action, x: Column, as_of: Column) -> Column:
    if a.how == "text":
        return F.concat(F.lit(f"{a.prefix}." if a.prefix else ""), fnv1a_hex(x))
    if a.how == "blank":
        return F.when(x.isNotNull(), F.lit(""))
    if a.how in ("hashed_value", "alphanumeric_hashed_value"):
        return fnv1a_hex(x)
    if a.how == "numeric_hashed_value":
        return fnv1a_mod(x, 2147483647).cast("string")
    if a.how in ("date", "date_to_jan1", "dob", "dod"):
        day = parse_date(x)
        first = F.trunc(day, "month" if a.how == "date" else "year")
        if a.how == "dob" and a.cap_years:
            first = F.greatest(first, F.trunc(F.add_months(as_of, -12 * a.cap_years), "year"))
        text = F.upper(F.date_format(first, a.date_format))
        return F.coalesce(text, F.lit(a.default_date)) if a.default_date else F.coalesce(text, x)
    raise ValueError(f"unknown action: {a.how}")


def anonymize(df: DataFrame, actions: list[Action], blanks: tuple[str, ...] = (), as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` with each action's column replaced, and the crosswalk (hashed_key, original_value, anonymized_value)."""
    out, pairs = df, []
    for k, a in enumerate(actions):
        out = out.withColumn(f"_o{k}", _original(a, blanks))
        if a.how == "lookup":
            n = a.table.count()
            if not n:
                raise ValueError(f"the table for {a.column} is empty")
            value = F.col(f"`{a.table_column}`").cast("string").alias(f"_v{k}")
            if a.table_key:
                own = a.table.select(value, F.col(f"`{a.table_key}`").cast("string").alias(f"_r{k}"))
            else:
                keyed = a.table.select(value, F.xxhash64(a.table_column, *a.table.columns).alias("_h"))
                own = numbered(keyed, "_h", f"_r{k}").select(f"_v{k}", (F.col(f"_r{k}") + 1).cast("string").alias(f"_r{k}"))
            out = out.withColumn(f"_r{k}", (fnv1a_mod(F.col(f"_o{k}"), n) + 1).cast("string")).join(own, f"_r{k}", "left").drop(f"_r{k}")
            only_digits = F.col(f"_o{k}").rlike("^[0-9]+$")
            out = out.withColumn(f"_v{k}", F.when(only_digits, F.regexp_replace(f"_v{k}", "[^0-9]", "")).otherwise(F.col(f"_v{k}")))
        else:
            out = out.withColumn(f"_v{k}", _anonymized(a, F.col(f"_o{k}"), as_of if as_of is not None else F.current_date()))
        pairs.append(F.struct(F.col(f"_o{k}").alias("original_value"), F.col(f"_v{k}").alias("anonymized_value")))
    keys = out.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("original_value IS NOT NULL").distinct()
    keys = keys.select(fnv1a_hex(F.concat("original_value", "anonymized_value")).alias("hashed_key"), "original_value", "anonymized_value")
    by = {a.column: f"_v{k}" for k, a in enumerate(actions)}
    return out.select(*(F.col(by[c]).alias(c) if c in by else F.col(f"`{c}`") for c in df.columns)), keys
