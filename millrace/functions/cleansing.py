"""Cleansing functions of mapped columns.

Each takes a column with text and an argument, and returns the cleansed column
and the condition under which the input is in error (then the value is null).
An empty input is null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import parse_date

Cleansed = tuple[Column, Column]


def _sound(value: Column) -> Cleansed:
    return value, F.lit(False)


def blank_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def amount_text(x: Column) -> Column:
    """Digits and points; a parenthesis or minus becomes a minus."""
    return F.regexp_replace(F.regexp_replace(x, r"[^0-9.(\-]", ""), r"\(", "-")


def plain(x: Column) -> Column:
    """A double with six decimals, as text; a negative zero keeps its sign, null stays null."""
    return F.when(x.isNotNull(), F.format_string("%.6f", x.cast("double")))


def as_text(x: Column) -> Column:
    """The column as text; doubles without exponent, as the E of ``1.0E7`` would be lost among other letters."""
    text = x.cast("string")
    whole = F.regexp_replace(F.format_string("%.18f", text.try_cast("double")), r"(\.\d+?)0+$", "$1")
    return F.when(F.typeof(x).isin("double", "float") & text.contains("E"), whole).otherwise(text)


def trim(x: Column, arg: str) -> Cleansed:
    return _sound(blank_null(F.regexp_replace(x, r"^[\s\p{Z}\x85]+|[\s\p{Z}\x85]+$", "")))


def validate_date(x: Column, arg: str) -> Cleansed:
    good = parse_date(x).isNotNull()
    return F.when(good, x), ~good


def to_upper(x: Column, arg: str) -> Cleansed:
    return _sound(F.upper(x))


def _code(x: Column, zero: str) -> Column:
    return F.nullif(x, F.lit(zero))


def to_zip5(x: Column, arg: str) -> Cleansed:
    d = digits(x)
    n = F.length(d)
    return _sound(F.when((n > 0) & (n <= 5), _code(F.lpad(d, 5, "0"), "00000")).when((n > 5) & (n <= 9), _code(F.substring(F.lpad(d, 9, "0"), 1, 5), "00000")))


def to_zipext4_from_zip9(x: Column, arg: str) -> Cleansed:
    d = digits(x)
    return _sound(F.when(F.length(d).between(6, 9), _code(F.substring(F.lpad(d, 9, "0"), 6, 4), "0000")))


def to_zipext4(x: Column, arg: str) -> Cleansed:
    d = digits(x)
    return _sound(F.when(F.length(d).between(1, 4), _code(F.lpad(d, 4, "0"), "0000")))


def format_phone(x: Column, arg: str) -> Cleansed:
    d = digits(x)
    d = F.when(F.length(d) >= 10, F.regexp_replace(F.regexp_replace(d, "^0", ""), "^1", ""))
    good = (F.length(d) >= 10) & F.substring(d, 1, 1).between("2", "9") & F.substring(d, 4, 1).between("2", "9")
    good = F.coalesce(good, F.lit(False))
    return F.when(good, F.format_string(arg or "+1%s%s%s", F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 4))), ~good


def reformat0(x: Column, arg: str) -> Cleansed:
    d = blank_null(digits(x))
    n = d.try_cast("long")
    return F.when(n.isNotNull(), F.format_string(arg, n)), d.isNotNull() & n.isNull()


#: The last character's sign and digit.
_POSITIVE, _NEGATIVE, _DIGITS = "{ABCDEFGHI", "}JKLMNOPQR", "0123456789"


def overpunch_number(x: Column, arg: str) -> Cleansed:
    n = int(arg)
    last, size = F.substring(x, -1, 1), F.length(x)
    digit = F.translate(last, _POSITIVE + _NEGATIVE, _DIGITS + _DIGITS)
    head = F.substring(x, F.lit(1), size - 1)
    sign = F.when(last.rlike("[0-9]"), "").when(last.isin(*_POSITIVE), "+").when(last.isin(*_NEGATIVE), "-")
    whole = F.concat(head, digit)
    value = F.concat(sign, whole) if n == 0 else F.concat(sign, F.substring(whole, F.lit(1), size - n), F.lit("."), F.substring(whole, size - n + 1, F.lit(n)))
    bad = (size < n) | sign.isNull() if n else sign.isNull()
    return F.when(~bad, value), bad


def apply_regex(x: Column, arg: str) -> Cleansed:
    return _sound(blank_null(F.regexp_substr(x, F.lit(java_regex(arg)))))


def java_regex(pattern: str) -> str:
    """Named groups in Java's notation."""
    return pattern.replace("(?P<", "(?<")


def scale_units(x: Column, arg: str) -> Cleansed:
    d = amount_text(x)
    if arg == "1":
        return _sound(blank_null(d))
    down = -(d.try_cast("double") / float(arg))
    near = F.rint(down)
    return plain(-F.when(near <= down, near).otherwise(near - 1)), down.isNull()  # by doubles throughout: ceil gives a long, without the sign of zero


def parse_amount(x: Column, arg: str) -> Cleansed:
    d = blank_null(amount_text(x))
    if arg in ("", "1"):
        return _sound(d)
    n = d.try_cast("double")
    return plain(n / float(arg)), d.isNotNull() & n.isNull()


def concat_columns(x: Column, others: list[Column], delimiter: str = "") -> Cleansed:
    """The input and the other columns that aren't null."""
    return _sound(blank_null(F.concat_ws(delimiter, x, *(o.cast("string") for o in others))))


def find_and_replace(x: Column, find: str, new: str) -> Cleansed:
    return _sound(blank_null(F.replace(x, F.lit(find), F.lit(new))))


def scrub_characters(x: Column, arg: str) -> Cleansed:
    return _sound(F.translate(x, arg, ""))


def substring(x: Column, arg: str) -> Cleansed:
    """Bytes ``start:end``; a negative end counts from the end; out of range is null."""
    start, end = (int(k) for k in arg.split(":"))
    size = F.octet_length(x)
    stop = size + end if end < 0 else F.lit(end)
    piece = F.decode(F.substring(F.encode(x, "UTF-8"), F.lit(start + 1), stop - start), "UTF-8")
    return _sound(F.when((stop <= size) & (stop > start), piece))


def _split(x: Column, delimiter: str) -> Column:
    return F.split(x, "\\Q" + delimiter + "\\E", -1)


def split_on(x: Column, arg: str) -> Cleansed:
    return _sound(_split(x, arg))


def unique_split_on(x: Column, arg: str) -> Cleansed:
    """Each value with the number of equal ones before it; equal values stand together, in order of first place."""
    parts = _split(x, arg)
    groups = F.transform(F.array_distinct(parts), lambda v: F.transform(F.filter(parts, lambda y: y == v), lambda y, i: F.concat(y, F.lit("-"), i.cast("string"))))
    return _sound(F.flatten(groups))


def slice_input(x: Column, delimiter: str, values: list[int] | None = None, start: int | None = None, end: int | None = None) -> Cleansed:
    parts = _split(x, delimiter)
    if values is not None:
        parts = F.filter(F.array(*(F.get(parts, F.lit(v)) for v in values)), lambda v: v.isNotNull())
    elif start is not None:
        parts = F.slice(parts, start + 1, end - start if end is not None else 1 << 30)
    return _sound(F.when(F.size(parts) > 0, parts))


def ndc10_to_11(x: Column, arg: str) -> Cleansed:
    p = F.split(x, "-", -1)
    a, b, c = (F.get(p, F.lit(k)) for k in range(3))
    shape = lambda i, j, k: (F.length(a) == i) & (F.length(b) == j) & (F.length(c) == k)
    joined = F.when(shape(4, 4, 2), F.concat(F.lit("0"), a, b, c)).when(shape(5, 3, 2), F.concat(a, F.lit("0"), b, c)).when(shape(5, 4, 1), F.concat(a, b, F.lit("0"), c)).otherwise(F.concat(a, b, c))
    return _sound(F.when(F.size(p) == 3, joined).otherwise(x))


SIMPLE: dict[str, Callable[[Column, str], Cleansed]] = {
    f.__name__: f
    for f in (trim, validate_date, to_upper, to_zip5, to_zipext4_from_zip9, to_zipext4, format_phone, reformat0, overpunch_number, apply_regex, scale_units, parse_amount, scrub_characters, substring, split_on, unique_split_on, ndc10_to_11)
}
_NEEDS_ARGUMENT = {"reformat0", "overpunch_number", "apply_regex", "scale_units", "scrub_characters", "substring", "split_on", "unique_split_on", "slice_input", "find_and_replace", "concat_with"}
NAMES = (*SIMPLE, "concat", "concat_with", "find_and_replace", "slice_input")


def cleanse(name: str, x: Column, argument: str = "") -> Cleansed:
    """Applies a cleansing function by name.

    Arguments with parts are comma-separated: ``concat``: columns;
    ``concat_with``: delimiter, columns; ``find_and_replace``: find, new;
    ``slice_input``: delimiter, then nothing, positions, or ``from:to``.
    """
    if name not in NAMES:
        raise ValueError(f"unknown cleansing function: {name}")
    if name in _NEEDS_ARGUMENT and not argument:
        raise ValueError(f"{name} needs an argument")
    x = blank_null(as_text(x))
    if name in SIMPLE:
        return SIMPLE[name](x, argument)
    if name == "concat":
        return concat_columns(x, [F.col(c.strip()) for c in argument.split(",") if c.strip()])
    first, *rest = argument.split(",")
    if name == "concat_with":
        return concat_columns(x, [F.col(c.strip()) for c in rest], first)
    if name == "find_and_replace":
        return find_and_replace(x, first, rest[0] if rest else "")
    if not rest:
        return slice_input(x, first)
    if ":" in rest[0]:
        a, b = rest[0].split(":")
        return slice_input(x, first, start=int(a), end=int(b) if b else None)
    return slice_input(x, first, [int(k) for k in rest])


def any_error(errors: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, errors, F.lit(False))
