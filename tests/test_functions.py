import uuid

import pytest
from pyspark.sql import functions as F

from millrace.functions import cleansing, dates, hashing, keys


def one(spark, c, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(c(F.col("x"))).first()[0]


def fnv(text):
    h = 14695981039346656037
    for b in text.encode():
        h = (h ^ b) * 1099511628211 % 2**64
    return h


def test_fnv(spark):
    assert fnv("NAME1M19690101") == 5273485936479607779
    rows = spark.createDataFrame([(t,) for t in ("NAME1M19690101", "", "é中🎈", "x" * 300, None)], "x string").select("x", hashing.fnv1a_hex(F.col("x")), hashing.fnv1a_mod(F.col("x"), 97)).collect()
    for t, h, m in rows:
        assert (h, m) == ((None, None) if t is None else (f"{fnv(t):016x}", fnv(t) % 97))


@pytest.mark.parametrize("version", [3, 5])
def test_name_uuid(spark, version):
    space = "03847036-1ef4-4c24-8815-7aab5064c3ce"
    want = str((uuid.uuid3 if version == 3 else uuid.uuid5)(uuid.UUID(space), "NAMEé"))
    assert one(spark, lambda x: hashing.name_uuid(x, space, version), "NAMEé") == want


def test_null_keys_go_anywhere(spark):
    got = {r[0] for r in spark.range(200).select(hashing.partition_of(F.lit(None).cast("string"), 5)).collect()}
    assert len(got) > 2 and got <= set(range(5))


DATES = {"2024-02-29": "2024-02-29", "02/29/2024": "2024-02-29", "1969-JAN-02": "1969-01-02", "2023-02-31": "2023-03-03", "20240229": "2024-02-29", "1/2/24": None, "13/13/2024": None, "no date here": None, None: None}


def test_dates(spark):
    rows = spark.createDataFrame([(k,) for k in DATES], "x string").select("x", dates.parse_date(F.col("x")).cast("string")).collect()
    assert dict(map(tuple, rows)) == DATES
    assert str(one(spark, dates.parse_datetime, "2024-02-29T10:11:12.5+02:00")) == "2024-02-29 08:11:12.500000"


def test_periods(spark):
    d = lambda f: one(spark, lambda x: f(x.cast("date")), "1970-01-15")
    assert (d(dates.month_period), d(dates.week_period), d(dates.day_period), d(lambda x: dates.day_period(x, True))) == (1, 3, 15, 15)


CLEANSED = [
    ("trim", "", "  a ", "a"), ("trim", "", "   ", None), ("to_upper", "", "aé", "AÉ"), ("validate_date", "", "2024-01-01", "2024-01-01"), ("validate_date", "", "x", None),
    ("to_zip5", "", "123", "00123"), ("to_zip5", "", "1234567", "00123"), ("to_zip5", "", "12345-6789", "12345"), ("to_zip5", "", "00000", None), ("to_zip5", "", "1234567890", None),
    ("to_zipext4_from_zip9", "", "123456789", "6789"), ("to_zipext4_from_zip9", "", "12345", None), ("to_zipext4", "", "7", "0007"), ("to_zipext4", "", "0000", None),
    ("format_phone", "", "(212) 555-0100", "+12125550100"), ("format_phone", "(%s) %s-%s", "1-212-555-0100", "(212) 555-0100"), ("format_phone", "", "112-555", None), ("format_phone", "", "1125550100", None),
    ("reformat0", "%05d", "a12", "00012"), ("overpunch_number", "0", "1234E", "+12345"), ("overpunch_number", "2", "1234N", "-123.45"), ("overpunch_number", "1", "12345", "1234.5"), ("overpunch_number", "0", "12?", None),
    ("apply_regex", "[0-9]+", "ab12c3", "12"), ("apply_regex", "[0-9]+", "abc", None), ("scale_units", "10", "25", "3.000000"), ("scale_units", "1", "a2.5", "2.5"), ("parse_amount", "", "($1,234.50", "-1234.50"), ("parse_amount", "100", "250", "2.500000"),
    ("scrub_characters", "-#", "a-b#c", "abc"), ("substring", "1:3", "abcd", "bc"), ("substring", "0:-1", "abcd", "abc"), ("substring", "3:9", "abcd", None), ("split_on", ".", "a.b..c", ["a", "b", "", "c"]),
    ("unique_split_on", ",", "v1,v2,v1", ["v1-0", "v1-1", "v2-0"]), ("slice_input", "|,0,2", "a|b|c", ["a", "c"]), ("slice_input", "|,1:", "a|b|c", ["b", "c"]), ("slice_input", "|,0:2", "a|b|c", ["a", "b"]), ("slice_input", "|,5:6", "a|b", None),
    ("ndc10_to_11", "", "1234-5678-90", "01234567890"), ("ndc10_to_11", "", "12345-678-90", "12345067890"), ("ndc10_to_11", "", "12345-6789-0", "12345678900"), ("ndc10_to_11", "", "a-b-c", "abc"), ("ndc10_to_11", "", "abc", "abc"), ("ndc10_to_11", "", "", None),
    ("find_and_replace", "a,b", "aXa", "bXb"), ("concat_with", "-,x", "p", "p-p"),
]


def test_cleansing(spark):
    for name, argument, text, want in CLEANSED:
        assert one(spark, lambda x, n=name, a=argument: cleansing.cleanse(n, x, a)[0], text) == want, (name, argument, text)
    assert {n for n, *_ in CLEANSED} | {"concat"} == set(cleansing.NAMES)


def test_cleansing_errors(spark):
    for name, text, bad in (("format_phone", "12", True), ("format_phone", "2125550100", False), ("validate_date", "zz", True), ("overpunch_number", "1?", True)):
        assert one(spark, lambda x, n=name: cleansing.cleanse(n, x, "0")[1], text) is bad
    with pytest.raises(ValueError):
        cleansing.cleanse("nothing", F.lit("x"))


def test_cleansed_doubles(spark):
    """Zeros with their sign, no value where there is none, and no exponents."""
    want = [(-0.0, ("-0.000000", "-0.000000")), (0.0, ("0.000000", "0.000000")), (-0.29, ("-0.000000", "-0.072500")), (0.29, ("1.000000", "0.072500")), (-7.0, ("-1.000000", "-1.750000")), (-7.01, ("-1.000000", "-1.752500")), (7.01, ("2.000000", "1.752500"))]
    want += [(12345678.5, ("1763669.000000", "3086419.625000")), (-0.0005, ("-0.000000", "-0.000125")), (1.4e20, ("20000000000000000000.000000", "35000000000000000000.000000")), (None, (None, None))]
    for x, found in want:
        assert one(spark, lambda c: F.array(cleansing.cleanse("scale_units", c, "7")[0], cleansing.cleanse("parse_amount", c, "4")[0]), x, "double") == list(found), x
    assert one(spark, lambda c: F.array(cleansing.cleanse("scale_units", c, "7")[0], cleansing.cleanse("parse_amount", c, "4")[0]), "a") == [None, None]


def test_keys(spark):
    df = spark.createDataFrame([("Ann B", "1969-01-01"), (None, None)], "name string, dob string")
    got = [r[0] for r in df.select(keys.composite_key(["remove_mi(name)", "format_date(dob)"])).collect()]
    assert got == ["ANN19690101", None]


def test_rule_operators_of_nulls_and_arrays(spark):
    from millrace.functions import rule_ops

    df = spark.createDataFrame([(None, [3, 1, 1], ["a", "b", "c"], "x-y"), (2, None, None, None)], "n int, v array<int>, o array<string>, s string")
    b, u, c = rule_ops.BINARY, rule_ops.UNARY, F.col
    got = df.select(b["!="](c("n"), F.lit(2)), b["or"](c("n"), F.lit(1)), u["not"](c("n")), b["max_head_of"](c("o"), c("v")), b["min_head_of"](c("o"), c("v")), b["size_of"](c("v")), b["exist_not"](c("v")), b["range"](F.lit(4), F.lit(3)), b["sum_values"](c("v"), True)).collect()
    assert tuple(got[0]) == (1, 1, 0, "a", "b", 3, 0, [4, 5, 6], 5) and tuple(got[1]) == (0, 1, 0, None, None, 0, 1, [4, 5, 6], None)
    table = spark.createDataFrame([("2", "p"), ("2", "q")], "k string, w string")
    assert [len(r["found"] or []) for r in rule_ops.multi_lookup(df, table, ["n"], ["k"]).orderBy("n").collect()] == [0, 2]
    assert rule_ops.lookup_rand(df, table, seed=1).where("found IS NULL").count() == 0
