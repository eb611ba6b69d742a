"""One query for each operator over the driver's tables, with SQL that says the same."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cleansing, dates, keys, rule_ops
from .operators import anonymize, clustering, profile, rules, transforms
from .plans import pipeline
from .plans import queries as structured
from .sources import readers, writers
from .storage import shared_dir
from .streaming import runner

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> dict[str, Any]:
    return {"select": name}


def val(x: Any) -> dict[str, Any]:
    return {"value": str(x)}


def op(name: str, lhs: dict, rhs: dict, **more: Any) -> dict[str, Any]:
    return {"op": name, "lhs": lhs, "rhs": rhs, **more}


def evaluated(name: str, node: dict) -> dict[str, Any]:
    return {"name": name, "type": "eval", "eval_expr": node}


def chosen(name: str, expr: str | None = None) -> dict[str, Any]:
    return {"name": name, "type": "select", "expr": expr or name}


# --- row operators ------------------------------------------------------------


@query("SELECT l_returnflag, sum(round(l_extendedprice * (1 - l_discount), 4))::DECIMAL(30,4)::DOUBLE AS revenue, count(*) AS n FROM lineitem WHERE l_quantity < 24 GROUP BY l_returnflag")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole pipeline: filter, map_record, and an aggregate by splitter key. Sums are of decimals, so their order doesn't matter."""
    price = op("*", col("l_extendedprice"), op("-", val(1), col("l_discount")))
    config = {"sources": ["lineitem"], "steps": [{"pipes": [
        {"type": "fan_out", "input": "lineitem", "apply": [{"type": "filter", "filter": op("<", col("l_quantity"), val(24)), "output": "small"}]},
        {"type": "fan_out", "input": "small", "apply": [{"type": "map_record", "columns": [chosen("l_returnflag"), evaluated("disc_price", price)], "output": "priced"}]}]}, {"pipes": [
        {"type": "splitter", "splitter": {"column": "l_returnflag"}, "input": "exact", "apply": [{"type": "aggregate", "columns": [{"name": "revenue", "type": "sum", "expr": "disc_price"}, {"name": "n", "type": "count", "expr": "*"}], "output": "sums"}]}]}]}
    first = pipeline.build(spark, {**config, "steps": config["steps"][:1]}, {"lineitem": _t(spark, sf_dir, "lineitem")})
    exact = first["priced"].withColumn("disc_price", F.round("disc_price", 4).cast("decimal(20,4)"))
    made = pipeline.build(spark, {"sources": ["exact"], "steps": config["steps"][1:]}, {"exact": exact})
    return made["sums"].select(F.col("split_key").alias("l_returnflag"), F.col("revenue").cast("double").alias("revenue"), "n")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 24 AND l_returnflag = 'R'")
def filter_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = op("AND", op("<", col("l_quantity"), val(24)), op("==", col("l_returnflag"), val("'R'")))
    return transforms.filter_rows(_t(spark, sf_dir, "lineitem"), when).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""WITH t AS (SELECT c_custkey, nullif(c_nationkey, 3) AS n FROM customer)
SELECT c_custkey, CASE WHEN n IS NOT NULL AND n < 5 THEN 1 ELSE 0 END AS lt, CASE WHEN n IS NOT NULL AND n <> 7 THEN 1 ELSE 0 END AS ne,
CASE WHEN n IS NULL THEN 1 ELSE 0 END AS is_null, CASE WHEN n IS NOT NULL AND n <= 0 THEN 1 ELSE 0 END AS negated,
CASE WHEN n IS NOT NULL AND (n > 0 OR c_custkey > 0) THEN 1 ELSE 0 END AS either FROM t""")
def filter_null_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("n"))
    out = [evaluated("lt", op("<", col("n"), val(5))), evaluated("ne", op("!=", col("n"), val(7))), evaluated("is_null", op("IS", col("n"), val("NULL"))), evaluated("negated", {"op": "NOT", "arg": col("n")}), evaluated("either", op("OR", col("n"), col("c_custkey")))]
    return transforms.map_record(t, [chosen("c_custkey"), *out])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, 'v1' AS tag, 7 AS seven FROM lineitem")
def map_record_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = op("*", op("*", col("l_extendedprice"), op("-", val(1), col("l_discount"))), op("+", val(1), col("l_tax")))
    specs = [chosen("l_orderkey"), chosen("l_linenumber"), evaluated("charge", node), {"name": "tag", "type": "value", "expr": "'$TAG'"}, {"name": "seven", "type": "value", "expr": "7"}]
    return transforms.map_record(_t(spark, sf_dir, "lineitem"), specs, {"TAG": "v1"})


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE WHEN o_totalprice > 300000 THEN 3 WHEN o_totalprice > 100000 THEN 2 END AS rank FROM orders")
def case_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    arm = lambda least, band, rank: {"when": op(">", col("o_totalprice"), val(least)), "then": [{"name": "band", "expr": val(f"'{band}'")}, {"name": "rank", "expr": val(rank)}]}
    spec = {"type": "case", "case_expr": [arm(300000, "high", 3), arm(100000, "mid", 2)], "else_expr": [{"name": "band", "expr": val("'low'")}]}
    return transforms.map_record(_t(spark, sf_dir, "orders"), [chosen("o_orderkey"), spec])


@query("SELECT c_custkey, c_name || '|' || c_mktsegment AS both, c_name || '|' || c_mktsegment || '|' || c_name AS three FROM customer")
def multi_select_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transforms.map_record(_t(spark, sf_dir, "customer"), [chosen("c_custkey"), chosen("c_name"), {"name": "a", "type": "multi_select", "expr_array": ["c_name", "c_mktsegment"]}])
    t = transforms.map_record(t, [chosen("c_custkey"), chosen("a"), evaluated("b", op("TO_ARRAY", col("a"), col("c_name")))])
    return t.select("c_custkey", F.array_join("a", "|").alias("both"), F.array_join("b", "|").alias("three"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END AS urgent, CASE WHEN o_orderstatus IN ('F','O') THEN 1 ELSE 0 END AS open,
strlen(o_orderpriority)::INTEGER AS bytes, nullif(regexp_extract(o_orderpriority, '[A-Z]+'), '') AS word, replace(o_orderpriority, '-', '_') AS changed,
abs(o_totalprice - 150000) AS apart, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 6)::INTEGER AS months, o_orderstatus || o_orderpriority AS joined,
CASE WHEN o_orderkey = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice / o_orderkey END AS ratio, strftime(o_orderdate, '%Y%m%d') AS day, (o_orderdate::DATE + 30) AS later FROM orders""")
def expression_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "orders").select("*", F.col("o_orderdate").cast("date").alias("d"), F.lit("1995-06-01").cast("date").alias("since"))
    nodes = {
        "urgent": op("IN", col("o_orderpriority"), {"static_list": ["'1-URGENT'", "'2-HIGH'"]}),
        "open": op("IN_NO_CASE", col("o_orderstatus"), {"static_list": ["'f'", "'o'"]}),
        "bytes": {"op": "LENGTH", "arg": col("o_orderpriority")},
        "word": op("APPLY_REGEX", col("o_orderpriority"), val("'[A-Z]+'")),
        "changed": op("FIND_AND_REPLACE", col("o_orderpriority"), {"static_list": ["'-'", "'_'"]}),
        "apart": {"op": "ABS", "arg": op("-", col("o_totalprice"), val(150000))},
        "months": op("DISTANCE_MONTHS", col("since"), col("d")),
        "joined": op("+", col("o_orderstatus"), col("o_orderpriority")),
        "ratio": op("/", col("o_totalprice"), col("o_orderkey")),
        "day": op("APPLY_FORMAT", col("d"), val("'yyyyMMdd'")),
        "later": op("+", col("d"), val(30)),
    }
    return transforms.map_record(t, [chosen("o_orderkey"), *(evaluated(k, v) for k, v in nodes.items())])


@query()
def uuid_and_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "nation")
    return transforms.map_record(t, [chosen("n_nationkey"), evaluated("id", {"op": "NEW_UUID", "arg": val(0)}), evaluated("year", {"function": "CURRENT_YEAR"})])


# --- aggregates -----------------------------------------------------------------


@query("SELECT count(*) AS n, count(DISTINCT l_returnflag) AS flags, min(l_shipdate) AS first, max(l_quantity) AS most, round(avg(l_quantity), 6) AS mean, sum(l_linenumber)::BIGINT AS numbers FROM lineitem")
def agg_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [{"name": "n", "type": "count", "expr": "*"}, {"name": "flags", "type": "distinct_count", "expr": "l_returnflag"}, {"name": "first", "type": "min", "expr": "l_shipdate"}, {"name": "most", "type": "max", "expr": "l_quantity"}, {"name": "mean", "type": "avg", "expr": "l_quantity"}, {"name": "numbers", "type": "sum", "expr": "l_linenumber"}]
    return transforms.aggregate_rows(_t(spark, sf_dir, "lineitem"), specs).withColumn("mean", F.round("mean", 6))


@query("SELECT o_orderstatus, nullif(count(*) FILTER (o_totalprice > 499000), 0) AS large, count(DISTINCT CASE WHEN o_totalprice > 200000 THEN o_custkey END) AS customers FROM orders GROUP BY o_orderstatus")
def agg_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [{"name": "large", "type": "count", "expr": "*", "where": op(">", col("o_totalprice"), val(499000))}, {"name": "customers", "type": "distinct_count", "expr": "o_custkey", "where": op(">", col("o_totalprice"), val(200000))}]
    return transforms.aggregate_rows(_t(spark, sf_dir, "orders"), specs, ["o_orderstatus"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_linenumber)::BIGINT AS numbers, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY ALL")
def agg_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [{"name": "n", "type": "count", "expr": "*"}, {"name": "numbers", "type": "sum", "expr": "l_linenumber"}, {"name": "low", "type": "min", "expr": "l_extendedprice"}, {"name": "high", "type": "max", "expr": "l_extendedprice"}]
    return transforms.aggregate_rows(_t(spark, sf_dir, "lineitem"), specs, ["l_returnflag", "l_linestatus"])


@query("""WITH RECURSIVE r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
b AS (SELECT o_custkey, k, o_totalprice AS v FROM r WHERE k = 1 UNION ALL SELECT r.o_custkey, r.k, b.v + (r.o_totalprice - b.v) * 2 / (r.k + 1) FROM b JOIN r ON r.o_custkey = b.o_custkey AND r.k = b.k + 1)
SELECT o_custkey, round(arg_max(v, k), 6) AS blend FROM b GROUP BY o_custkey""")
def avrg_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = [{"name": "blend", "type": "avrg", "expr": "o_totalprice"}]
    return transforms.aggregate_rows(_t(spark, sf_dir, "orders"), spec, ["o_custkey"], order="o_orderkey").withColumn("blend", F.round("blend", 6))


@query("SELECT count(*) AS customers, sum(n)::BIGINT AS orders, max(n) AS most FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) WHERE n > 1")
def map_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = op(">", col("n"), val(1))
    reduce = [{"name": "customers", "type": "count", "expr": "*", "where": many}, {"name": "orders", "type": "sum", "expr": "n", "where": many}, {"name": "most", "type": "max", "expr": "n", "where": many}]
    return transforms.map_reduce(_t(spark, sf_dir, "orders"), "o_custkey", [{"name": "n", "type": "count", "expr": "*"}], reduce)


# --- joins, bundles, order --------------------------------------------------------


@query("SELECT o_orderkey, c_name AS customer, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transforms.lookup(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer"), ["o_custkey"], ["c_custkey"], {"c_name": "customer", "c_mktsegment": "segment"})
    return out.select("o_orderkey", "customer", "segment")


@query("SELECT c_custkey, o_orderkey AS last_order, o_totalprice AS last_price FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) ON o_custkey = c_custkey")
def lookup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").withColumn("o_custkey", F.col("o_custkey"))
    out = transforms.lookup(_t(spark, sf_dir, "customer"), orders.withColumn("seq", F.col("o_orderkey")), ["c_custkey"], ["o_custkey"], {"o_orderkey": "last_order", "o_totalprice": "last_price"}, order="seq")
    return out.select("c_custkey", "last_order", "last_price")


@query("""WITH m AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), s AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT m.k::VARCHAR AS o_custkey, m.n + coalesce(s.n, 0) AS rows FROM m LEFT JOIN s USING (k)""")
def merge_cogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    out = transforms.merge(o.where("o_orderstatus = 'F'"), [o.where("o_orderstatus = 'O'")], ["o_custkey"], "o_orderkey")
    return out.select("o_custkey", F.size("rows").cast("long").alias("rows"))


@query("SELECT o_custkey, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def group_by_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transforms.group_by(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", ["o_custkey"])
    return out.select("o_custkey", F.size("rows").cast("long").alias("n"), F.array_join(F.col("rows.o_orderkey").cast("array<string>"), ",").alias("orders"))


@query("SELECT (rn - 1) // 7 AS bundle, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1")
def group_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transforms.group_by(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", count=7)
    return out.select("bundle", F.size("rows").cast("long").alias("n"), F.aggregate(F.col("rows.o_orderkey"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("""WITH t AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AND lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT NULL THEN 0 ELSE 1 END AS c FROM events),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM t) SELECT user_id, event_type, min(event_id) AS first, count(*) AS n FROM r GROUP BY user_id, run, event_type""")
def group_by_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transforms.group_by(_t(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id", ["event_type"], consecutive=True, within=["user_id"])
    return out.select("user_id", "event_type", F.get(F.col("rows.event_id"), F.lit(0)).alias("first"), F.size("rows").cast("long").alias("n"))


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.distinct_on(_t(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
def sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.sort_rows(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 100)


@query("SELECT event_id, (year(ts) - 1970) * 12 + month(ts) AS period FROM events WHERE (year(ts) - 1970) * 12 + month(ts) BETWEEN 647 AND 649")
def union_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "events").select("event_id", dates.month_period(F.col("ts")).cast("long").alias("period"))
    return transforms.lookback(t, "period", 649, 2)


@query("""WITH v AS (SELECT 'c_mktsegment' AS column_name, upper(c_mktsegment) AS v FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR FROM customer),
c AS (SELECT column_name, v AS freq_value, count(*) AS freq_count FROM v WHERE v IS NOT NULL AND v <> '' GROUP BY ALL),
r AS (SELECT *, sum(freq_count) OVER (PARTITION BY column_name) AS total, coalesce(sum(freq_count) OVER (PARTITION BY column_name ORDER BY freq_count DESC, freq_value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT column_name, freq_count, freq_value FROM r WHERE before <= total * 60 / 100""")
def high_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.high_freq(_t(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], 60)


@query("SELECT l_orderkey, l_linenumber, l_returnflag || '|' || ((row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 10 + l_linenumber, l_partkey, l_suppkey) - 1) // 1000)::VARCHAR AS split_key FROM lineitem")
def splitter_ext_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "lineitem").withColumn("seq", F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_partkey", "l_suppkey"))
    return transforms.splitter(t, "l_returnflag", rows_each=1000, order="seq").select("l_orderkey", "l_linenumber", "split_key")


@query("SELECT l_orderkey, l_linenumber, l_returnflag || '|' || ((row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) // 1000)::VARCHAR AS split_key FROM lineitem")
def splitter_ext_count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table; rows that are equal in the order differ in no column of the result."""
    t = _t(spark, sf_dir, "lineitem").withColumn("seq", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return transforms.splitter(t, "l_returnflag", rows_each=1000, order="seq").select("l_orderkey", "l_linenumber", "split_key")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) WHERE k % 10 = 0")
def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.sample_rows(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 10)


@query()
def shuffling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.shuffling(_t(spark, sf_dir, "customer"), 1000, 200, seed=3)


# --- functions ----------------------------------------------------------------------


@query("""WITH t AS (SELECT c_custkey, (c_custkey * 7919 % 1000000007)::VARCHAR AS d, c_acctbal::VARCHAR AS a, c_name, c_mktsegment FROM customer)
SELECT c_custkey, upper(c_mktsegment) AS up, nullif(CASE WHEN length(d) <= 5 THEN lpad(d, 5, '0') WHEN length(d) <= 9 THEN left(lpad(d, 9, '0'), 5) END, '00000') AS zip5,
nullif(CASE WHEN length(d) BETWEEN 6 AND 9 THEN right(lpad(d, 9, '0'), 4) END, '0000') AS ext9, nullif(CASE WHEN length(d) <= 4 THEN lpad(d, 4, '0') END, '0000') AS ext4,
lpad(d, 12, '0') AS zeros, nullif(regexp_extract(c_name, '[1-9][0-9]*'), '') AS found, replace(c_name, 'Customer', 'C') AS replaced, replace(replace(c_name, '#', ''), '0', '') AS scrubbed,
c_name[1:8] AS piece, c_name || '-' || c_mktsegment AS with_segment, string_split(c_name, '#')[2] AS second, '+' || left(d || '1', -1) || left(right(d || '1', 1), 1) AS punched FROM t""")
def cleansing_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", (F.col("c_custkey") * 7919 % 1000000007).cast("string").alias("d"))
    f = lambda name, x, arg="": cleansing.cleanse(name, F.col(x) if isinstance(x, str) else x, arg)[0]
    return t.select(
        "c_custkey", f("to_upper", "c_mktsegment").alias("up"), f("to_zip5", "d").alias("zip5"), f("to_zipext4_from_zip9", "d").alias("ext9"), f("to_zipext4", "d").alias("ext4"), f("reformat0", "d", "%012d").alias("zeros"),
        f("apply_regex", "c_name", "[1-9][0-9]*").alias("found"), f("find_and_replace", "c_name", "Customer,C").alias("replaced"), f("scrub_characters", "c_name", "#0").alias("scrubbed"), f("substring", "c_name", "0:8").alias("piece"),
        f("concat_with", "c_name", "-,c_mktsegment").alias("with_segment"), F.get(f("slice_input", "c_name", "#,1"), F.lit(0)).alias("second"), f("overpunch_number", F.concat("d", F.lit("A")), "0").alias("punched"),
    )


@query("""SELECT c_custkey, printf('%.6f', ceil(c_acctbal / 7)) AS units, printf('%.6f', c_acctbal / 4) AS amount, CASE WHEN substr(p, 1, 1) BETWEEN '2' AND '9' AND substr(p, 4, 1) BETWEEN '2' AND '9' THEN '+1' || p END AS phone,
'0' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || '123456' AS ndc FROM (SELECT *, lpad((c_custkey * 104729 % 10000000000)::VARCHAR, 10, '3') AS p FROM customer)""")
def cleansing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "customer").withColumn("p", F.lpad((F.col("c_custkey") * 104729 % 10000000000).cast("string"), 10, "3"))
    ndc = F.concat(F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("-1234-56"))
    return t.select("c_custkey", cleansing.cleanse("scale_units", F.col("c_acctbal"), "7")[0].alias("units"), cleansing.cleanse("parse_amount", F.col("c_acctbal"), "4")[0].alias("amount"), cleansing.cleanse("format_phone", F.col("p"))[0].alias("phone"), cleansing.cleanse("ndc10_to_11", ndc)[0].alias("ndc"))


@query("SELECT o_orderkey, o_orderdate::DATE AS iso, o_orderdate::DATE AS american, o_orderdate::DATE AS named FROM orders")
def date_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, d = _t(spark, sf_dir, "orders"), F.col("o_orderdate")
    return t.select("o_orderkey", dates.parse_date(F.date_format(d, "yyyy-MM-dd")).alias("iso"), dates.parse_date(F.date_format(d, "MM/dd/yyyy")).alias("american"), dates.parse_date(F.upper(F.date_format(d, "yyyy-MMM-dd"))).alias("named"))


@query("""SELECT o_orderkey, (year(o_orderdate) - 1970) * 12 + month(o_orderdate) AS month_period, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) // 7 + 1 AS week_period, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 1 AS day_period,
2024 - year(o_orderdate) - CASE WHEN dayofyear(DATE '2024-01-01') < dayofyear(o_orderdate) THEN 1 ELSE 0 END AS age FROM orders""")
def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return _t(spark, sf_dir, "orders").select("o_orderkey", *(x.cast("long").alias(n) for n, x in (("month_period", dates.month_period(d)), ("week_period", dates.week_period(d)), ("day_period", dates.day_period(d)), ("age", dates.age(d, F.lit("2024-01-01").cast("date"))))))


_FNV = "list_reduce([14695981039346656037::HUGEINT] || list_transform(string_split({}, ''), lambda c: ascii(c)::HUGEINT), lambda a, x: (xor(a, x) * 1099511628211) % 18446744073709551616)"


@query(f"SELECT c_custkey, ({_FNV.format('upper(c_name)')} % 97)::BIGINT AS part, c_custkey % 97 AS own FROM customer")
def fnv_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = lambda name, c: {"name": name, "type": "hash", "hash_expr": {"expr": c, "nbr_partitions": 97}}
    return transforms.map_record(_t(spark, sf_dir, "customer"), [chosen("c_custkey"), spec("part", "c_name"), spec("own", "c_custkey")])


@query("SELECT c_custkey, upper(c_name || c_mktsegment) AS plain FROM customer")
def domain_key_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", keys.domain_key(["c_name", "c_mktsegment"]).alias("plain"))


def _uuid_sql(digest: str, version: int) -> str:
    h = f"{digest}(unhex('038470361ef44c2488157aab5064c3ce') || upper(c_name)::BLOB)"
    variant = f"substr('89ab', (('0x' || {h}[17])::INTEGER & 3) + 1, 1)"
    return f"{h}[1:8] || '-' || {h}[9:12] || '-{version}' || {h}[14:16] || '-' || {variant} || {h}[18:20] || '-' || {h}[21:32]"


@query(f"SELECT c_custkey, {_uuid_sql('sha1', 5)} AS v5, {_uuid_sql('md5', 3)} AS v3 FROM customer")
def domain_key_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", keys.domain_key(["c_name"], "sha1").alias("v5"), keys.domain_key(["c_name"], "md5").alias("v3"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END AS ne, CASE WHEN o_totalprice > 1000 AND o_orderkey > 0 THEN 1 ELSE 0 END AS both, CASE WHEN o_orderkey = 0 THEN 'NaN'::DOUBLE ELSE trunc(o_custkey / o_orderkey) END AS quotient,
CASE WHEN contains(o_orderpriority, 'HIGH') THEN 1 ELSE 0 END AS high, o_orderpriority[3:] AS piece, o_orderpriority[1:-3] AS short, o_orderpriority[1] AS first, translate(o_orderpriority, '-', '_') AS changed, strlen(o_orderpriority)::INTEGER AS bytes,
least(o_custkey, o_orderkey) AS low, CASE WHEN o_custkey <= o_orderkey THEN 'customer' ELSE 'order' END AS low_head, (o_custkey + o_orderkey)::DOUBLE AS total, epoch(o_orderdate)::BIGINT AS seconds FROM orders""")
def rule_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, u, c = rule_ops.BINARY, rule_ops.UNARY, F.col
    values, names = F.array("o_custkey", "o_orderkey"), F.array(F.lit("customer"), F.lit("order"))
    return _t(spark, sf_dir, "orders").select(
        "o_orderkey", b["!="](c("o_orderstatus"), F.lit("F")).alias("ne"), b["and"](b[">"](c("o_totalprice"), F.lit(1000)), c("o_orderkey")).alias("both"), b["/"](c("o_custkey"), c("o_orderkey"), True).alias("quotient"),
        b["contains"](c("o_orderpriority"), F.lit("HIGH")).alias("high"), b["substring_of"](c("o_orderpriority"), 2, 99).alias("piece"), b["substring_of"](c("o_orderpriority"), 0, -2).alias("short"), b["char_at"](c("o_orderpriority"), F.lit(0)).alias("first"),
        b["replace_char_of"](c("o_orderpriority"), "-", "_").alias("changed"), u["length_of"](c("o_orderpriority")).alias("bytes"), b["min_of"](values).alias("low"), b["min_head_of"](names, values).alias("low_head"), b["sum_values"](values).alias("total"), u["to_timestamp"](c("o_orderdate")).alias("seconds"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 THEN 1 ELSE 0 END AS ge, CASE WHEN o_totalprice < 100000 THEN 1 ELSE 0 END AS lt, CASE WHEN o_totalprice <= 100000 THEN 1 ELSE 0 END AS le, CASE WHEN o_totalprice > 400000 OR o_orderstatus = 'F' THEN 1 ELSE 0 END AS either,
o_custkey * 3 AS thrice, o_custkey + 1 AS next, o_custkey - 1 AS prior, o_orderstatus || o_orderpriority AS joined, 1 AS near, CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END AS negated, abs(o_custkey - 500) AS apart, lower(o_orderpriority) AS low, upper(lower(o_orderpriority)) AS up,
CASE WHEN o_custkey >= o_orderkey THEN 'customer' ELSE 'order' END AS high_head, CASE WHEN o_custkey <= o_orderkey THEN 'customer' ELSE 'order' END AS sorted, regexp_extract(o_orderpriority, '[A-Z]+') AS found, CASE WHEN starts_with(o_orderpriority, '1') THEN 1 ELSE 0 END AS begins,
CASE WHEN ends_with(o_orderpriority, 'H') THEN 1 ELSE 0 END AS finishes, greatest(o_custkey, o_orderkey) AS high, 2 AS many, 1 AS there, 0 AS gone, strftime(o_orderdate, '%Y%m%d') AS day, o_custkey::VARCHAR AS text, o_custkey::DOUBLE AS number,
trim(o_orderpriority) AS trimmed, ((2024 - year(o_orderdate)) * 12 + 1 - month(o_orderdate))::INTEGER AS months, 1 AS literal, 0 AS resource, 0 AS missing FROM orders""")
def rule_operators_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, u, c = rule_ops.BINARY, rule_ops.UNARY, F.col
    values, names = F.array("o_custkey", "o_orderkey"), F.array(F.lit("customer"), F.lit("order"))
    price, day = c("o_totalprice"), c("o_orderdate")
    return _t(spark, sf_dir, "orders").select(
        "o_orderkey", b[">="](price, F.lit(100000)).alias("ge"), b["<"](price, F.lit(100000)).alias("lt"), b["<="](price, F.lit(100000)).alias("le"), b["or"](b[">"](price, F.lit(400000)), b["=="](c("o_orderstatus"), F.lit("F"))).alias("either"),
        b["*"](c("o_custkey"), F.lit(3)).alias("thrice"), b["+"](c("o_custkey"), F.lit(1)).alias("next"), b["-"](c("o_custkey"), F.lit(1)).alias("prior"), b["+"](c("o_orderstatus"), c("o_orderpriority"), True).alias("joined"), b["=="](price, price / 3 * 3).alias("near"),
        u["not"](b["=="](c("o_orderstatus"), F.lit("F"))).alias("negated"), u["abs"](c("o_custkey") - 500).alias("apart"), u["to_lower"](c("o_orderpriority")).alias("low"), u["to_upper"](F.lower("o_orderpriority")).alias("up"), b["max_head_of"](names, values).alias("high_head"), b["sorted_head"](names, values).alias("sorted"),
        b["literal_regex"](c("o_orderpriority"), "[A-Z]+").alias("found"), b["starts_with"](c("o_orderpriority"), F.lit("1")).alias("begins"), b["ends_with"](c("o_orderpriority"), F.lit("H")).alias("finishes"), b["max_of"](c("o_custkey"), c("o_orderkey")).alias("high"), b["size_of"](values).alias("many"), b["exist"](price).alias("there"), b["exist_not"](price).alias("gone"),
        b["apply_format"](day, "yyyyMMdd").alias("day"), u["to_text"](c("o_custkey")).alias("text"), u["to_double"](c("o_custkey").cast("string")).alias("number"), u["trim"](F.concat(F.lit("\t "), "o_orderpriority", F.lit("\n"))).alias("trimmed"), b["age_in_months_as_of"](day.cast("date"), F.lit("2024-01-01").cast("date")).alias("months"),
        u["is_literal"](c("o_orderkey")).alias("literal"), u["is_resource"](c("o_orderkey")).alias("resource"), u["is_null"](c("o_orderkey")).alias("missing"),
    )


# --- profiling, anonymising, clustering ------------------------------------------------


@query("""WITH v AS (SELECT 'c_name' AS column_name, upper(c_name) AS v FROM customer UNION ALL SELECT 'c_mktsegment', upper(c_mktsegment) FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR FROM customer)
SELECT column_name, count(*) AS total_count, count(*) - count(v) AS null_count, count(DISTINCT v) AS distinct_count, round(avg(strlen(v)), 6) AS avr_length, round(var_pop(strlen(v)), 6) AS length_var, round(100.0 * count(*) FILTER (regexp_matches(v, '^[0-9]+$')) / count(v), 6) AS numeric_pct,
CASE WHEN count(try_cast(v AS DOUBLE)) > 0.98 * count(v) THEN 'double' ELSE 'text' END AS minmax_type FROM v GROUP BY 1""")
def analyze_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.analyze(_t(spark, sf_dir, "customer").select("c_name", "c_mktsegment", "c_nationkey"), profile.Profile(regex={"numeric": "^[0-9]+$"}))
    return out.select("column_name", "total_count", "null_count", "distinct_count", "avr_length", "length_var", "numeric_pct", "minmax_type")


@query(f"SELECT c_custkey, 'cn.' || lpad(lower(to_hex({_FNV.format('c_name')})), 16, '0') AS c_name FROM customer")
def anonymize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize.anonymize(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), [anonymize.Action("c_name", "text", "cn")])[0]


@query("SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS day, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS birth FROM orders")
def anonymize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "orders").select("o_orderkey", *(F.date_format("o_orderdate", "yyyy-MM-dd").alias(n) for n in ("day", "birth")))
    return anonymize.anonymize(t, [anonymize.Action("day", "date"), anonymize.Action("birth", "dob")])[0]


def _fnv_hex(x: str) -> str:
    return f"lpad(lower(to_hex({_FNV.format(x)})), 16, '0')"


@query(f"SELECT DISTINCT {_fnv_hex('original_value || anonymized_value')} AS hashed_key, original_value, anonymized_value FROM (SELECT c_name AS original_value, {_fnv_hex('c_name')} AS anonymized_value FROM customer)")
def anonymize_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize.anonymize(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), [anonymize.Action("c_name", "hashed_value")])[1]


@query("""WITH l AS (SELECT c_mktsegment AS v1, 'c_nationkey' AS column2, c_nationkey::VARCHAR AS v2 FROM customer UNION ALL SELECT c_mktsegment, 'c_name', c_name FROM customer),
c AS (SELECT v1, column2, count(DISTINCT v2) AS d, count(v2) AS n FROM l GROUP BY ALL HAVING count(v2) > 3)
SELECT 'c_mktsegment' AS column1, column2, count(*) AS distinct1, sum(d)::BIGINT AS distinct2, sum(n)::BIGINT AS observations FROM c GROUP BY column2""")
def clustering_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.correlation(_t(spark, sf_dir, "customer"), ["c_mktsegment"], ["c_nationkey", "c_name"], 3)


@query("""WITH RECURSIVE t AS (SELECT c_nationkey::VARCHAR AS a, n_name AS b, n_regionkey::VARCHAR AS c, c_mktsegment AS d FROM customer JOIN nation ON c_nationkey = n_nationkey),
l AS (SELECT 'c_nationkey' AS c1, a AS v1, 'n_name' AS c2, b AS v2 FROM t UNION ALL SELECT 'c_nationkey', a, 'n_regionkey', c FROM t UNION ALL SELECT 'c_nationkey', a, 'c_mktsegment', d FROM t
UNION ALL SELECT 'n_name', b, 'c_nationkey', a FROM t UNION ALL SELECT 'n_name', b, 'n_regionkey', c FROM t UNION ALL SELECT 'n_name', b, 'c_mktsegment', d FROM t),
v AS (SELECT c1, v1, c2, count(DISTINCT v2) AS d, count(v2) AS n FROM l GROUP BY ALL), e AS (SELECT c1, c2 FROM v GROUP BY c1, c2 HAVING sum(d) <= 0.3 * sum(n)),
ways AS (SELECT c1 AS x, c2 AS y FROM e UNION SELECT c2, c1 FROM e), r AS (SELECT x AS root, x AS member FROM ways UNION SELECT r.root, ways.y FROM r JOIN ways ON r.member = ways.x),
g AS (SELECT root, string_agg(DISTINCT member, ',' ORDER BY member) AS members FROM r GROUP BY root) SELECT root AS column_name, members, 'valid' AS status, 'code' AS data_subclassification FROM g""")
def clustering_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with all members of their cluster; edges go both ways between the two that determine, so clusters are the connected columns."""
    t = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    kinds = {"c_nationkey": "code", "n_name": "name", "n_regionkey": "region", "c_mktsegment": "other"}
    found = clustering.clustering(t, kinds, {"code", "name"}, {"code", "name"}, tags=("code",), most_ratio=0.3)
    members = found.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_set("column_name")), ",").alias("members"))
    return found.join(members, "cluster_id").select("column_name", "members", "status", "data_subclassification")


# --- sources and sinks ---------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    if spark.conf.get("spark.checkpoint.dir", None):
        return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    return tempfile.mkdtemp(prefix="spark-millrace-") + f"/{name}"


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "csv")
    writers.write_csv(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, delimiter="|", quote_all=True)
    return readers.read_csv(spark, path)[0]


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def fixed_width_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "fixed")
    writers.write_fixed_width(_t(spark, sf_dir, "nation"), path, {"n_nationkey": 5, "n_name": 25})
    return readers.read_fixed_width(spark, path, [readers.Field("n_nationkey", 0, 5), readers.Field("n_name", 5, 30)])


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def partition_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "parts")
    writers.write_partitions(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path, ["o_orderstatus"], rows_each=5000)
    return readers.read_parquet(spark, path, ["o_orderkey", "o_orderstatus"])


@query("SELECT NULL::VARCHAR AS a, NULL::VARCHAR AS b FROM range(50)")
def generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.generate(spark, 50, ["a", "b"])


# --- configurations: what pipes, channels and operators can name -----------------------------


def _built(spark: SparkSession, sf_dir: str, tables: tuple[str, ...], pipes: list[dict[str, Any]], env: dict[str, Any] | None = None, **more: Any) -> dict[str, DataFrame]:
    return pipeline.build(spark, {"sources": list(tables), "steps": [{"pipes": pipes}], **more}, {n: _t(spark, sf_dir, n) for n in tables}, env)


def _fan_out(table: str, *apply: dict[str, Any]) -> list[dict[str, Any]]:
    return [{"type": "fan_out", "input": table, "apply": list(apply)}]


@query(f"SELECT ({_FNV.format('upper(c_name)')} % 16)::VARCHAR AS split_key, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY 1")
def splitter_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [{"name": "n", "type": "count", "expr": "*"}, {"name": "first", "type": "min", "expr": "c_custkey"}]
    pipes = [{"type": "splitter", "splitter": {"shard_on": {"expr": "c_name", "nbr_partitions": 16}}, "input": "customer", "apply": [{"type": "aggregate", "columns": columns, "output": "out"}]}]
    return _built(spark, sf_dir, ("customer",), pipes)["out"]


@query("""WITH c AS (SELECT c_mktsegment AS split_key, c_nationkey::VARCHAR AS freq_value, count(*) AS freq_count FROM customer GROUP BY ALL),
r AS (SELECT *, sum(freq_count) OVER (PARTITION BY split_key) AS total, coalesce(sum(freq_count) OVER (PARTITION BY split_key ORDER BY freq_count DESC, freq_value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT split_key, 'c_nationkey' AS column_name, freq_count, freq_value FROM r WHERE before <= total * 40 / 100""")
def high_freq_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipes = [{"type": "splitter", "splitter": {"column": "c_mktsegment"}, "input": "customer", "apply": [{"type": "high_freq", "columns": ["c_nationkey"], "top_pct": 40, "output": "out"}]}]
    return _built(spark, sf_dir, ("customer",), pipes)["out"]


@query("""SELECT o_orderstatus AS split_key, sum(k)::BIGINT AS n, max(k) AS most, count(*) AS customers, round(sum(s), 4) AS total FROM (SELECT o_orderstatus, o_custkey, count(*) AS k, sum(o_totalprice) AS s FROM orders GROUP BY ALL) GROUP BY 1""")
def aggregate_map_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates beside aggregates of aggregates, under a splitter."""
    reduce = [{"name": "most", "type": "max", "expr": "k"}, {"name": "customers", "type": "count", "expr": "*"}]
    columns = [{"name": "n", "type": "count", "expr": "*"}, {"type": "map_reduce", "map_on": "o_custkey", "apply_map": [{"name": "k", "type": "count", "expr": "*"}], "apply_reduce": reduce}, {"name": "total", "type": "sum", "expr": "o_totalprice"}]
    pipes = [{"type": "splitter", "splitter": {"column": "o_orderstatus"}, "input": "orders", "apply": [{"type": "aggregate", "columns": columns, "output": "out"}]}]
    return _built(spark, sf_dir, ("orders",), pipes)["out"].withColumn("total", F.round("total", 4))


@query("SELECT o_orderstatus AS split_key, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) <= 20")
def sort_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipes = [{"type": "splitter", "splitter": {"column": "o_orderstatus"}, "input": "orders", "apply": [{"type": "sort", "sort_by": ["o_totalprice", "o_orderkey"], "max_output_records": 20, "output": "out"}]}]
    return _built(spark, sf_dir, ("orders",), pipes)["out"].select("split_key", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, c_name AS customer, c_acctbal AS balance FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of one look-up, joined once."""
    at = lambda name, value: {"name": name, "type": "lookup", "lookup_name": "customer", "key": ["o_custkey"], "table_key": ["c_custkey"], "value": value}
    columns = [chosen("o_orderkey"), at("customer", "c_name"), at("balance", "c_acctbal")]
    return _built(spark, sf_dir, ("orders", "customer"), _fan_out("orders", {"type": "map_record", "columns": columns, "output": "out"}))["out"]


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000")
def conditional_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition over the environment merges a field into one application and replaces another."""
    when = lambda mode: op("==", col("$MODE"), val(f"'{mode}'"))
    keep = {"type": "filter", "filter": op(">", col("o_totalprice"), val(1)), "output": "large", "conditional_config": [{"when": when("strict"), "then": {"filter": op(">", col("o_totalprice"), val(250000))}}, {"when": when("other"), "then": {"output": "none"}}]}
    cut = {"type": "sort", "sort_by": ["o_orderkey"], "max_output_records": 3, "output": "out", "conditional_config": [{"when": when("strict"), "then": {"type": "map_record", "columns": [chosen("o_orderkey"), chosen("o_totalprice")], "output": "out"}}]}
    return _built(spark, sf_dir, ("orders",), [*_fan_out("orders", keep), *_fan_out("large", cut)], {"MODE": "strict"})["out"]


@query(f"SELECT c_custkey, 'cn.' || {_fnv_hex('c_name')} AS c_name, {_fnv_hex('c_mktsegment')} AS c_mktsegment, '' AS c_phone FROM customer")
def anonymize_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions from a profile's metadata: hidden and de-identified texts, the latter by function or blanked."""
    t = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_name").alias("c_phone"))
    meta = lambda *rows: spark.createDataFrame(list(rows), "column_pos int, data_classification string, key_prefix string")
    first = {"type": "anonymize", "metadata": "names", "texts": ["name"], "output": "hidden"}
    second = {"type": "anonymize", "metadata": "others", "mode": "de-identification", "texts": ["segment", "phone"], "deid_functions": {"segment": "alphanumeric_hashed_value"}, "output": "out", "keys_output": "keys"}
    sources = {"in": t, "names": meta((1, "name", "cn")), "others": meta((2, "segment", None), (3, "phone", None))}
    return pipeline.build(spark, {"sources": list(sources), "steps": [{"pipes": [*_fan_out("in", first), *_fan_out("hidden", second)]}]}, sources)["out"]


@query("SELECT o_custkey::VARCHAR AS session, o_orderkey::VARCHAR AS s, CASE WHEN o_totalprice > 400000 AND starts_with(o_orderpriority, '1') THEN 'review' END AS level, CASE WHEN o_totalprice > 400000 THEN 'yes' END AS large FROM orders")
def rules_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a configuration, with filters by operator name."""
    program = [
        {"name": "large", "when": [["?x", "rdf:type", "Order"], ["?x", "o_totalprice", "?t"]], "where": [">", ["to_double", "?t"], 400000], "then": [["?x", "large", "yes"]]},
        {"name": "review", "when": [["?x", "large", "yes"], ["?x", "o_orderpriority", "?p"]], "where": ["starts_with", "?p", "'1'"], "then": [["?x", "level", "review"]]},
    ]
    rule = {"type": "rules", "session": "o_custkey", "key": "o_orderkey", "class_name": "Order", "rules": program, "extract": [{"class_name": "Order", "properties": ["level", "large"]}], "output": "out"}
    t = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    return pipeline.build(spark, {"sources": ["orders"], "steps": [{"pipes": _fan_out("orders", rule)}]}, {"orders": t})["out"]


@query("SELECT c_custkey, upper(c_name) AS name, c_mktsegment FROM customer")
def partition_writer_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by key with evaluated columns, and read back from the files."""
    columns = [chosen("c_custkey"), {"name": "name", "type": "map", "expr": "c_name", "map_expr": {"cleansing_function": "to_upper"}}]
    writer = {"type": "partition_writer", "path": _folder(spark, "writer"), "keys": ["c_mktsegment"], "partition_size": 1000, "columns": columns, "output": "out"}
    return _built(spark, sf_dir, ("customer",), _fan_out("customer", writer))["out"].select("c_custkey", "name", "c_mktsegment")


@query("SELECT n_nationkey::VARCHAR AS key, n_name AS name FROM nation")
def merge_files_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV file with headers of its own, read back through a channel that names it."""
    path = _folder(spark, "merged")
    narrow = {"type": "map_record", "columns": [chosen("n_nationkey"), chosen("n_name")], "output": "narrow"}
    _built(spark, sf_dir, ("nation",), [*_fan_out("nation", narrow), {"type": "merge_files", "input": "narrow", "path": path, "format": "csv", "headers": ["key", "name"]}])
    out = pipeline.build(spark, {"channels": {"merged": {"type": "csv", "path": "$AT", "several_columns": True}}, "steps": []}, {}, {"AT": path})
    return out["merged"]


@query("SELECT event_id, (year(ts) - 1970) * 12 + month(ts) AS period FROM events WHERE (year(ts) - 1970) * 12 + month(ts) BETWEEN 647 AND 649")
def lookback_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "events").select("event_id", dates.month_period(F.col("ts")).cast("long").alias("period"))
    back = {"type": "lookback", "period_column": "period", "period": "offset:1", "periods": 2, "output": "out"}
    return pipeline.build(spark, {"sources": ["in"], "steps": [{"pipes": _fan_out("in", back)}]}, {"in": t}, {"PERIOD_ID": 650})["out"]


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) WHERE k % 25 = 0")
def sampling_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = {"type": "sampling", "order": "o_orderkey", "sampling_rate": 25, "output": "out"}
    return _built(spark, sf_dir, ("orders",), _fan_out("orders", sample))["out"].select("o_orderkey")


@query("SELECT count(*) AS rows, NULL::VARCHAR AS a FROM range(70)")
def generator_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated rows from a channel of the configuration."""
    count = {"type": "aggregate", "columns": [{"name": "rows", "type": "count", "expr": "*"}, {"name": "a", "type": "max", "expr": "a"}], "output": "out"}
    return pipeline.build(spark, {"channels": {"empty": {"type": "generator", "rows": "$N", "columns": ["a"]}}, "steps": [{"pipes": _fan_out("empty", count)}]}, {}, {"N": 70})["out"]


@query("""SELECT o_orderkey, CASE WHEN o_custkey IS NOT NULL THEN 1 ELSE 0 END AS there, CASE WHEN o_totalprice >= 150000 THEN 1 ELSE 0 END AS large, o_orderdate::DATE AS day, CASE WHEN o_totalprice / 3 * 3 - o_totalprice < 1 THEN 1 ELSE 0 END AS same FROM orders""")
def expression_operators_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "orders").select("*", F.date_format("o_orderdate", "MM/dd/yyyy").alias("text_day"))
    nodes = {"there": op("IS NOT", col("o_custkey"), val("NULL")), "large": op(">=", col("o_totalprice"), val(150000)), "day": {"op": "TO_DATE", "arg": col("text_day")}, "same": op("<", op("-", op("*", op("/", col("o_totalprice"), val("3.0")), val("3.0")), col("o_totalprice")), val(1))}
    return transforms.map_record(t, [chosen("o_orderkey"), *(evaluated(k, v) for k, v in nodes.items())])


@query("""SELECT c_custkey, trim(c_name) AS trimmed, c_name || c_mktsegment AS joined, string_split(c_name, '#')[1] || '|' || string_split(c_name, '#')[2] AS parts, array_to_string(list_sort(list_transform(list_distinct(string_split(c_mktsegment, 'I')), lambda x: x || '-0')), '|') AS distinct_parts, '2024-03-01' AS day FROM customer""")
def cleansing_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("wide"), F.lit("2024-03-01").alias("day"))
    f = lambda name, x, arg="": cleansing.cleanse(name, F.col(x), arg)[0]
    return t.select("c_custkey", f("trim", "wide").alias("trimmed"), f("concat", "c_name", "c_mktsegment").alias("joined"), F.array_join(f("split_on", "c_name", "#"), "|").alias("parts"), F.array_join(F.array_sort(F.array_distinct(f("unique_split_on", "c_mktsegment", "I"))), "|").alias("distinct_parts"), f("validate_date", "day").alias("day"))


# --- rules, structured queries, streams -------------------------------------------------------


@query("""SELECT o_custkey::VARCHAR AS session, o_orderkey::VARCHAR AS s, CASE WHEN o_totalprice > 400000 AND o_orderpriority = '1-URGENT' THEN 'review' WHEN o_totalprice > 400000 THEN 'large' ELSE 'plain' END AS level FROM orders""")
def rules_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained rules with a filter and negation."""
    facts = rules.assert_records(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority"), "o_custkey", "o_orderkey", "Order")
    program = [
        rules.Rule("large", (rules.Match("?x", "rdf:type", "Order"), rules.Match("?x", "o_totalprice", "?t")), (("?x", "size", "large"),), lambda v: v["?t"].cast("double") > 400000),
        rules.Rule("review", (rules.Match("?x", "size", "large"), rules.Match("?x", "o_orderpriority", "1-URGENT")), (("?x", "level", "review"),)),
        rules.Rule("review flag", (rules.Match("?x", "level", "review"),), (("?x", "flagged", "yes"),)),
        rules.Rule("only large", (rules.Match("?x", "size", "large"), rules.Match("?x", "flagged", "yes", negated=True)), (("?x", "band", "large"),)),
        rules.Rule("plain", (rules.Match("?x", "rdf:type", "Order"), rules.Match("?x", "size", "large", negated=True)), (("?x", "band", "plain"),)),
    ]
    out = rules.extract_entities(rules.infer(facts, program), "Order", ["level", "band"])
    return out.select("session", "s", F.coalesce("level", "band").alias("level"))


@query("SELECT c_mktsegment AS segment, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 300000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderpriority LIKE '1%' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 5")
def sql_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = {
        "with": {"large": {"from": ["orders"], "where": [{"column": "o_totalprice", "ge": 300000}], "columns": [{"column": c} for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")]}},
        "from": ["large", "customer"],
        "where": [{"column": "large.o_custkey", "join_with": "customer.c_custkey"}, {"column": "c_mktsegment", "in": ["BUILDING", "MACHINERY"]}, {"column": "o_orderpriority", "like": "1%"}],
        "order_by": [{"column": "o_totalprice", "descending": True}, {"column": "o_orderkey"}],
        "limit": 50,
        "offset": 5,
        "columns": [{"column": "c_mktsegment", "as": "segment"}, {"column": "o_orderkey"}, {"column": "o_totalprice"}],
    }
    return structured.select({n: _t(spark, sf_dir, n) for n in ("orders", "customer")}, q)


@query("SELECT r_name, count(*) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA' GROUP BY r_name")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    for n in ("region", "nation"):
        _t(spark, sf_dir, n).createOrReplaceTempView(f"report_{n}")
    text = "--by_region; SELECT r_name, count(*) AS nations FROM report_region JOIN report_nation ON r_regionkey = n_regionkey WHERE r_name <> $SKIP GROUP BY r_name;"
    return structured.run_report(spark, structured.report_statements(text)["by_region"], {"SKIP": "ASIA"})


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "events")
    return runner.windowed_counts(t, "ts", ["event_type"]).withColumn("window_start", F.col("window_start").cast(t.schema["ts"].dataType))
