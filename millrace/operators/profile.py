"""Column profiling: one row for each column of the input, in one unpivot and one aggregate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleansing import java_regex

#: Look-up lists of so many words at most are tried on values of several words.
MOST_WORDS = 10_000
#: Upper-cased texts that stand for null.
NULLS = ("", "NULL", "NONE", "0000")


@dataclass(frozen=True)
class Profile:
    """What to measure besides lengths, nulls and distinct values."""

    regex: dict[str, str] = field(default_factory=dict)
    keywords: dict[str, list[str]] = field(default_factory=dict)
    lookups: dict[str, DataFrame] = field(default_factory=dict)
    blanks: tuple[str, ...] = ()
    scrub: str = ""
    date_formats: tuple[str, ...] = ("yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd")
    distinct_below: int = 20
    entity_hints: tuple[tuple[str, str], ...] = ()
    #: (name or fragment of a name, token), the first that fits counts, whole names before fragments.
    name_tokens: tuple[tuple[str, str], ...] = ()
    #: Doubles of at least this size are large.
    large_double: float = 1e9
    hit_ratio: float = 0.98


def analyze(df: DataFrame, spec: Profile | None = None, keys: list[str] | None = None, first: dict[str, str] | None = None) -> DataFrame:
    """A row for each column (of each key). ``first`` names columns whose value of any row is carried over. An empty table is an error.

    Counts, lengths (bytes; population variance), token shares in percent of non-null values, dates, numbers, and the least and greatest value in the kind that nearly all values have."""
    s = spec or Profile()
    keys = keys or []
    columns = [c for c in df.columns if c not in keys]
    if df.isEmpty():
        raise ValueError("an empty table can't be analysed")
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("column_pos"), F.lit(df.schema[c].dataType.simpleString()).alias("input_data_type"), F.upper(F.col(f"`{c}`").cast("string")).alias("v")) for k, c in enumerate(columns)))
    carried = first or {}
    long = df.select(*(F.col(f"`{k}`") for k in keys), *(F.col(f"`{c}`").alias(n) for c, n in carried.items()), F.explode(cells).alias("c")).select(*keys, *carried.values(), "c.*")
    null = F.col("v").isNull() | F.trim("v").isin(*NULLS) | F.col("v").isin(*(b.upper() for b in s.blanks))
    clean = F.regexp_replace("v", r"^0{1,}(?=.{4,})", "")
    if s.scrub:
        clean = F.translate(clean, s.scrub, "")
    for k, table in enumerate(s.lookups.values()):
        words = table.select(F.upper(F.col(table.columns[0]).cast("string")).alias("v"), F.lit(True).alias(f"_l{k}")).distinct()
        long = long.join(words, "v", "left")
        # several words: all must be listed; one letter at the end of a value may dangle
        parts = table.select(F.collect_set(F.upper(F.col(table.columns[0]).cast("string"))).alias(f"_w{k}"))
        if table.limit(MOST_WORDS + 1).count() <= MOST_WORDS:
            own = parts.first()[0] or []
            inside = F.forall(F.filter(F.split(F.regexp_replace("v", r" [A-Z]\.?$", ""), r"[ ,.]+"), lambda w: w != ""), lambda w: w.isin(own)) if own else F.lit(False)
            long = long.withColumn(f"_l{k}", F.coalesce(f"_l{k}", F.col("v").isNotNull() & inside))
    long = long.withColumn("v", F.when(~null, F.col("v"))).withColumn("x", F.when(~null, clean))
    dates = F.coalesce(*(F.try_to_timestamp("v", F.lit(f)) for f in s.date_formats)).cast("date")
    long = long.withColumn("_day", F.when(F.year(dates).between(1920, 2300), dates)).withColumn("_number", F.col("v").try_cast("double"))
    n = F.count("v")
    share = lambda hit: F.round(F.when(n > 0, 100.0 * F.count_if(hit) / n).otherwise(-1.0), 6)
    size = F.octet_length("v")
    aggs = [
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(F.col("v").isNull()).alias("null_count"),
        F.round(100.0 * F.count_if(F.col("v").isNull()) / F.count(F.lit(1)), 6).alias("null_count_pct"),
        F.count_distinct("v").alias("distinct_count"),
        F.round(F.when(n > 0, 100.0 * F.count_distinct("v") / n).otherwise(-1.0), 6).alias("distinct_count_pct"),
        F.round(F.avg(size), 6).alias("avr_length"),
        F.round(F.var_pop(size), 6).alias("length_var"),
        F.min(size).alias("min_length"),
        F.max(size).alias("max_length"),
        share(F.col("_day").isNotNull()).alias("date_pct"),
        share(F.col("_number").isNotNull()).alias("double_pct"),
        F.min("_day").alias("_d0"),
        F.max("_day").alias("_d1"),
        F.min("_number").alias("_n0"),
        F.max("_number").alias("_n1"),
        *([F.max(F.coalesce(F.translate("v", s.scrub, "") != F.col("v"), F.lit(False)).cast("int")).alias("contains_scrub_char")] if s.scrub else []),
        *(share(F.col("v").rlike(java_regex(p)) | F.col("x").rlike(java_regex(p))).alias(f"{t}_pct") for t, p in s.regex.items()),
        *(share(F.col("v").rlike("|".join(rf"\Q{w.upper()}\E" for w in own))).alias(f"{t}_pct") for t, own in s.keywords.items()),
        *(share(F.col(f"_l{k}")).alias(f"{t}_pct") for k, t in enumerate(s.lookups)),
    ]
    by_format = [(F.count_if(F.try_to_timestamp("v", F.lit(f)).isNotNull()).alias(f"_f{k}")) for k, f in enumerate(s.date_formats)]
    large = share(F.abs("_number") >= s.large_double).alias("large_double_pct")
    out = long.groupBy(*keys, "column_name", "column_pos", "input_data_type").agg(*aggs, large, *by_format, *(F.first(n, ignorenulls=True).alias(n) for n in carried.values()))
    # the three formats that most dates have
    ranked = F.array_sort(F.array(*(F.struct((-F.col(f"_f{k}")).alias("n"), F.lit(f).alias("f")) for k, f in enumerate(s.date_formats))))
    top = F.transform(F.slice(F.filter(ranked, lambda x: x["n"] < 0), 1, 3), lambda x: x["f"])
    out = out.withColumn("date_formats", F.when(F.col("date_pct") >= 75, F.array_join(top, ","))).drop(*(f"_f{k}" for k in range(len(s.date_formats))))
    least = s.hit_ratio * 100
    kind = F.when(F.col("date_pct") > least, "date").when(F.col("double_pct") > least, "double").otherwise("text")
    out = out.withColumn("minmax_type", kind)
    for name, k in (("min", 0), ("max", 1)):
        value = F.when(F.col("minmax_type") == "date", F.col(f"_d{k}").cast("string")).when(F.col("minmax_type") == "double", F.col(f"_n{k}").cast("string"))
        out = out.withColumn(f"{name}_value", value.otherwise(F.col(f"{name}_length").cast("string")))
    hint = F.lit(None).cast("string")
    for fragment, entity in reversed(s.entity_hints):
        hint = F.when(F.upper("column_name").contains(fragment.upper()), F.lit(entity)).otherwise(hint)
    token = F.lit(None).cast("string")
    for name, own in reversed(s.name_tokens):
        token = F.when(F.upper("column_name").contains(name.upper()), F.lit(own)).otherwise(token)
    for name, own in reversed(s.name_tokens):
        token = F.when(F.upper("column_name") == name.upper(), F.lit(own)).otherwise(token)
    values = long.where("v IS NOT NULL").select(*keys, "column_name", "v").distinct().join(out.where(F.col("distinct_count") < s.distinct_below).select(*keys, "column_name"), [*keys, "column_name"], "left_semi")
    listed = values.groupBy(*keys, "column_name").agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias("distinct_values"))
    return out.drop("_d0", "_d1", "_n0", "_n1").withColumn("entity_hint", hint).withColumn("name_token", token).join(listed, [*keys, "column_name"], "left")
