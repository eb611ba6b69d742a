"""Row, group and bundle transformations.

Where the order of rows matters an order column is named; nothing relies on
the order in which partitions happen to be read. A null group key is a group
of its own. All operators leave other columns as they are.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StructType, TimestampNTZType, TimestampType

from ..functions.hashing import fnv1a_hex
from ..functions.keys import composite_key
from ..plans.evaluators import AGGREGATES, aggregate, row_columns, values_of
from ..plans.expressions import predicate
from ..storage import stored


def ranges(df: DataFrame, order: str, rows: int | None = None) -> Column:
    """The range, of about ``rows`` rows, that a row's ``order`` falls into; a struct's by its first field. Orders that aren't numbers or times are one range.

    Runs one pass over the order column while planning, for its quantiles.
    """
    kind, at = df.schema[order].dataType, F.col(order)
    if isinstance(kind, StructType):
        kind, at = kind[0].dataType, at.getField(kind[0].name)
    if not isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType)):
        return F.lit(0)
    n, found = df.select(F.count(F.lit(1)), F.percentile_approx(at, [k / MOST_RANGES for k in range(1, MOST_RANGES)])).first()
    many = min(MOST_RANGES, n // (rows or RANGE_ROWS) + 1)
    cuts = sorted({found[MOST_RANGES * k // many - 1] for k in range(1, many)}) if found else []
    return F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < at)) if cuts else F.lit(0)


#: Rows of a range that one task orders, about, and how many ranges there are at most.
RANGE_ROWS, MOST_RANGES = 1_000_000, 1024


def numbered(df: DataFrame, order: str, name: str = "_n", within: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Row numbers from 0 in ``order``, for the whole table or within each key, without bringing all rows of either to one task: numbers within ranges, plus the ranges' offsets."""
    keys = within or []
    own = df.withColumn("_b", ranges(df, order, rows))
    before = own.groupBy(*keys, "_b").count().select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_b0"), (F.sum("count").over(W.partitionBy(*keys).orderBy("_b")) - F.col("count")).alias("_c"))  # a row for each range
    at = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(order)) - 1
    same = F.col("_b") == F.col("_b0")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return own.withColumn(name, at).join(before, same).withColumn(name, (F.col(name) + F.col("_c")).cast("long")).drop("_b", "_b0", "_c", *(f"_k{i}" for i in range(len(keys))))


def first_rows(df: DataFrame, most: int, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """``most`` rows of each key, the first in ``by``, else any; a hot key is cut down in parts before it meets in one task."""
    salt = F.pmod(F.spark_partition_id(), F.lit(64))
    order = by or [F.lit(0)]
    few = df.withColumn("_s", salt).withColumn("_n", F.row_number().over(W.partitionBy(*keys, "_s").orderBy(*order))).where(F.col("_n") <= most)
    return few.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_s", "_n")


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``a`` with the columns of ``b`` that has a row for each of the same keys; null keys are equal. Without keys both have one row."""
    if not keys:
        keys, a, b = ["_one"], a.withColumn("_one", F.lit(1)), b.withColumn("_one", F.lit(1))
    names = {k: f"_r{i}" for i, k in enumerate(keys)}
    b = b.withColumnsRenamed(names)
    on = F.lit(True)
    for k, r in names.items():
        on = on & F.col(k).eqNullSafe(F.col(r))
    return a.join(b, on).drop(*names.values(), "_one")


def map_record(df: DataFrame, columns: list[dict[str, Any]], env: dict[str, Any] | None = None, new_record: bool = True, errors: str | None = None, tables: dict[str, DataFrame] | None = None, keep: list[str] | None = None, class_name: str | None = None, row_key: str | None = None, fail_on_error: bool = False) -> DataFrame:
    """Evaluates ``columns`` into a new record (with the columns in ``keep``), or onto the input's; ``errors`` names an array of the columns in error.

    Columns of type lookup take their values from ``tables``. ``class_name``
    fills ``rdf:type`` where it is null, ``row_key`` names a column that gets a
    hash of the whole input row where it is null. ``fail_on_error`` makes the
    first error end the query.
    """
    df, columns = with_lookups(df, columns, tables or {})
    named: list[tuple[str, Column]] = [(k, F.col(f"`{k}`")) for k in (keep or [])] if new_record else []
    bad: list[Column] = []
    for spec in columns:
        own, error = row_columns(spec, df.schema, env)
        named += own
        if error is not None:
            bad.append(F.when(F.coalesce(error, F.lit(False)), F.lit(own[0][0])))
    if class_name:
        have = F.col("`rdf:type`") if "rdf:type" in df.columns and not new_record else F.lit(None).cast("array<string>")
        named.append(("rdf:type", F.coalesce(have, F.array(F.lit(class_name)))))
    if row_key:
        have = F.col(f"`{row_key}`").cast("string") if row_key in df.columns else F.lit(None).cast("string")
        own = [c for c in df.columns if c != row_key and not c.startswith("_lookup")]
        named.append((row_key, F.coalesce(have, row_hash(own))))
    if fail_on_error and bad:
        first = F.coalesce(*bad)
        name, value = named[-1]
        named[-1] = (name, F.when(first.isNotNull(), F.raise_error(F.concat(F.lit("column in error: "), first))).otherwise(value))
    if errors:
        named.append((errors, F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")))
    if new_record:
        return df.select(*(c.alias(n) for n, c in named))
    return df.withColumns(dict(named)).drop(*(c for c in df.columns if c.startswith("_lookup")))


def row_hash(columns: list[str]) -> Column:
    """16 hex digits of the FNV-1a hash of the columns' texts, each with its length before it, null apart from empty."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return fnv1a_hex(F.concat_ws("|", *(part(F.col(f"`{c}`").cast("string")) for c in columns)))


def with_lookups(df: DataFrame, columns: list[dict[str, Any]], tables: dict[str, DataFrame]) -> tuple[DataFrame, list[dict[str, Any]]]:
    """The rows with the values that lookup columns ask for, each table joined once for each key; and the columns, lookups as selections of these values."""
    out, joins = [], {}
    for spec in columns:
        if spec["type"] != "lookup":
            out.append(spec)
            continue
        if spec["lookup_name"] not in tables:
            raise ValueError(f"unknown lookup table: {spec['lookup_name']}")
        own = joins.setdefault((spec["lookup_name"], tuple(spec["key"]), tuple(spec["table_key"]), spec.get("order")), {})
        at = own.setdefault(spec["value"], f"_lookup{len(joins)}_{len(own)}")
        out.append({"type": "select", "name": spec["name"], "expr": at, **({"as_rdf_type": spec["as_rdf_type"]} if spec.get("as_rdf_type") else {})})
    for (name, key, table_key, order), values in joins.items():
        df = lookup(df, tables[name], list(key), list(table_key), values, order)
    return df, out


def split_errors(df: DataFrame, errors: str) -> tuple[DataFrame, DataFrame]:
    """The records without their error column, and a row for each error."""
    return df.drop(errors), df.select(F.explode(errors).alias("column_in_error"), *(c for c in df.columns if c != errors))


def lookup(df: DataFrame, table: DataFrame, keys: list[Column | str], table_keys: list[str], values: dict[str, str], order: str | None = None, where: Column | None = None) -> DataFrame:
    """Left join with a lookup table, ``values`` mapping its columns to output names; of rows with equal keys the last in ``order`` counts.

    Keys are compared part by part as text. Spark broadcasts the table when it
    is small by its own statistics and sorts and merges otherwise.
    """
    own = table.select(*(F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(table_keys)), *(F.col(c).alias(n) for c, n in values.items()), *([F.col(order).alias("_o")] if order else []))
    ks = [f"_k{i}" for i in range(len(table_keys))]
    if order:
        row = F.struct(*values.values())
        own = own.groupBy(*ks).agg(F.max_by(row, "_o").alias("_r")).select(*ks, *(F.col(f"_r.{n}").alias(n) for n in values.values()))
    else:
        own = own.dropDuplicates(ks)
    keyed = df.select("*", *((F.col(k) if isinstance(k, str) else k).cast("string").alias(f"_k{i}") for i, k in enumerate(keys)))
    return keyed.join(own, ks, "left").drop(*ks)


def filter_rows(df: DataFrame, when: dict[str, Any] | None = None, env: dict[str, Any] | None = None, most: int | None = None, columns: list[dict[str, Any]] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Rows for which the expression holds, ``most`` at most (of each key; 0 and None: no limit), optionally mapped."""
    out = df.where(predicate(when, df.schema, env)) if when else df
    if most:
        out = first_rows(out, most, keys) if keys else out.limit(most)
    return map_record(out, columns, env, keep=keys) if columns else out


def aggregate_rows(df: DataFrame, columns: list[dict[str, Any]], keys: list[str] | None = None, env: dict[str, Any] | None = None, order: str | None = None) -> DataFrame:
    """One row, for an empty input too, or one for each key of a splitter. Columns that don't aggregate are taken from the first row."""
    aggs, keys, names = [], keys or [], []
    apart: list[DataFrame] = []
    for spec in columns:
        if spec["type"] == "map_reduce":
            own = map_reduce(df, spec["map_on"], spec["apply_map"], spec["apply_reduce"], keys, env, order, spec.get("alternate_map_on"))
            apart.append(own)
            names += [c for c in own.columns if c not in keys]
            continue
        names.append(spec["name"] if "name" in spec else None)
        if spec["type"] == "avrg":
            apart.append(blended(df, spec, keys, env, order))
        elif spec["type"] in AGGREGATES:
            aggs.append(aggregate(spec, df.schema, env).alias(spec["name"]))
        elif spec["type"] != "value" and order:
            aggs += [F.min_by(c, F.col(order)).alias(n) for n, c in row_columns(spec, df.schema, env)[0]]
        else:
            aggs += [F.first(c, ignorenulls=spec["type"] != "value").alias(n) for n, c in row_columns(spec, df.schema, env)[0]]
    if not apart:
        return df.groupBy(*keys).agg(*aggs)
    out = df.groupBy(*keys).agg(*(aggs or [F.lit(1).alias("_none")]))
    for own in apart:  # a row for each key, like the aggregates beside them
        out = same_keys(out, own, keys)
    return out.drop("_none") if None in names else out.select(*keys, *(F.col(f"`{n}`") for n in names))


def blended(df: DataFrame, spec: dict[str, Any], keys: list[str], env: dict[str, Any] | None, order: str | None) -> DataFrame:
    """``avrg``: each value in order moves the blend by ``2 / (k + 1)`` of its distance, which for the kth of n values comes to ``2 sum(k x) / (n (n + 1))``.

    Sums within ranges of the order and the ranges' offsets give it without
    bringing a key's rows to one task.
    """
    if not order:
        raise ValueError("avrg depends on the order of rows: name an order column")
    x = values_of(spec, df.schema, env).cast("double")
    rows = df.select(*keys, F.col(order).alias("_o"), x.alias("_x"))
    rows = rows.withColumn("_b", ranges(rows, "_o")).withColumn("_k", F.sum(F.when(F.col("_x").isNotNull(), 1)).over(W.partitionBy(*keys, "_b").orderBy("_o").rowsBetween(W.unboundedPreceding, 0)))
    parts = rows.groupBy(*keys, "_b").agg(F.count("_x").alias("_n"), F.sum("_x").alias("_s"), F.sum(F.col("_k") * F.col("_x")).alias("_kx"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_b")) - F.col("_n")
    n = F.sum("_n").cast("double")
    return parts.withColumn("_c", before).groupBy(*keys).agg((2 * F.sum(F.col("_kx") + F.col("_c") * F.col("_s")) / F.nullif(n * (n + 1), F.lit(0.0))).alias(spec["name"]))


def map_reduce(df: DataFrame, map_on: Column | str, apply_map: list[dict[str, Any]], apply_reduce: list[dict[str, Any]], keys: list[str] | None = None, env: dict[str, Any] | None = None, order: str | None = None, alternate: list[str] | None = None) -> DataFrame:
    """Aggregates by key, then aggregates of the keys' rows. A null key gives way to the ``alternate`` columns; rows without either are skipped, but every outer key has a row."""
    outer = keys or []
    key = (F.col(map_on) if isinstance(map_on, str) else map_on).cast("string")
    if alternate:
        key = F.coalesce(key, composite_key(alternate))
    keyed = df.withColumn("_key", F.nullif(key, F.lit("")))
    mapped = aggregate_rows(keyed, apply_map, [*outer, "_key"], env, order)
    # rows without a key stay, so that each outer key has a row, and count for nothing
    values = [F.when(F.col("_key").isNotNull(), F.col(f"`{c}`")).alias(c) for c in mapped.columns if c not in (*outer, "_key")]
    return aggregate_rows(mapped.select(*outer, "_key", *values), [_counted(spec) for spec in apply_reduce], outer, env, order if order in mapped.columns else None)


def _counted(spec: dict[str, Any]) -> dict[str, Any]:
    """Counts of rows in the reduce step count keys."""
    return {**spec, "expr": "_key"} if spec["type"] == "count" and spec["expr"] == "*" else spec


def distinct_on(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row for each key: the first in ``order``, else any."""
    if not order:
        return df.dropDuplicates(keys)
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.col(order)).alias("_r"))  # combined before the shuffle
    return first.select("_r.*")


def sort_rows(df: DataFrame, by: list[str], most: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Ascending, nulls first; with ``most`` Spark keeps only that many rows of each task, or of each key."""
    if keys:
        return (first_rows(df, most, keys, by) if most else df).orderBy(*keys, *by)
    out = df.orderBy(*by)
    return out.limit(most) if most else out


def group_by(df: DataFrame, order: str, keys: list[str] | None = None, count: int | None = None, name: str = "rows", consecutive: bool = False, within: list[str] | None = None) -> DataFrame:
    """Bundles as arrays of structs in ``order``: all rows of a key, its runs of consecutive rows, or ``count`` rows at a time within ``within``."""
    row = F.struct(*[order, *(c for c in df.columns if c != order)])
    bundle = F.sort_array(F.collect_list(row)).alias(name)
    if count is not None:
        own = within or []
        rows = numbered(df, order, within=own)
        return rows.withColumn("bundle", F.floor(F.col("_n") / count)).groupBy(*own, "bundle").agg(bundle)
    if not keys:
        raise ValueError("group_by needs keys or a count")
    if not consecutive:
        return df.groupBy(*keys).agg(bundle)
    own = within or []
    # a run begins where the row before, by number, has other keys: a join of neighbours, then the starts alone are numbered
    rows = numbered(df, order, within=own)
    before = rows.select((F.col("_n") + 1).alias("_m"), *(F.col(c).alias(f"_w{i}") for i, c in enumerate(own)), *(F.col(k).alias(f"_p{i}") for i, k in enumerate(keys)))
    same = F.col("_n") == F.col("_m")
    for i, c in enumerate(own):
        same = same & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    changed = F.col("_m").isNull()
    for i, k in enumerate(keys):
        changed = changed | ~F.col(k).eqNullSafe(F.col(f"_p{i}"))
    marked = rows.join(before, same, "left").withColumn("_start", F.when(changed, F.col("_n"))).drop("_m", *(f"_w{i}" for i in range(len(own))), *(f"_p{i}" for i in range(len(keys))))
    # the last start at or before a row: within its block of numbers, else the last start of the blocks before
    block = F.floor(F.col("_n") / RANGE_ROWS)
    marked = marked.withColumn("_block", block)
    last = marked.groupBy(*own, "_block").agg(F.max("_start").alias("_last"))
    last = last.select(*(F.col(c).alias(f"_w{i}") for i, c in enumerate(own)), F.col("_block").alias("_b0"), F.max("_last").over(W.partitionBy(*own).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    here = F.col("_block") == F.col("_b0")
    for i, c in enumerate(own):
        here = here & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    inner = F.max("_start").over(W.partitionBy(*own, "_block").orderBy("_n"))
    runs = marked.withColumn("_in", inner).join(last, here).withColumn("bundle", F.coalesce("_in", "_carried"))
    return runs.groupBy(*own, "bundle", *keys).agg(bundle)


def merge(main: DataFrame, sources: list[DataFrame], keys: list[str], order: str, name: str = "rows") -> DataFrame:
    """Bundles of the main rows with all source rows of equal keys behind them; sources without main rows are dropped. Keys are compared as text."""
    text = [F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    shape = [order, *(c for c in main.columns if c != order)]

    def bundled(df: DataFrame, column: str) -> DataFrame:
        return df.select(*text, F.struct(*shape).alias("r")).groupBy(*ks).agg(F.sort_array(F.collect_list("r")).alias(column))

    out = bundled(main, name)
    for i, s in enumerate(sources):
        other = bundled(s.select(*(F.col(c).cast(main.schema[c].dataType) for c in main.columns)), f"_s{i}")
        same = [out[k].eqNullSafe(other[k]) for k in ks]
        out = out.join(other, same, "left").select(*(out[c] for c in out.columns), other[f"_s{i}"])
    extra = [F.coalesce(f"_s{i}", F.array().cast(main.select(F.array(F.struct(*shape))).schema[0].dataType)) for i in range(len(sources))]
    return out.select(*(F.col(k).alias(c) for k, c in zip(ks, keys, strict=True)), F.concat(name, *extra).alias(name))


def high_freq(df: DataFrame, columns: list[str], top_pct: float = 100, key_regex: dict[str, str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """(column_name, freq_count, freq_value) of upper-cased values, most frequent first, until their counts exceed ``top_pct`` % of the column's total (within each key); ties by value.

    Running sums go over the histogram of counts, a row for each distinct
    count, and only values of the count where the share is reached are ranked.
    """
    own = [*(keys or []), "column_name"]
    values = [F.struct(F.lit(c).alias("column_name"), F.upper(F.regexp_substr(F.col(c).cast("string"), F.lit(key_regex[c])) if key_regex and c in key_regex else F.col(c).cast("string")).alias("freq_value")) for c in columns]
    counts = df.select(*(keys or []), F.explode(F.array(*values)).alias("v")).select(*(keys or []), "v.*").where("freq_value IS NOT NULL AND freq_value <> ''").groupBy(*own, "freq_value").agg(F.count(F.lit(1)).alias("freq_count"))
    steps = counts.groupBy(*own, "freq_count").agg(F.count(F.lit(1)).alias("_n"))
    mass = F.sum(F.col("freq_count") * F.col("_n"))
    before = F.coalesce(mass.over(W.partitionBy(*own).orderBy(F.desc("freq_count")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    steps = steps.select(*own, "freq_count", before.alias("_before"), (mass.over(W.partitionBy(*own)) * F.lit(top_pct) / 100).alias("_most"), "_n").where("_before <= _most")
    # of a count, values number 0 to room are kept
    steps = steps.select(*own, "freq_count", F.floor((F.col("_most") - F.col("_before")) / F.col("freq_count")).alias("_room"), "_n")
    kept = same_rows(counts, steps, [*own, "freq_count"])
    whole, cut = kept.where("_room >= _n - 1"), kept.where("_room < _n - 1")
    cut = first_of(cut, own, "freq_value", "_room")
    return whole.unionByName(cut).select(*(keys or []), "column_name", "freq_count", "freq_value")


def same_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``a`` joined with ``b`` on equal keys, null ones too."""
    names = {k: f"_r{i}" for i, k in enumerate(keys)}
    on = F.lit(True)
    for k, r in names.items():
        on = on & F.col(k).eqNullSafe(F.col(r))
    return a.join(b.withColumnsRenamed(names), on).drop(*names.values())


def first_of(df: DataFrame, keys: list[str], order: str, room: str) -> DataFrame:
    """Of each key the rows numbered 0 to ``room`` in a text order, in two steps: within ranges of the text's beginning, then by the ranges' offsets."""
    own = df.withColumn("_b", F.substring(F.col(order), 1, 2))
    sizes = own.groupBy(*keys, "_b").count()
    sizes = sizes.select(*keys, "_b", (F.sum("count").over(W.partitionBy(*keys).orderBy("_b")) - F.col("count")).alias("_c"))
    at = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(order)) - 1
    out = same_rows(own.withColumn("_k", at), sizes, [*keys, "_b"])
    return out.where(F.col("_k") + F.col("_c") <= F.col(room)).drop("_b", "_k", "_c")


def shuffling(df: DataFrame, most_input: int, output: int, seed: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """``output`` rows, each cell an independent pick from its column among ``most_input`` input rows.

    The pool is numbered once; each cell draws a number and is joined to it, so
    neither the pool nor the output has to fit in one task.
    """
    own = keep or df.columns
    pool = df.select(*own).limit(most_input)
    pool = stored(pool.withColumn("_i", F.monotonically_increasing_id()), "pool")
    n = pool.count()
    if not n:
        return pool.drop("_i")
    pool = numbered(pool, "_i", "_at").drop("_i")
    draw = lambda k: F.least(F.floor(F.rand(None if seed is None else seed + k) * n), F.lit(n - 1)).alias(f"_d{k}")
    out = df.sparkSession.range(output).select("id", *(draw(k) for k in range(len(own))))
    for k, c in enumerate(own):
        out = out.join(pool.select(F.col("_at").alias(f"_d{k}"), F.col(f"`{c}`").alias(f"_c{k}")), f"_d{k}", "left").drop(f"_d{k}")
    return out.select(*(F.col(f"_c{k}").alias(c) for k, c in enumerate(own)))


def splitter(df: DataFrame, column: str | None = None, default: str | None = None, shard: Column | None = None, rows_each: int | None = None, order: str | None = None, name: str = "split_key") -> DataFrame:
    """Adds the key of the sub-pipeline: a column, a hash, or a default; with ``rows_each`` cut again every so many rows of ``order``."""
    key = F.col(column).cast("string") if column else (shard.cast("string") if shard is not None else F.lit(default))
    if column and default is not None:
        key = F.coalesce(key, F.lit(default))
    out = df.withColumn(name, key)
    if rows_each:
        if not order:
            raise ValueError("cutting by row count needs an order column")
        out = numbered(out, order, within=[name])
        n = F.floor(F.col("_n") / rows_each).cast("string")
        out = out.withColumn(name, F.concat_ws("|", name, n)).drop("_n")
    return out


def lookback(df: DataFrame, period_column: str, period: int, periods: int) -> DataFrame:
    """The rows of a period and of those before it; prunes partitions when stored by period."""
    return df.where(F.col(period_column).between(period - periods, period))


def sample_rows(df: DataFrame, order: str, every: int | None = None, most: int | None = None) -> DataFrame:
    """Every nth row in ``order``, the first always, ``most`` at most."""
    out = df
    if every and every > 1:
        out = numbered(out, order).where(F.col("_n") % every == 0).drop("_n")
    return out.orderBy(order).limit(most) if most else out
