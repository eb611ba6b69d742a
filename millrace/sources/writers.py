"""Sinks: partitioned and merged text and Parquet files, fixed width, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..storage import drop, stored


def write_partitions(df: DataFrame, path: str, keys: list[str], kind: str = "parquet", rows_each: int = 0, **options: object) -> None:
    """A folder for each key, its files at most ``rows_each`` rows; rows are dealt so that a hot key still has many writers."""
    writer = df.hint("rebalance", *keys).write.mode("overwrite").option("maxRecordsPerFile", rows_each).options(**{k: str(v) for k, v in options.items()})
    writer.partitionBy(*keys).format(kind).save(path)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, quote_all: bool = False, encoding: str = "UTF-8", compression: str = "none") -> None:
    df.write.mode("overwrite").csv(path, sep=delimiter, header=header, quoteAll=quote_all, encoding=encoding, compression=compression)


def fixed_width_lines(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """One text column: each value cut or padded on the right to its width, null as blanks."""
    return df.select(F.concat(*(F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), n, " ") for c, n in widths.items())).alias("value"))


def write_fixed_width(df: DataFrame, path: str, widths: dict[str, int]) -> None:
    fixed_width_lines(df, widths).write.mode("overwrite").text(path)


def merge_files(df: DataFrame, path: str, kind: str = "csv", header: bool = True, headers: list[str] | None = None, **options: object) -> None:
    """One output file of all rows; an export for a reader that takes one, not a step within a plan.

    The rows are written in parallel first and read back, so that only the
    last copy runs in one task. Text has one header line, ``headers`` if given,
    for other kinds there is none.
    """
    spark = df.sparkSession
    parts = stored(df.toDF(*headers) if headers else df, "merge")
    own = {"header": header, **options} if kind == "csv" else options
    parts.coalesce(1).write.mode("overwrite").format(kind).options(**{k: str(v) for k, v in own.items()}).save(path)
    drop(spark, parts)


def coerced(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast to the types of a Parquet schema; what doesn't fit becomes null. Lists of one value are that value."""
    out = {}
    for f in df.schema:
        if f.name in types:
            c = F.col(f"`{f.name}`")
            if f.dataType.typeName() == "array" and not types[f.name].startswith("array"):
                c = F.get(c, F.lit(0))
            if types[f.name] == "date" and f.dataType.typeName() == "string":
                out[f.name] = parse_date(c)
            else:
                out[f.name] = c.cast("string").try_cast(types[f.name]) if types[f.name] != "string" else c.cast("string")
    return df.withColumns(out)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A report's rows as CSV with a header, JSON lines or Parquet."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown report format: {kind}")
    df.write.mode("overwrite").format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)


def write_column_list(spark: SparkSession, columns: list[str], path: str) -> None:
    """A quoted header line in a file of its own."""
    line = ",".join('"' + c.replace('"', '""') + '"' for c in columns)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def copy_files(spark: SparkSession, source: str, target: str) -> None:
    """A file or folder copied from one store to another, by Hadoop's own file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf):
        raise OSError(f"not copied: {source}")


def write_table(df: DataFrame, name: str, most_new: int = 20) -> None:
    """Appends to a table; up to ``most_new`` columns that it lacks are added, more are an error."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        df.write.saveAsTable(name)
        return
    have = set(spark.table(name).columns)
    new = [f for f in df.schema if f.name not in have]
    if len(new) > most_new:
        raise ValueError(f"{len(new)} columns are not in {name}")
    if new:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
    columns = spark.table(name).columns
    df.select(*(F.col(f"`{c}`") if c in df.columns else F.lit(None).alias(c) for c in columns)).write.insertInto(name)
