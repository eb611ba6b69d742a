"""Readers: delimited and fixed-width text, Parquet, spreadsheets, generated rows.

Columns are text unless a schema of classes types them; texts are trimmed and
empty ones null. Delimiter, encoding and line ends are detected on the driver
from the first bytes, read through Spark so that any store will do.
"""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BAD = "_corrupt_record"


def unique_headers(names: list[str]) -> list[str]:
    """Repeated names get ``_2``, ``_3`` and so on."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def first_bytes(spark: SparkSession, path: str, most: int = 1 << 16) -> bytes:
    """The first bytes of the first file at ``path``, which is listed and read alone, whatever the size of the files."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(conf)
    found = []
    for s in store.globStatus(at) or []:
        found += list(store.listStatus(s.getPath())) if s.isDirectory() else [s]
    names = sorted((str(s.getPath()), s.getLen()) for s in found if not s.isDirectory() and s.getPath().getName()[0] not in "._")
    names = [n for n, size in names if size] or [n for n, _ in names]
    if not names:
        return b""
    stream = store.open(jvm.org.apache.hadoop.fs.Path(names[0]))
    try:
        bounded = jvm.org.apache.commons.io.input.BoundedInputStream(stream, most)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(bounded))
    finally:
        stream.close()


def detect_encoding(head: bytes) -> str:
    if head.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "UTF-16"
    if head[1:40:2].count(0) > 8:
        return "UTF-16LE"
    if head[0:40:2].count(0) > 8:
        return "UTF-16BE"
    try:
        head[: len(head) - 3].decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError:
        return "ISO-8859-1"


def detect_delimiter(head: str) -> str:
    """The candidate that cuts all first lines into equally many and most fields."""
    lines = [x for x in re.split(r"\r\n|\n|\r", head) if x][:20]
    lines = lines[:-1] if len(lines) > 1 else lines
    best = (0, ",")
    for d in (",", "|", "\t", ";", "~", "*"):
        widths = {len(r) for r in csv.reader(lines, delimiter=d)}
        if len(widths) == 1 and (w := widths.pop()) > 1 and w > best[0]:
            best = (w, d)
    return best[1]


def cr_line_ends(head: str) -> bool:
    return "\r" in head and "\n" not in head


def read_csv(spark: SparkSession, path: str, header: bool = True, columns: list[str] | None = None, delimiter: str | None = None, encoding: str | None = None, quotes: bool = True, lazy_quotes: bool = False, keep_bad: bool = True, trim: bool = True) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the raw text of rows that don't parse or have another number of fields."""
    head = first_bytes(spark, path)
    encoding = encoding or detect_encoding(head)
    text = head.decode(encoding, "replace")
    delimiter = delimiter or detect_delimiter(text)
    names = columns
    if not names:
        line = re.split(r"\r\n|\n|\r", text.lstrip("﻿"))[0]
        first = next(csv.reader([line], delimiter=delimiter), [])
        names = unique_headers([c.strip() for c in first]) if header else [f"column{k + 1}" for k in range(len(first))]
    schema = StructType([*(StructField(n, StringType()) for n in names), StructField(BAD, StringType())])
    reader = spark.read.schema(schema).option("header", header).option("sep", delimiter).option("encoding", encoding).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("enforceSchema", True)
    reader = reader.option("unescapedQuoteHandling", "BACK_TO_DELIMITER" if lazy_quotes else "STOP_AT_DELIMITER")
    if not quotes:
        reader = reader.option("quote", "")
    if cr_line_ends(text):
        reader = reader.option("lineSep", "\r")
    elif encoding.upper() not in ("UTF-8", "ISO-8859-1", "US-ASCII"):
        reader = reader.option("multiLine", True)  # lines can't be cut by bytes in these
    # whether a row is good depends on all of it: no pruning in the parser, and
    # a condition that keeps another column beside the corrupt record
    rows = reader.option("columnPruning", False).csv(path).where(F.coalesce(F.length(F.col(f"`{names[0]}`")), F.lit(0)) >= 0)
    clean = [F.nullif(F.trim(F.col(f"`{n}`")) if trim else F.col(f"`{n}`"), F.lit("")).alias(n) for n in names]
    good = rows.where(F.col(BAD).isNull()).select(*clean)
    bad = rows.where(F.col(BAD).isNotNull()).select(BAD)
    return good, bad if keep_bad else bad.limit(0)


@dataclass(frozen=True)
class Field:
    """Characters ``start`` to ``end`` (end exclusive) of lines of a record type."""

    name: str
    start: int
    end: int
    record_type: str = ""


def read_fixed_width(spark: SparkSession, path: str, layout: list[Field], type_at: tuple[int, int] | None = None) -> DataFrame:
    """One wide row for each line; with record types columns are ``type.column``, and lines of unknown types are left out."""
    lines = spark.read.text(path)
    kind = F.trim(F.substring("value", type_at[0] + 1, type_at[1] - type_at[0])) if type_at else F.lit("")
    known = sorted({f.record_type for f in layout})
    cut = lambda f: F.nullif(F.trim(F.substring("value", f.start + 1, f.end - f.start)), F.lit(""))
    columns = [(F.when(kind == f.record_type, cut(f)) if type_at else cut(f)).alias(f"{f.record_type}.{f.name}" if f.record_type else f.name) for f in layout]
    return (lines.where(kind.isin(known)) if type_at else lines).select(*columns)


def fields_of(widths: dict[str, int]) -> list[Field]:
    """A layout of one field after the other."""
    out, at = [], 0
    for name, n in widths.items():
        out.append(Field(name, at, at + n))
        at += n
    return out


def several_columns(df: DataFrame) -> DataFrame:
    """``df``, or an error where rows of several columns have a value in the first one only: the delimiter is likely another."""
    if len(df.columns) > 1:
        rest = F.coalesce(*(F.col(f"`{c}`").cast("string") for c in df.columns[1:]))
        rows, more = df.select(F.count(F.lit(1)), F.count(rest)).first()
        if rows and not more:
            raise ValueError(f"all rows have one column of {len(df.columns)}: is the delimiter right?")
    return df


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, trim: bool = True) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    texts = {f.name for f in df.schema if isinstance(f.dataType, StringType)}
    return df.select(*(F.trim(F.col(f"`{c}`")).alias(c) if trim and c in texts else F.col(f"`{c}`") for c in df.columns))


def _sheet_rows(content: bytes, sheet: str | int) -> Iterator[list[str | None]]:
    """The rows of a workbook's sheet, by name or position, as texts."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheets = ET.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", ns)
        own = sheets[sheet] if isinstance(sheet, int) else next(s for s in sheets if s.get("name") == sheet)
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets[own.get(rel)].lstrip("/")
        for row in ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).findall("m:sheetData/m:row", ns):
            out: list[str | None] = []
            for c in row.findall("m:c", ns):
                letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                out += [None] * (at - 1 - len(out))
                v = c.find("m:v", ns)
                value = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else (v.text if v is not None else None)
                out.append(shared[int(value)] if c.get("t") == "s" and value is not None else value)
            yield out


def read_xlsx(spark: SparkSession, path: str, columns: list[str], sheet: str | int = 0, header: bool = True) -> DataFrame:
    """Rows of a sheet of each workbook at ``path``, a workbook a task; the header is the first row with two cells or more."""
    n = len(columns)

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            for content in f["content"]:
                rows, seen = [], not header
                for r in _sheet_rows(bytes(content), sheet):
                    if not seen:
                        seen = sum(x not in (None, "") for x in r) > 1
                        continue
                    rows.append(([x if x is None else x.strip() or None for x in r] + [None] * n)[:n])
                yield pd.DataFrame(rows, columns=columns, dtype=object)

    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def generate(spark: SparkSession, rows: int, columns: list[str]) -> DataFrame:
    """``rows`` rows of nulls."""
    return spark.range(rows).select(*(F.lit(None).cast("string").alias(c) for c in columns))


def add_path_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``name=value/`` parts of each row's file path."""
    return df.withColumns({n: F.nullif(F.regexp_extract(F.col("_metadata.file_path"), f"{n}=(.*?)/", 1), F.lit("")) for n in names})
