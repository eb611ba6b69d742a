"""Token counts of sections and fields by offset mapping.

Each whole text is encoded once. The lengths of the tokens' bytes give every
token's span of characters, the sections' bounds give theirs, and an interval
join of the two sorted lists counts tokens by section. A token that crosses a
boundary is allotted by the rule that the caller names:

* ``first``: to the section of its first character;
* ``last``: to the section of its last character;
* ``most``: to the section with most of its characters, the earlier on ties.

Every token goes to exactly one section, so sections add up to the text. An
empty section gets none, as no character is its own. By default sections are
lines, each with its line end; fields are several columns encoded together,
joined by line ends, as one text.

Null and empty texts have one empty section without tokens. Repeated rows are
counted each. Narrow: one pass, no shuffle. Further columns aren't read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "last", "most")


class ByteBpe:
    """tiktoken's encoder with the byte length of each token."""

    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self._encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and last character of each token; of a character that tokens share, each has it."""
        if not text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw = text.encode("utf-8", "replace")
        ends = np.cumsum(self.length[self._encoding.encode_ordinary(text)])
        starts = np.concatenate([[0], ends[:-1]])
        if len(raw) == len(text):
            return starts, ends - 1
        char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
        return char[starts], char[ends - 1]


def allot(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str = "first") -> np.ndarray:
    """The section of each token. ``starts``: where sections begin, ascending from 0; of equal ones the last holds the characters."""
    a = np.searchsorted(starts, first, "right") - 1
    if rule == "first":
        return a
    b = np.searchsorted(starts, last, "right") - 1
    if rule == "last":
        return b
    out, bounds = a.copy(), np.append(starts, np.iinfo(np.int64).max)
    for k in np.flatnonzero(b > a):
        own = np.arange(a[k], b[k] + 1)
        held = np.minimum(bounds[own + 1], last[k] + 1) - np.maximum(bounds[own], first[k])
        out[k] = own[held.argmax()]
    return out


def line_starts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(points == 10) + 1
    return np.concatenate([[0], at[at < len(points)]])


def section_tokens(docs: DataFrame, id: str = "doc_id", text: str = "text", rule: str = "first", path: str | None = None) -> DataFrame:
    """(id, section, start, length, n_tokens, n_crossing) of each line; crossing tokens are counted where they are allotted."""
    if rule not in RULES:
        raise ValueError(f"rule is none of {RULES}: {rule}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path)
        for b in batches:
            parts: list[tuple] = []
            for k, t in enumerate(b.column(text)):
                t = t.as_py() or ""
                starts = line_starts(t)
                first, last = bpe.spans(t)
                own = allot(first, last, starts, rule)
                crossing = np.searchsorted(starts, first, "right") != np.searchsorted(starts, last, "right")
                n = len(starts)
                parts.append((np.full(n, k), np.arange(n), starts, np.diff(np.append(starts, len(t))), np.bincount(own, minlength=n), np.bincount(own[crossing], minlength=n)))
            if parts:
                row, *columns = (np.concatenate(c) for c in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(id).take(pa.array(row)), pa.array(columns[0].astype(np.int32)), *(pa.array(c) for c in columns[1:])], ["id", "section", "start", "length", "n_tokens", "n_crossing"])

    d = docs.select(id, text)
    kind = f"id {d.schema[id].dataType.simpleString()}, section int, start long, length long, n_tokens long, n_crossing long"
    return d.mapInArrow(run, kind).withColumnRenamed("id", id)


def field_tokens(rows: DataFrame, fields: list[str], id: str = "doc_id", rule: str = "first", path: str | None = None) -> DataFrame:
    """(id, one count for each field): the fields, null as empty, are encoded as one text with a line end between them, which belongs to the field before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path)
        for b in batches:
            counts = np.zeros((len(b), len(fields)), np.int64)
            for k in range(len(b)):
                texts = [b.column(f)[k].as_py() or "" for f in fields]
                starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[:-1]])]).astype(np.int64)
                first, last = bpe.spans("\n".join(texts))
                counts[k] = np.bincount(allot(first, last, starts, rule), minlength=len(fields))
            yield pa.RecordBatch.from_arrays([b.column(id), *(pa.array(np.ascontiguousarray(counts[:, j])) for j in range(len(fields)))], ["id", *fields])

    d = rows.select(id, *(F.col(f).cast("string").alias(f) for f in fields))
    return d.mapInArrow(run, f"id {d.schema[id].dataType.simpleString()}, " + ", ".join(f"`{f}` long" for f in fields)).withColumnRenamed("id", id)
