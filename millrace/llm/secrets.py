"""Secret scans: patterns, and sliding-window Shannon entropy per character class.

The patterns find assignments, access keys and long hex strings. The method
adds ``entropy`` spans: every maximal run of 20 or more key characters is a
candidate; a window slides over it and the sum of ``c * log2(c)`` over its
character counts is kept up to date as one character enters and one leaves.
Windows above the threshold of the candidate's class are joined to a span; hex
digits within a candidate of another class (``DB_KEY=9F86...``) are taken apart
by their own. Other candidates are cut at their plain parts first: numbers,
words, camel-cased names (``plain``), so that identifiers, paths and titles give
no span while a random part between them does. A candidate, stretch or hex part
on the allow list gives none, and a span that touches a pattern's isn't added.

Narrow: one pass, no shuffle, no state between rows; a long text costs time in
proportion to its length. Null and empty texts have no spans. Repeated rows
get equal spans; spans that begin together are in the order of ``KINDS``. An
empty table gives an empty result. Further columns aren't read (``redact`` keeps
them), whatever their names; name the id and text columns.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import numbered_columns
from .textkit import LOWER, buffers, slices, spans

KINDS = ("assign", "access", "hex", "entropy")
SPANS = "array<struct<kind:string,start:int,end:int>>"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

#: Window length, and bits per character over which a window is random, by class.
WINDOW = 20
BITS = {"hex": 3.0, "mixed": 3.7}
#: Candidates that are random to look at but no secrets.
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r".*EXAMPLE.*", re.IGNORECASE),
    re.compile(r"[A-Za-z]+([/_=-]+[A-Za-z]+)*"),
    re.compile(r"[0-9+/_=-]+"),
    re.compile(r"(.{1,8}?)\1{3,}.{0,7}"),
)


def _table(pattern: bytes) -> np.ndarray:
    """True for bytes outside the class."""
    return np.array([re.fullmatch(pattern, bytes([k])) is None for k in range(256)])


_HEX, _LETTERS = re.compile(r"[0-9a-fA-F]+"), "abcdefABCDEF"
_NOT_HEX, _NOT_KEY = _table(rb"[0-9a-f]"), _table(rb"[A-Za-z0-9+/_=-]")


def char_class(s: str) -> str:
    return "hex" if re.fullmatch(r"[0-9a-fA-F]+", s) else "mixed"


def _over(s: str, window: int, least: float) -> list[tuple[int, int]]:
    """Joined windows of ``s`` whose entropy is at least ``least``."""
    log = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, found = 0.0, []
    for i, x in enumerate(s):
        c = counts.get(x, 0)
        counts[x], total = c + 1, total + log[c + 1] - log[c]
        if i >= window:
            y = s[i - window]
            c = counts[y]
            counts[y], total = c - 1, total + log[c - 1] - log[c]
        if i >= window - 1 and math.log2(window) - total / window >= least:
            a = i - window + 1
            if found and a <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((a, i + 1))
    return found


def _allowed(s: str) -> bool:
    return any(p.fullmatch(s) for p in ALLOW)


_PARTS = re.compile(r"[A-Za-z0-9]+")
_WORDS = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}")
_VOWEL, _CONSONANTS = re.compile("[aeiouyAEIOUY]"), re.compile("[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{6}")


def plain(part: str) -> bool:
    """Whether letters and digits between separators look made of words or a number, not drawn at random: three fifths in words with vowels, few digits."""
    if len(part) < 4:
        return False
    if part.isdigit():
        return True
    words = sum(len(m[0]) for m in _WORDS.finditer(part) if len(_VOWEL.findall(m[0])) * 5 >= len(m[0]) and not _CONSONANTS.search(m[0]))
    return 5 * words >= 3 * len(part) and 4 * sum(map(str.isdigit, part)) <= len(part)


def stretches(s: str) -> list[tuple[int, int]]:
    """What is left of a candidate when its plain parts are cut out."""
    out, begin = [], 0
    for m in _PARTS.finditer(s):
        if plain(m[0]):
            out.append((begin, m.start()))
            begin = m.end()
    return [(a, b) for a, b in [*out, (begin, len(s))] if b > a]


def class_spans(s: str, window: int = WINDOW, bits: dict[str, float] | None = None) -> list[tuple[int, int]]:
    """Windows of ``s`` over the threshold of its class, and windows of its longest runs of hex digits over theirs; the two may overlap."""
    if len(s) < window or _allowed(s):
        return []
    bits, own = bits or BITS, char_class(s)
    if own == "hex":
        return _over(s, window, bits[own])
    found = []
    for a, b in stretches(s):
        if b - a >= window and not _allowed(s[a:b].strip("+/_=-")):
            found += [(a + x, a + y) for x, y in _over(s[a:b], window, bits[own])]
    for m in _HEX.finditer(s):
        a, b = m.span()
        # Letters that may belong to a word beside the digits don't make a number a secret.
        core = m[0].lstrip(_LETTERS) if a and s[a - 1].isalpha() else m[0]
        core = core.rstrip(_LETTERS) if b < len(s) and s[b].isalpha() else core
        if b - a >= window and not _allowed(m[0]) and not _allowed(core):
            found += [(a + x, a + y) for x, y in _over(m[0], window, bits["hex"])]
    return found


def joined(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans, sorted, those that overlap or meet as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def random_spans(s: str, window: int = WINDOW, bits: dict[str, float] | None = None) -> list[tuple[int, int]]:
    """``class_spans``, joined."""
    return joined(class_spans(s, window, bits))


def scan(text: str, hexes: list[tuple[int, int]], candidates: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """All spans of a text, sorted; ``hexes`` and ``candidates`` are its long runs of those classes."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", a, b) for a, b in hexes]
    taken = sorted((a, b) for _, a, b in out)
    for a, b in candidates:
        found = [(a + x, a + y) for x, y in class_spans(text[a:b])]
        out += [("entropy", x, y) for x, y in joined([s for s in found if not any(p < s[1] and q > s[0] for p, q in taken)])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def scan_batch(texts: pa.Array) -> list[list[tuple[str, int, int]]]:
    data, offsets = buffers(texts)
    raw = data.tobytes()
    low = LOWER[data].tobytes()
    runs: dict[str, dict[int, list[tuple[int, int]]]] = {}
    for kind, table, least in (("hex", _NOT_HEX, 24), ("key", _NOT_KEY, WINDOW)):
        a, b, doc = spans(data, offsets, table)
        by: dict[int, list[tuple[int, int]]] = runs.setdefault(kind, {})
        for k in np.flatnonzero(b - a >= least):
            by.setdefault(int(doc[k]), []).append((int(a[k]), int(b[k])))
    hit = set(runs["hex"]) | set(runs["key"])
    for word, where in (*((w, low) for w in _KEYWORDS), (b"AKIA", raw)):
        at = where.find(word)
        while at >= 0:
            doc = int(np.searchsorted(offsets, at, "right")) - 1
            hit.add(doc)
            at = where.find(word, int(offsets[doc + 1]))  # a text once found needs no second look
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    for doc in hit:
        o = int(offsets[doc])
        own = raw[o : int(offsets[doc + 1])]
        text = own.decode("utf-8", "replace")
        if len(text) == len(own):
            place = lambda k, o=o: k - o
        else:
            before = np.concatenate([[0], np.cumsum((np.frombuffer(own, np.uint8) & 0xC0) != 0x80)])
            place = lambda k, o=o, before=before: int(before[k - o])
        mapped = {kind: [(place(a), place(b)) for a, b in runs[kind].get(doc, [])] for kind in runs}
        out[doc] = scan(text, mapped["hex"], mapped["key"])
    return out


def spans_array(found: list[list[tuple[str, int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found], kind)


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id and ``spans`` (code points, end exclusive) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column("id"), spans_array(scan_batch(b.column("text")))], ["id", "spans"])

    d = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, spans {SPANS}").withColumnRenamed("id", id)


def digest(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret span, joined where they overlap, replaced by ``mark``; all columns stay, null stays null."""
    own, at = numbered_columns(docs), docs.columns.index(text)
    names = own.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, names[at]):
                found = scan_batch(b.column(at))
                columns = list(b.columns)
                if any(found):
                    values = b.column(at).to_pylist()
                    for k, spans_of in enumerate(found):
                        if spans_of:
                            values[k] = _without(values[k], spans_of, mark)
                    columns[at] = pa.array(values, b.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return own.mapInArrow(run, own.schema).toDF(*docs.columns)


def _without(text: str, own: list[tuple[str, int, int]], mark: str) -> str:
    parts, end = [], 0
    for _, a, b in own:
        if a >= end:
            parts += [text[end:a], mark]
        end = max(end, b)
    return "".join([*parts, text[end:]])
