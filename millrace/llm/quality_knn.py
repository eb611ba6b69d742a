"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms say how it is written, not what about: trigrams of character
classes (runs of a class count once), 3-word windows that came before in the
text, and words equal to the one before. Counts are damped by a square root,
weighted by inverse document frequencies over *all* texts, scaled to length 1
and projected on the leading right singular vectors of the labelled sample.
Every text's cosines with all labelled vectors are computed exactly, block by
block; its ``NEIGHBOURS`` nearest vote with the power ``SHARPNESS`` of their
cosine, times what their class weighs among all labelled rows.

Bounds: ``SAMPLE`` labelled rows of each class, ``DIMENSIONS`` numbers each, so
what is sent to the tasks is about a megabyte. Two passes over the texts, both
narrow; document frequencies meet as one fixed-size vector for each task.

Null and empty texts have no terms and score 0. Equal texts score equally;
ties among neighbours are broken by place in the sample, which is in order of
ids. Without labelled rows every other text scores 1. Further columns aren't
read; neither are id, language or source part of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_sample, summed
from .tables import numbered_columns, stored
from .textkit import LOWER, buffers, hashes, mix, slices, spans

SAMPLE, DIMENSIONS, NEIGHBOURS, SHARPNESS = 2000, 32, 15, 8

_CLASS = np.full(256, 9, np.int64)
for _k, _own in enumerate((b" \t\r\x0b\x0c", b"\n", bytes([*range(97, 123), *range(128, 256)]), bytes(range(65, 91)), bytes(range(48, 58)), b".,;:'\"-", b"!?", b"#*$%&", b"|<>[]{}")):
    _CLASS[list(_own)] = _k
_N = 10
TERMS = _N**3 + 2
#: Bytes of text and texts counted at once: each text has ``TERMS`` numbers, however short.
SLICE, ROWS = 1 << 20, 512


def term_counts(texts: pa.Array) -> np.ndarray:
    """(texts, terms) counts."""
    data, offsets = buffers(texts)
    n = len(offsets) - 1
    out = np.zeros((n, TERMS))
    if not len(data):
        return out
    c = _CLASS[data]
    change = np.ones(len(c), bool)
    change[1:] = c[1:] != c[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    change[first] = True
    at = np.flatnonzero(change)
    c, doc = c[at], np.searchsorted(offsets, at, "right") - 1
    own = doc[2:] == doc[:-2]
    code = (c[:-2] * _N + c[1:-1]) * _N + c[2:]
    out[:, :-2] = np.bincount((doc[:-2] * (TERMS - 2) + code)[own], minlength=n * (TERMS - 2)).reshape(n, -1)
    starts, ends, doc = spans(data, offsets)
    h = hashes(LOWER[data], starts, ends)
    if len(h) > 2:
        window = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:] + mix(doc[2:].astype(np.uint64)))[doc[:-2] == doc[2:]]
        whose = doc[2:][doc[:-2] == doc[2:]]
        _, once = np.unique(window, return_index=True)
        out[:, -2] = np.bincount(whose, minlength=n) - np.bincount(whose[once], minlength=n)
    if len(h) > 1:
        out[:, -1] = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (np.sqrt(counts) * idf).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    """Labelled latent vectors, and how to find a text's own."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, sizes: dict[int, int], df: np.ndarray, texts: int) -> None:
        self.idf = np.log((1 + texts) / (1 + df)) + 1
        x = weighted(counts, self.idf)
        values, vectors = np.linalg.eigh(x.T @ x)  # right singular vectors of the sample
        self.basis = np.ascontiguousarray(vectors[:, np.argsort(-values)[:DIMENSIONS]].astype(np.float32))
        self.vectors = self.latent(x)
        self.labels = labels.astype(np.float32)
        share = np.array([sizes.get(y, 0) / max((labels == y).sum(), 1) for y in (0, 1)], np.float32)
        self.weights = share[labels]

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray, block: int = 512) -> np.ndarray:
        some = counts.any(1)
        out = some.astype(float)
        if not len(self.labels):
            return out
        z = self.latent(weighted(counts, self.idf))
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(z), block):
            cosines = z[at : at + block] @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cosines, near, 1), 1e-6).astype(float) ** SHARPNESS * self.weights[near]
            out[at : at + block] = (w * self.labels[near]).sum(1) / w.sum(1)
        return np.where(some, out, 0.0)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    picked, sizes = labelled_sample(labels, label, sample, id)
    wanted = pa.array(sorted(picked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(TERMS + 1, np.int64), 0
        names = ["id", "terms", "df"]
        kind = None
        for whole in batches:
            kind = whole.column(id).type
            for b in slices(whole, text, SLICE, ROWS):
                counts = term_counts(b.column(text))
                df[:-1] += (counts > 0).sum(0)
                df[-1] += len(b)
                rows = np.flatnonzero(pa.compute.is_in(b.column(id), wanted).to_numpy(zero_copy_only=False)) if len(wanted) else []
                if len(rows):
                    yield pa.RecordBatch.from_arrays([b.column(id).take(pa.array(rows)), pa.array([counts[k].astype(np.float32).tobytes() for k in rows], pa.binary()), pa.nulls(len(rows), pa.list_(pa.int64()))], names)
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([df.tolist()], pa.list_(pa.int64()))], names)

    d = docs.select(id, text)
    parts = stored(d.mapInArrow(run, f"id {d.schema[id].dataType.simpleString()}, terms binary, df array<long>"), "terms")
    df = summed(parts.where("df IS NOT NULL"), "df", TERMS + 1)
    rows = sorted((r["id"], bytes(r["terms"])) for r in parts.where("terms IS NOT NULL").dropDuplicates(["id"]).select("id", "terms").collect())
    counts = np.array([np.frombuffer(t, np.float32) for _, t in rows]).reshape(-1, TERMS)
    return Model(counts, np.array([picked[i] for i, _ in rows], np.int64), sizes, df[:-1], int(df[-1]))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, which takes the place of one of that name, without its text (select what is to stay beforehand)."""
    keep = [c for c in docs.columns if c not in (text, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text, SLICE, ROWS):
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(model.score(term_counts(b.column(text))))], [*keep, name])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep) + f"`{name}` double"
    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, text: str = "text", least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose texts score ``least`` or more, all columns."""

    own, at = numbered_columns(docs), f"c{docs.columns.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at, SLICE, ROWS):
                yield b.filter(pa.array(model.score(term_counts(b.column(at))) >= least))

    return own.mapInArrow(run, own.schema).toDF(*docs.columns)


def training_labels(labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """The labelled rows that may be learned from."""
    return labels.where(F.pmod(F.crc32(F.col(id).cast("string")), F.lit(4)) != 2)
