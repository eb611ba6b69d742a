"""Toxicity by a chain of linear classifiers.

Categories are predicted in order; each later model sees, beside a text's
words, the probabilities of the earlier categories. For training these come
from models fitted without the row's own fold, vocabulary included, so that a
later model meets them as uncertain as they will be. The categories are what
the labelled table says of a text: ``unfit`` (its quality is 0), then ``toxic``.

Words are runs of letters, digits and bytes beyond ASCII, lower-cased; a text
is the set of its distinct words and word beginnings (4 to 8 bytes). Bounds:
``SAMPLE`` labelled rows of each class; for each category, and for each of its
folds, the ``VOCABULARY`` words that tell most of the label. Words are counted
by label and fold in Spark, and only those of the vocabularies reach the
driver, whatever the length of the texts. One narrow pass gathers the sample's
words, one scores all texts.

Null and empty texts have no words and get the models' floor; very long texts
are sets of words like others. Equal texts score equally; ties among words go
to the lesser hash; of rows that repeat an id one is learned from. An unknown
quality is none that is unfit. Without labelled rows all probabilities are 0.
An empty table gives an empty result. Further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_sample
from .tables import stored
from .textkit import LOWER, PUNCTUATION, buffers, hashes, mix, slices, spans

SAMPLE, VOCABULARY, LEAST, FOLDS = 2500, 400, 4, 3
NAMES = ("unfit", "toxic")


#: Word beginnings of so many bytes are features too, for languages that inflect and compound.
PREFIXES = (4, 5, 6, 7, 8)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and word beginnings, text by text, and where each text's begin (one more at the end)."""
    data, offsets = buffers(texts)
    data = LOWER[data]
    starts, ends, doc = spans(data, offsets, PUNCTUATION)
    found, whose = [hashes(data, starts, ends)], [doc]
    for k in PREFIXES:
        own = np.flatnonzero(ends - starts > k)
        found.append(mix(hashes(data, starts[own], starts[own] + k) + np.uint64(k)))
        whose.append(doc[own])
    doc = np.concatenate(whose)
    order = np.argsort(doc, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(doc[order], np.arange(len(offsets)))


class Rows:
    """Sparse 0/1 rows: the columns of each."""

    def __init__(self, columns: np.ndarray, bounds: np.ndarray) -> None:
        self.columns, self.bounds = columns, bounds
        self.row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.columns], len(self.bounds) - 1)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.columns, g[self.row], size)

    def take(self, rows: np.ndarray) -> Rows:
        parts = [self.columns[self.bounds[r] : self.bounds[r + 1]] for r in rows]
        return Rows(np.concatenate(parts) if parts else self.columns[:0], np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Linear:
    """Logistic regression on sparse rows and a few dense columns; ridge penalty; Adam."""

    def fit(self, x: Rows, extra: np.ndarray, y: np.ndarray, size: int, steps: int = 300, ridge: float = 1e-4) -> Linear:
        w, b = np.zeros(size), np.zeros(extra.shape[1] + 1)
        dense = np.column_stack([np.ones(len(y)), extra])
        m = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
        for t in range(1, steps + 1):
            d = (_sigmoid(x.dot(w) + dense @ b) - y) / len(y)
            for p, g, i in ((w, x.back(d, size) + ridge * w, 0), (b, dense.T @ d, 2)):
                m[i] += 0.1 * (g - m[i])
                m[i + 1] += 0.01 * (g * g - m[i + 1])
                p -= 0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(m[i + 1] / (1 - 0.99**t)) + 1e-9)
        self.w, self.b = w, b
        return self

    def predict(self, x: Rows, extra: np.ndarray) -> np.ndarray:
        return _sigmoid(x.dot(self.w) + self.b[0] + extra @ self.b[1:])


def rows_of(vocabulary: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> Rows:
    """The distinct words of each text that a vocabulary (sorted hashes) has."""
    n, size = len(bounds) - 1, max(len(vocabulary), 1)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    if not len(vocabulary):
        return Rows(np.zeros(0, np.int64), np.zeros(n + 1, np.int64))
    at = np.minimum(np.searchsorted(vocabulary, h), size - 1)
    own = vocabulary[at] == h
    key = np.unique(doc[own] * size + at[own])
    return Rows(key % size, np.searchsorted(key // size, np.arange(n + 1)))


class Chain:
    """A vocabulary and a model for each category."""

    def __init__(self) -> None:
        self.models: list[tuple[np.ndarray, Linear]] = []

    def fit(self, h: np.ndarray, bounds: np.ndarray, labels: np.ndarray, folds: np.ndarray, vocabularies: list[list[np.ndarray]]) -> Chain:
        """labels: (rows, categories) 0/1; folds: each row's fold; vocabularies: for each category one chosen without each fold, and one from all."""
        extra = np.zeros((len(labels), 0))
        for y, own in zip(labels.T.astype(float), vocabularies, strict=True):
            self.models.append((own[FOLDS], Linear().fit(rows_of(own[FOLDS], h, bounds), extra, y, max(len(own[FOLDS]), 1))))
            out = np.full(len(y), y.mean())
            for f in range(FOLDS):
                inside, outside = np.flatnonzero(folds == f), np.flatnonzero(folds != f)
                if len(inside) and len(outside):
                    x = rows_of(own[f], h, bounds)
                    out[inside] = Linear().fit(x.take(outside), extra[outside], y[outside], max(len(own[f]), 1)).predict(x.take(inside), extra[inside])
            extra = np.column_stack([extra, out])
        return self

    def predict(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(rows, categories) probabilities."""
        extra = np.zeros((len(bounds) - 1, 0))
        for vocabulary, m in self.models:
            extra = np.column_stack([extra, m.predict(rows_of(vocabulary, h, bounds), extra)])
        return extra


def telling(counts: DataFrame, rows: list[list[int]], positive: list[list[int]], least: int = LEAST, most: int = VOCABULARY) -> list[np.ndarray]:
    """The ``most`` words, in ``least`` texts or more, whose presence says most of a label (chi-square): without each fold, then of all folds; sorted hashes.

    counts: (hash, n, k) with the number of texts, and of those with the label,
    in each fold as arrays; rows, positive: how many of each fold there are.
    """
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) - (F.get(c, F.lit(f)) if f < FOLDS else F.lit(0))
    parts = []
    for f in range(FOLDS + 1):
        texts, with_label = sum(x for k, x in enumerate(rows) if k != f), sum(x for k, x in enumerate(positive) if k != f)
        n, k = total(F.col("n"), f), total(F.col("k"), f)
        expected = n * with_label / max(texts, 1)
        chi = (k - expected) ** 2 / F.greatest(expected * (1 - with_label / max(texts, 1)) * (1 - n / max(texts, 1)), F.lit(1e-9))
        parts.append(counts.where(n >= least).select("hash", chi.alias("chi")).orderBy(F.desc("chi"), "hash").limit(most).select(F.lit(f).alias("fold"), "hash"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    out: list[list[int]] = [[] for _ in range(FOLDS + 1)]
    for r in every.collect():
        out[r["fold"]].append(r["hash"])
    return [np.sort(np.array(x, np.int64).view(np.uint64)) for x in out]


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, quality: str = "quality") -> Chain:
    picked, _ = labelled_sample(labels, label, sample, id)
    if not picked:
        return Chain()
    wanted = pa.array(sorted(picked))
    known = labels.where(F.col(id).isin(sorted(picked)) & (F.col(quality) == 0)).select(id).distinct().collect() if quality in labels.columns else []
    unfit = {r[0] for r in known}
    marks = {i: (int(i in unfit), y) for i, y in picked.items()}
    fold_of = lambda i: xxhash.xxh3_64_intdigest(str(i)) % FOLDS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            own = whole.filter(pc.is_in(whole.column("id"), wanted))
            for b in slices(own, "text"):
                h, bounds = features(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([np.unique(h[p:q]).tobytes() for p, q in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["id", "words"])

    d = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    texts = stored(d.mapInArrow(gather, f"id {kind}, words binary").dropDuplicates(["id"]), "sample")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w in zip(b.column("id").to_pylist(), b.column("words"), strict=True):
                h = np.frombuffer(w.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), *(pa.array(np.full(len(h), x, np.int32)) for x in (fold_of(i), *marks[i]))], ["hash", "fold", *NAMES])

    sums = texts.mapInArrow(words, "hash long, fold int, unfit int, toxic int").groupBy("hash").agg(*(F.count_if(F.col("fold") == f).alias(f"n{f}") for f in range(FOLDS)), *(F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for c in NAMES for f in range(FOLDS)))
    counts = stored(sums.select("hash", *(F.array(*(F.col(f"{c}{f}") for f in range(FOLDS))).alias(c) for c in ("n", *NAMES))), "word-counts")
    present = [r["id"] for r in texts.select("id").collect()]
    folds = [fold_of(i) for i in present]
    rows = [folds.count(f) for f in range(FOLDS)]
    vocabularies = [telling(counts.select("hash", "n", F.col(c).alias("k")), rows, [sum(marks[i][j] for i, g in zip(present, folds, strict=True) if g == f) for f in range(FOLDS)]) for j, c in enumerate(NAMES)]
    union = np.unique(np.concatenate([v for own in vocabularies for v in own]))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.flatnonzero(np.isin(union, np.frombuffer(w.as_buffer(), np.uint64))).astype(np.uint16).tobytes() for w in b.column("words")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(own, pa.binary())], ["id", "words"])

    found = [(r["id"], union[np.frombuffer(bytes(r["words"]), np.uint16)]) for r in sorted(texts.mapInArrow(narrow, f"id {kind}, words binary").collect(), key=lambda r: r["id"])] if len(union) else [(i, union) for i in sorted(present)]
    h = np.concatenate([w for _, w in found]) if found else union
    bounds = np.concatenate([[0], np.cumsum([len(w) for _, w in found])]).astype(np.int64)
    if not found:
        return Chain()
    return Chain().fit(h, bounds, np.array([marks[i] for i, _ in found]), np.array([fold_of(i) for i, _ in found], np.int64), vocabularies)


def score(docs: DataFrame, chain: Chain, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, a probability for each of ``NAMES``) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                p = chain.predict(*features(b.column("text")))
                if not p.shape[1]:
                    p = np.zeros((len(b), len(NAMES)))
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(NAMES)))], ["id", *NAMES])

    d = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in NAMES)).withColumnRenamed("id", id)
