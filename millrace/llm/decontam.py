"""Benchmark decontamination by latent semantic retrieval.

Terms are words (runs of letters, digits and bytes beyond ASCII, lower-cased)
hashed to ``TERMS`` buckets.

1. Document frequencies are counted over all documents.
2. Items of over ``PIECE`` words are searched by pieces of so many words, each
   overlapping half of the next, so no item is too long to be found. A piece's
   vector has its TF-IDF terms and, as one more term, its rarest run of ``RUN``
   words (``MARK`` of its length; ``SHORT_MARK`` where the whole item is shorter
   than that and is its own run). A randomised SVD of every ``SPACE`` pieces
   gives a latent space, cut to the fewest leading directions that keep ``KEPT``
   of all squared length; pieces that would keep less than ``EACH`` in it add
   what they lose, so that none is lost however many there are. The space is made from the benchmark because its rare terms are
   what retrieval needs; corpus passages would spend it on what all texts share.
3. Every document is cut into windows of ``WINDOW`` words, each overlapping
   half of the next, and projected, with the runs that it holds. It is measured
   along a piece's latent vector, in units of its own full TF-IDF length, so
   words outside the space count against it and runs don't count against each
   other. Windows that reach ``LEAST_COSINE`` of what a piece's text has are
   candidates; there are no others. As a run keeps at least ``MARK`` less the
   root of what the space may lose, an exact copy is one whatever stands around
   it.
4. Each candidate is checked word by word: the longest common subsequence of
   the whole item and the text around the place where it would stand, for
   items of over ``LONG`` words summed over parts of so many. The item's answer
   is its last third. A document is contaminated when the subsequence covers
   ``COPY`` of the item, or ``PARAPHRASE`` of the item and ``ANSWER`` of its
   answer within a stretch not over twice the item's length.
5. Items of fewer than ``RUN`` words, ``SHORTEST`` at least, must stand in the
   candidate as they are.

The benchmark is taken in blocks of ``BLOCK`` pieces at most, with ``TERMS``
vectors of terms at most in their spaces, so what is sent to tasks has a fixed
bound whatever its size, and the driver holds one block at a time. Two passes
over the documents for the first block, one for each further; nothing is
shuffled but fixed-size sums and the hits.

Null and empty texts and items have no windows and match nothing; an item of
one or two words would match by chance and isn't searched. Very long texts are
cut like others. A document is reported once for each item, with its best
window; equal windows count as the first. Repeated rows are reported each.
Further columns aren't read, whatever their names; a null id is reported as
null, and its row is never removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import summed
from .tables import stored
from .textkit import PUNCTUATION, mix, slices, word_hashes

TERMS, DIMENSIONS, OVERSAMPLE, POWER = 1 << 16, 256, 16, 2
WINDOW, STEP, BLOCK, SPACE = 32, 16, 2048, DIMENSIONS
PIECE, RUN, SHORTEST, LONG = 64, 6, 3, 1024
LEAST_COSINE, COPY, PARAPHRASE, ANSWER = 0.27, 0.85, 0.6, 0.6
MARK, SHORT_MARK, KEPT, EACH = 0.8, 0.9, 0.8, 0.6


def term(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(TERMS - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """How many documents have each term, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(TERMS + 1, np.int64)
        for whole in batches:
            for b in slices(whole, text):
                h, bounds = word_hashes(b.column(text), PUNCTUATION)
                t = term(h)
                pairs = np.unique(np.repeat(np.arange(len(b)), np.diff(bounds)) * TERMS + t)
                df[:-1] += np.bincount(pairs % TERMS, minlength=TERMS)
                df[-1] += len(b)
        yield pa.RecordBatch.from_arrays([pa.array([df.tolist()], pa.list_(pa.int64()))], ["df"])

    df = summed(docs.select(text).mapInArrow(run, "df array<long>"), "df", TERMS + 1)
    return df[:-1], int(df[-1])


def _tfidf(passage: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms and weights, scaled to length 1."""
    terms, n = np.unique(passage, return_counts=True)
    w = n * idf[terms]
    return terms, w / np.linalg.norm(w)


def latent_space(rows: list[tuple[np.ndarray, np.ndarray]], terms: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 5) -> np.ndarray:
    """(terms, dimensions): leading right singular vectors of rows of length 1, by randomised subspace iteration; the fewest that keep ``KEPT`` of all squared length, and directions of their own for rows that would keep less than ``EACH``."""
    m = np.zeros((len(rows), len(terms)), np.float32)
    for k, (own, w) in enumerate(rows):
        m[k, np.searchsorted(terms, own)] = w
    q = np.random.default_rng(seed).standard_normal((len(terms), min(dimensions + OVERSAMPLE, len(terms)))).astype(np.float32)
    for _ in range(POWER):
        q, _ = np.linalg.qr(m.T @ (m @ q))
    z = m @ q
    values, vectors = np.linalg.eigh((z.T @ z).astype(np.float64))
    basis = (q @ vectors[:, np.argsort(-values)[:dimensions]]).astype(np.float32)
    kept = np.cumsum((m @ basis) ** 2, axis=1)
    d = int(np.searchsorted(kept.mean(axis=0), KEPT)) + 1
    basis = basis[:, :d]
    lost = m[kept[:, min(d, kept.shape[1]) - 1] < EACH]
    left = lost - (lost @ basis) @ basis.T
    values, vectors = np.linalg.eigh((left @ left.T).astype(np.float64))
    some = values > 1e-4
    return np.ascontiguousarray(np.hstack([basis, left.T @ (vectors[:, some] / np.sqrt(values[some]))]).astype(np.float32))


def run_hashes(h: np.ndarray, words: int = RUN) -> np.ndarray:
    """A hash of the ``words`` words from each place on; places with fewer words after them have none."""
    n = max(len(h) - words + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = mix(out ^ h[k : k + n])
    return out


def common_subsequence(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Places in ``a`` and ``b`` of a longest common subsequence."""
    n, m = len(a), len(b)
    table = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n):
        best = np.maximum(table[i, 1:], np.where(b == a[i], table[i, :-1] + 1, 0))
        table[i + 1, 1:] = np.maximum.accumulate(best)
    i, j, x, y = n, m, [], []
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            x.append(i)
            y.append(j)
    return x[::-1], y[::-1]


def compare(item: np.ndarray, around: np.ndarray, begin: int = 0) -> tuple[float, float, bool]:
    """How much of the item, and of its answer, a common subsequence covers, and whether that contaminates. A long item would stand at ``begin``."""
    n, tail = len(item), len(item) - max(1, len(item) // 3)
    if not np.isin(item, around).mean() >= PARAPHRASE:  # an upper bound of the subsequence
        return 0.0, 0.0, False
    x: list[int] = []
    y: list[int] = []
    for at in range(0, n, LONG):  # parts of a long item, each where it would stand, give or take half a part
        a = max(0, begin + at - LONG // 2) if n > LONG else 0
        own = around[a : max(0, begin + at + LONG + LONG // 2)] if n > LONG else around
        p, q = common_subsequence(item[at : at + LONG], own)
        x += [k + at for k in p]
        y += [k + a for k in q]
    whole = len(x) / n
    answer = sum(k >= tail for k in x) / (n - tail)
    near = bool(y) and max(y) - min(y) + 1 <= 2 * n
    return whole, answer, near and (whole >= COPY or (whole >= PARAPHRASE and answer >= ANSWER))


def pieces(n: int) -> list[int]:
    """Where the pieces of an item of ``n`` words begin; the last ends with the item."""
    return [0] if n <= PIECE else sorted({*range(0, n - PIECE, PIECE // 2), n - PIECE})


class Windows:
    """The windows of a batch of texts: the text, start and TF-IDF length of each, and runs of words by hash."""

    def __init__(self, h: np.ndarray, bounds: np.ndarray, square: np.ndarray) -> None:
        self.h, self.t, self.bounds = h, term(h), bounds
        counts = np.diff(bounds)
        blocks = -(-counts // STEP)
        self.doc = np.repeat(np.arange(len(counts)), blocks)
        self.first = np.cumsum(blocks) - blocks
        self.starts = bounds[:-1][self.doc] + (np.arange(len(self.doc)) - self.first[self.doc]) * STEP
        self.last = np.ones(len(self.doc), bool)
        self.last[:-1] = self.doc[1:] != self.doc[:-1]
        self.runs: dict[int, np.ndarray] = {}
        self.norm = self._lengths(square)

    def _lengths(self, square: np.ndarray) -> np.ndarray:
        """TF-IDF length of each window; repeated words add up as they do in TF-IDF."""
        length = np.minimum(WINDOW, self.bounds[self.doc + 1] - self.starts)
        window = np.repeat(np.arange(len(self.starts)), length)
        place = np.arange(len(window)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(self.starts, length)
        key = window * TERMS + self.t[place]
        key.sort()
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
        n = np.diff(np.append(edge, len(key))).astype(np.float32)
        own = key[edge]
        return np.sqrt(np.bincount(own // TERMS, n * n * square[own % TERMS], len(self.starts))).astype(np.float32) + 1e-9

    def marked(self, words: int, table: np.ndarray) -> np.ndarray:
        """(window, place in the sorted table of hashes), sorted: the window in whose first half a run of so many words begins."""
        if words not in self.runs:
            self.runs[words] = run_hashes(self.h, words)
        place, k = _equal(table, self.runs[words])
        doc = np.searchsorted(self.bounds, place, "right") - 1
        keep = place + words <= self.bounds[doc + 1]
        place, doc, k = place[keep], doc[keep], k[keep]
        return np.unique(np.stack([self.first[doc] + (place - self.bounds[doc]) // STEP, k], 1), axis=0)

    def holds(self, window: int, item: np.ndarray) -> bool:
        """Whether a short item begins in the first half of the window."""
        at, n = int(self.starts[window]), len(item)
        own = self.h[at : min(at + STEP + n - 1, int(self.bounds[self.doc[window] + 1]))]
        return bool((run_hashes(own, n) == run_hashes(item, n)[0]).any())

    def around(self, window: int, n: int, offset: int) -> tuple[int, int, np.ndarray]:
        """Where an item of ``n`` words would begin if the window lies in its piece at ``offset``, the words there, half an item more on each side, and where it begins in these."""
        d, at = self.doc[window], int(self.starts[window])
        if n <= PIECE:
            begin, a, b = at, at - n, at + WINDOW + n
        else:
            begin = at - offset - WINDOW // 2
            a, b = begin - n // 2, begin + n + n // 2
        a = max(int(self.bounds[d]), a)
        return begin, begin - a, self.h[a : max(a, min(int(self.bounds[d + 1]), b))]


def _equal(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``values`` and in the sorted ``table`` of all pairs of equals."""
    left, right = np.searchsorted(table, values), np.searchsorted(table, values, "right")
    place = np.flatnonzero(right > left)
    n = right[place] - left[place]
    return np.repeat(place, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - left[place], n)


Candidate = tuple[int, int, int, float, int]  # text, item, window, cosine, the piece's offset


class Searcher:
    """Pieces of items, ``SPACE`` at most, in the latent space of their own terms."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]], idf: np.ndarray) -> None:
        """rows: item, offset and words of each piece."""
        self.item, self.offset = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        runs = [self._run(h, idf) for _, _, h in rows]
        number = {r: TERMS + k for k, r in enumerate(sorted(set(runs)))}
        weighted = []
        for (_, _, h), r in zip(rows, runs, strict=True):
            own, w = _tfidf(term(h), idf)
            mark = MARK if len(h) >= RUN else SHORT_MARK
            weighted.append((np.append(own, number[r]), np.append(w * np.sqrt(1 - mark * mark), mark)))
        terms = np.unique(np.concatenate([own for own, _ in weighted]))
        basis = latent_space(weighted, terms)
        z = np.array([w.astype(np.float32) @ basis[np.searchsorted(terms, own)] for own, w in weighted], np.float32)
        self.vectors = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        words = terms[terms < TERMS]
        self.table = basis[: len(words)] * idf[words, None].astype(np.float32)
        self.row = np.full(TERMS, -1, np.int32)
        self.row[words] = np.arange(len(words))
        self.runs = {n: (np.array([h for k, h in number if k == n], np.uint64), basis[len(words) :][[k for k, r in enumerate(number) if r[0] == n]]) for n in {k for k, _ in number}}

    @staticmethod
    def _run(h: np.ndarray, idf: np.ndarray) -> tuple[int, int]:
        """Length and hash of a piece's rarest run."""
        n = min(RUN, len(h))
        at = int(np.argmax(np.convolve(idf[term(h)], np.ones(n), "valid")))
        return n, int(run_hashes(h[at : at + n], n)[0])

    def candidates(self, own: Windows) -> Iterator[Candidate]:
        """Windows near a piece."""
        if not len(own.doc):
            return
        sums = self._blocks(self.row[own.t], own.starts)
        z = sums.copy()
        z[:-1][~own.last[:-1]] += sums[1:][~own.last[:-1]]
        z /= own.norm[:, None]
        length = np.ones(len(z))
        for words, (table, vectors) in self.runs.items():
            at = own.marked(words, table)
            np.add.at(z, at[:, 0], vectors[at[:, 1]])
            np.add.at(length, at[:, 0], 1)
        length = np.sqrt(length)
        least = LEAST_COSINE * np.sqrt(1 - MARK * MARK)
        for at in range(0, len(z), 4096):
            along = z[at : at + 4096] @ self.vectors.T
            for w, k in zip(*np.nonzero(along >= least), strict=True):
                yield int(own.doc[at + w]), int(self.item[k]), int(at + w), float(along[w, k] / length[at + w]), int(self.offset[k])

    def _blocks(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Summed vectors of the words of each block; words without a vector add nothing."""
        known = rows >= 0
        count = np.add.reduceat(known.astype(np.int64), starts)
        first = np.cumsum(count) - count
        rows = rows[known]
        out = np.empty((len(starts), self.table.shape[1]), np.float32)
        for at in range(0, len(starts), 512):  # few enough blocks for the cache, the fullest first
            order = np.argsort(-count[at : at + 512], kind="stable") + at
            left = count[order]
            sums = np.zeros((len(order), self.table.shape[1]), np.float32)
            for k in range(int(left[0])):
                n = int(np.searchsorted(-left, -k, "left"))  # blocks with more than k known words
                sums[:n] += self.table.take(rows[first[order[:n]] + k], axis=0)
            out[order] = sums
        return out


class Block:
    """The items of one pass over the documents, and searchers of their pieces."""

    def __init__(self) -> None:
        self.items: list[tuple[object, np.ndarray]] = []
        self.searchers: list[Searcher] = []
        self.waiting: list[tuple[int, int, np.ndarray]] = []
        self.size = self.terms = 0

    def add(self, item: object, h: np.ndarray, idf: np.ndarray) -> bool:
        """Takes an item; whether there is room for more."""
        k = len(self.items)
        self.items.append((item, h))
        for at in pieces(len(h)):
            self.waiting.append((k, at, h[at : at + PIECE]))
            if len(self.waiting) == SPACE:
                self.close(idf)
        return self.size + len(self.waiting) < BLOCK and self.terms < TERMS

    def close(self, idf: np.ndarray) -> None:
        if self.waiting:
            self.searchers.append(Searcher(self.waiting, idf))
            self.size, self.terms = self.size + len(self.waiting), self.terms + len(self.searchers[-1].table)
            self.waiting = []

    def hits(self, own: Windows) -> list[tuple[int, int, float, float, float]]:
        """(text, item, cosine, covered, answer) of each contaminated text and item, from the best candidate window."""
        places: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        for s in self.searchers:
            for d, k, w, cosine, offset in s.candidates(own):
                places.setdefault((d, k), []).append((cosine, w, offset))
        found = {}
        for (d, k), where in places.items():
            best, h, begun = (0.0, 0.0, 0.0), self.items[k][1], []
            if len(h) < RUN:
                near = [cosine for cosine, w, _ in where if own.holds(w, h)]
                if near:
                    found[d, k] = (1.0, 1.0, max(near))
                continue
            for cosine, w, offset in sorted(where, key=lambda c: (-c[0], c[1], c[2])):
                begin, within, around = own.around(w, len(h), offset)
                if len(h) > 2 * PIECE:  # places a quarter of a long item apart are compared once
                    if any(abs(begin - b) <= len(h) // 4 for b in begun):
                        continue
                    begun.append(begin)
                covered, answer, bad = compare(h, around, within)
                if bad and (covered, answer, cosine) > best:
                    best = (covered, answer, cosine)
            if best[0]:
                found[d, k] = best
        return [(d, k, cosine, covered, answer) for (d, k), (covered, answer, cosine) in sorted(found.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, cosine, covered, answer_covered) of every contaminated document and the item it holds, stored."""
    own, items = (df.select(F.col(f"`{a}`").alias("id"), F.col(f"`{b}`").alias("text")) for df, a, b in ((docs, id, text), (benchmark, item, item_text)))
    kind, item_kind = own.schema["id"].dataType.simpleString(), items.schema["id"].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, cosine double, covered double, answer_covered double"
    out: DataFrame | None = None
    for block, square in _blocks_of_items(own, items):
        hits = stored(_search(own, block, square, schema, items.schema["id"].dataType), "hits")
        out = hits if out is None else out.unionByName(hits)
    out = docs.sparkSession.createDataFrame([], schema) if out is None else out
    return out.withColumnRenamed("id", id).withColumnRenamed("item", item)


def _blocks_of_items(docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple[Block, np.ndarray]]:
    """The blocks of items, and the squares of the terms' weights."""
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 1
    square = (idf * idf).astype(np.float32)
    block = Block()
    for r in benchmark.where("text IS NOT NULL").toLocalIterator():
        h, _ = word_hashes(pa.array([r[1]], pa.string()), PUNCTUATION)
        if len(h) >= SHORTEST and not block.add(r[0], h, idf):
            block.close(idf)
            yield block, square
            block = Block()
    block.close(idf)
    if block.items:
        yield block, square


def _search(docs: DataFrame, block: Block, square: np.ndarray, schema: str, item_kind: object) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(item_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                found = block.hits(Windows(*word_hashes(b.column("text"), PUNCTUATION), square))
                if found:
                    rows, items, *numbers = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows)), pa.array([block.items[k][0] for k in items], kind), *(pa.array(x, pa.float64()) for x in numbers)], ["id", "item", "cosine", "covered", "answer_covered"])

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the contaminated documents, all columns."""
    hits = stored(contaminated(docs, benchmark, id, text).select(F.col(f"`{id}`").alias("hit")).distinct(), "contaminated")
    return docs.join(hits, docs[f"`{id}`"] == hits["hit"], "left_anti")
