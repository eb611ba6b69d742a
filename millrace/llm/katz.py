r"""Language-model scores by a Katz backoff bigram model over words.

Tokens are runs of characters other than space and 0x09-0x0D, A-Z lower-cased,
then one end. With counts c from the training texts, N tokens and V distinct:

    P(w)     = d(c) c / N, what discounting frees goes to one unknown word
    P(w | v) = D(c) c / c(v)          where v w was seen
             = a(v) P(w)              otherwise
    a(v)     = what D frees at v / (1 - sum of P(w) over the w seen after v)

``d`` and ``D`` are Good-Turing discounts for counts up to 5, from the counts
of counts of the whole corpus; where these give none between 0 and 1 (tiny
corpora), ``(c - 1/2) / c`` stands in. A history whose counts are all over 5
gets one more in its total, which is then free. With that each distribution
sums to 1 exactly. A history not seen, or unknown, passes straight to P(w).

Texts are read once, in chunks of about ``CHUNK`` tokens stored with their own
vocabularies. Two exchanges then go from chunks to parts of the model and back,
each with a chunk's *distinct* words or word pairs only, so a pair costs the
same however often a chunk has it. There are as many parts as the tokens need
at ``PART`` each, so a task's share is the same at every size:

* words: parts sum training counts, give each word a number, keep the table of
  counts and the counts of counts, and answer with number and count;
* pairs, by history: parts sum training counts and keep, for each history, its
  total, its counts of counts and the mass of the words seen after it. A
  history with more than ``2 N / parts`` tokens is spread over as many parts as
  it fills; there are under half as many such histories as parts, so their
  sums are gathered and sent to every task.

Each chunk at last evaluates its tokens by recursion on these answers. All
tables lie in the shared folder; counts and numbers of words have 64 bits. A
null text is an empty one: only its end counts. A very long text is a chunk of
its own. Ties don't matter; repeated rows are scored and counted each. A null
condition is no training row. An empty table gives an empty result. Further
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import partitions, stored
from .textkit import mix, slices, word_hashes

#: Tokens of a chunk, after which it is closed.
CHUNK = 1_000_000
#: Tokens whose words or pairs one part of the model holds, about.
PART = 8_000_000
#: Counts up to this one are discounted.
K = 5
_END = np.uint64(0x454E44)
#: The number of the begin of a text.
_BEGIN = np.uint64(2**64 - 1)


def pack(x: np.ndarray) -> bytes:
    """Integers, their bytes sorted by significance, compressed."""
    return x.dtype.char.encode() + zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes())


def unpack(b: bytes | pa.Scalar) -> np.ndarray:
    b = bytes(b.as_buffer()) if isinstance(b, pa.Scalar) else bytes(b)
    kind = np.dtype(b[:1].decode())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def discounts(counts_of_counts: dict[int, int]) -> np.ndarray:
    """Good-Turing discounts of counts 0 to K+1 (1 beyond K)."""
    n = lambda r: float(counts_of_counts.get(r, 0))
    out = np.ones(K + 2)
    cut = (K + 1) * n(K + 1) / n(1) if n(1) else 1.0
    for r in range(1, K + 1):
        d = ((r + 1) * n(r + 1) / (r * n(r)) - cut) / (1 - cut) if n(r) and cut < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def _chunks(docs: DataFrame, id: str, text: str, train: Column) -> DataFrame:
    """Stored chunks: ids, lengths and training flags of their texts, vocabulary, training counts, tokens as places in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        ids: list[pa.Array] = []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal number, size
            tokens, lengths, flags = (np.concatenate(c) for c in zip(*held, strict=True))
            words, stream = np.unique(tokens, return_inverse=True)
            counts = np.bincount(stream[np.repeat(flags, lengths)], minlength=len(words))
            own = pa.concat_arrays(ids)
            columns = [pa.array([number]), pa.array([len(tokens)]), pa.array([int(counts.sum())]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)]
            columns += [pa.array([pack(x)], pa.binary()) for x in (lengths, words, counts, stream.astype(np.uint32))]
            number, size = number + 1, 0
            ids.clear()
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["chunk", "size", "train", "ids", "lengths", "words", "counts", "stream"])

        for whole in batches:
            for b in slices(whole, text):
                h, bounds = word_hashes(b.column(text))
                lengths = np.diff(bounds) + 1
                tokens = np.full(lengths.sum(), mix(np.array([_END]))[0], np.uint64)
                inner = np.ones(len(tokens), bool)
                inner[np.cumsum(lengths) - 1] = False
                tokens[inner] = h
                held.append((tokens, lengths, b.column("_train").to_numpy(zero_copy_only=False).astype(bool)))
                ids.append(b.column(id))
                size += len(tokens)
                if size >= CHUNK:
                    yield close()
        if held:
            yield close()

    d = docs.select(id, text, F.coalesce(train, F.lit(False)).alias("_train"))
    kind = d.schema[id].dataType.simpleString()
    return stored(d.mapInArrow(run, f"chunk long, size long, train long, ids array<{kind}>, lengths binary, words binary, counts binary, stream binary"), "chunks")


_REQUEST = "part int, chunk long, a binary, b binary, c binary, d binary"


def _by_part(part: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each part, in a fixed order."""
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=n))
    for p in range(n):
        own = order[ends[p - 1] if p else 0 : ends[p]]
        if len(own):
            yield p, own


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)


_REQUEST_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), *((x, pa.binary()) for x in "abcd")])
_ANSWER_ARROW = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.list_(pa.int64())), ("mass", pa.float64())])
_ANSWER = "kind string, part int, chunk long, a binary, b binary, n array<long>, mass double"


def _word_requests(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                words, counts = unpack(b.column("words")[k]), unpack(b.column("counts")[k])
                chunk = b.column("chunk")[k].as_py()
                yield _rows([(p, chunk, pack(words[own]), pack(counts[own]), None, None) for p, own in _by_part((words % np.uint64(n)).astype(np.int64), n)], _REQUEST_ARROW)

    return run


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, K + 2).astype(np.int64), minlength=K + 3)[: K + 2].tolist()


def _word_table(n: int, total: int) -> Callable[[pa.Table], pa.Table]:
    """One part of the words: answers (number, count), its counts of counts with total and distinct, and its words of over ``2 total / n`` tokens."""

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        words = [unpack(x) for x in t.column("a")]
        ends = np.cumsum([len(w) for w in words])
        unique, inverse = np.unique(np.concatenate(words), return_inverse=True)
        c = np.bincount(inverse, np.concatenate([unpack(x) for x in t.column("b")]).astype(float), len(unique)).astype(np.int64)
        number = np.arange(len(unique), dtype=np.uint64) * np.uint64(n) + np.uint64(part)
        rows: list[tuple] = [("stats", part, None, None, None, [*_counts_of_counts(c), int(c.sum()), int((c > 0).sum())], None)]
        top = np.flatnonzero(c * n > 2 * total)
        if len(top):
            rows.append(("top", part, None, pack(number[top]), pack(c[top]), None, None))
        for k, e in enumerate(ends):
            own = inverse[e - len(words[k]) : e]
            rows.append(("word", part, t.column("chunk")[k].as_py(), pack(number[own]), pack(c[own]), None, None))
        return pa.Table.from_batches([_rows(rows, _ANSWER_ARROW)])

    return run


class _Chunk:
    """A chunk with its words' numbers and counts, and its distinct pairs in a fixed order."""

    def __init__(self, row: pa.Table, answers: pa.Table, n: int, hot: np.ndarray, spread: np.ndarray) -> None:
        self.chunk = row.column("chunk")[0].as_py()
        self.ids = row.column("ids").combine_chunks().flatten()
        self.lengths = unpack(row.column("lengths")[0]).astype(np.int64)
        words, self.stream = unpack(row.column("words")[0]), unpack(row.column("stream")[0]).astype(np.int64)
        self.number, self.count = np.zeros(len(words) + 1, np.uint64), np.zeros(len(words) + 1, np.int64)
        self.number[-1] = _BEGIN
        places = dict(_by_part((words % np.uint64(n)).astype(np.int64), n))
        self.answers = {}
        for kind, part, a, b, mass in zip(*(answers.column(x) for x in ("kind", "part", "a", "b", "mass")), strict=True):
            if kind.as_py() == "word":
                own = places[part.as_py()]
                self.number[own], self.count[own] = unpack(a), unpack(b)
            else:
                self.answers[part.as_py()] = (a, b, mass)
        before = np.empty_like(self.stream)
        before[1:] = self.stream[:-1]
        starts = np.cumsum(self.lengths) - self.lengths
        before[starts] = len(words)
        self.pairs, self.inverse = np.unique(before * (len(words) + 1) + self.stream, return_inverse=True)
        self.first, self.second = self.pairs // (len(words) + 1), self.pairs % (len(words) + 1)
        v, w = self.number[self.first], self.number[self.second]
        self.hot = np.minimum(np.searchsorted(hot, v), max(len(hot) - 1, 0))
        self.is_hot = hot[self.hot] == v if len(hot) else np.zeros(len(v), bool)
        part = mix(v) % np.uint64(n)
        own = self.is_hot
        part[own] = (part[own] + mix(w[own]) % spread[self.hot[own]]) % np.uint64(n)
        self.places = list(_by_part(part.astype(np.int64), n))


def _pair_requests(n: int, hot: np.ndarray, spread: np.ndarray, train_of: Callable[[pa.Table], np.ndarray]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(row: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(row):
            return pa.Table.from_batches([_rows([], _REQUEST_ARROW)])
        c = _Chunk(row, answers, n, hot, spread)
        seen = np.bincount(c.inverse[np.repeat(train_of(row), c.lengths)], minlength=len(c.pairs))
        rows = []
        for p, own in c.places:
            inner = np.where(seen[own] > 0, c.count[c.second[own]], 0)
            rows.append((p, c.chunk, *(pack(x) for x in (c.number[c.first[own]], c.number[c.second[own]], seen[own], inner))))
        return pa.Table.from_batches([_rows(rows, _REQUEST_ARROW)])

    return run


def _histories(number: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))


def _pair_table(hot: np.ndarray, d: np.ndarray, total: int) -> Callable[[pa.Table], pa.Table]:
    """One part of the pairs: answers (counts; each history's total, counts of counts and mass), and sums of the spread histories."""

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        firsts = [unpack(x) for x in t.column("a")]
        ends = np.cumsum([len(x) for x in firsts])
        second, seen, inner = (np.concatenate([unpack(x) for x in t.column(k)]) for k in "bcd")
        first, v = np.unique(np.concatenate(firsts), return_inverse=True)
        words, w = np.unique(second, return_inverse=True)
        unique, inverse = np.unique(v * len(words) + w, return_inverse=True)
        c = np.bincount(inverse, seen.astype(float), len(unique)).astype(np.int64)
        mass = np.zeros(len(unique))
        own = seen > 0
        mass[inverse[own]] = d[np.minimum(inner[own], K + 1)] * inner[own] / max(total, 1)
        v = unique // len(words)
        at = _histories(v)
        number = first[v[at]]
        sums = np.stack([np.add.reduceat((c == r).astype(np.int64), at) for r in range(1, K + 1)] + [np.add.reduceat(c, at), np.add.reduceat(np.where(c > K, 1, 0), at)], 1)
        masses = np.add.reduceat(mass, at)
        rows: list[tuple] = [("stats", part, None, None, None, _counts_of_counts(c), None)]
        for k in np.flatnonzero(np.isin(number, hot)):
            rows.append(("hot", part, None, None, None, [int(number[k].astype(np.int64)), *sums[k].tolist()], float(masses[k])))
        history = np.zeros(len(unique), np.int64)
        history[at[1:]] = 1
        history = np.cumsum(history)
        for k, e in enumerate(ends):
            mine = inverse[e - len(firsts[k]) : e]
            h = history[mine[_histories(firsts[k])]]
            rows.append(("pair", part, t.column("chunk")[k].as_py(), pack(c[mine]), _two(sums[h].ravel(), masses[h]), None, None))
        return pa.Table.from_batches([_rows(rows, _ANSWER_ARROW)])

    return run


def _two(a: np.ndarray, b: np.ndarray) -> bytes:
    x = pack(a)
    return len(x).to_bytes(8, "little") + x + pack(b.view(np.uint64))


def _untwo(s: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes(s.as_buffer())
    n = int.from_bytes(raw[:8], "little")
    return unpack(raw[8 : 8 + n]), unpack(raw[8 + n :]).view(float)


def backoff(sums: np.ndarray, mass: np.ndarray, big: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each history's total (0: not seen) and backoff weight. sums: counts of counts 1..K, total, pairs over K."""
    total = sums[:, K].astype(float)
    free = (sums[:, :K] * np.arange(1, K + 1) * (1 - big[1 : K + 1])).sum(1)
    none = (sums[:, :K].sum(1) == 0) & (total > 0)
    total, free = total + none, np.where(none, 1.0, free)
    weight = np.where(total > 0, free / np.maximum(total, 1) / np.maximum(1 - mass, 1e-12), 1.0)
    return total, weight


def _scores(n: int, hot: np.ndarray, spread: np.ndarray, hot_sums: np.ndarray, hot_mass: np.ndarray, small: np.ndarray, big: np.ndarray, total: int, distinct: int, unknown: float, kind: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = pa.schema([("id", kind), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    hot_total, hot_weight = backoff(hot_sums, hot_mass, big)

    def run(row: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(row):
            return schema.empty_table()
        c = _Chunk(row, answers, n, hot, spread)
        seen, history, weight = np.zeros(len(c.pairs)), np.zeros(len(c.pairs)), np.ones(len(c.pairs))
        for p, own in c.places:
            a, b, _ = c.answers[p]
            seen[own] = unpack(a)
            sums, mass = _untwo(b)
            t, w = backoff(sums.reshape(-1, K + 2), mass, big)
            at = np.zeros(len(own), np.int64)
            at[_histories(c.number[c.first[own]])[1:]] = 1
            at = np.cumsum(at)
            history[own], weight[own] = t[at], w[at]
        if len(hot):
            at = c.hot[c.is_hot]
            history[c.is_hot], weight[c.is_hot] = hot_total[at], hot_weight[at]
        word = np.where(c.count > 0, small[np.minimum(c.count, K + 1)] * c.count / max(total, 1), unknown)
        direct = big[np.minimum(seen, K + 1).astype(np.int64)] * seen / np.maximum(history, 1)
        p = np.log10(np.where(seen > 0, direct, weight * word[c.second]))
        base = np.log10((c.count + 0.5) / (total + 0.5 * (distinct + 1)))
        at = np.cumsum(c.lengths) - c.lengths
        columns = [c.lengths, np.add.reduceat((c.count[c.stream] > 0).astype(np.int64), at), np.add.reduceat(base[c.stream], at), np.add.reduceat(p[c.inverse], at)]
        return pa.Table.from_arrays([c.ids, *(pa.array(x) for x in columns)], schema=schema)

    return run


def katz_scores(docs: DataFrame, train: Column, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int, int]:
    """(id, n_tokens, n_known, base_score, score) of every text, N and V. ``train``: a condition on the ids, or other columns, of ``docs``."""
    least = partitions(docs.sparkSession)
    source = docs.select(F.struct(F.col(id).alias("id"), F.coalesce(train, F.lit(False)).alias("train")).alias("id"), F.col(text).alias("text"))
    chunks = _chunks(source, "id", "text", F.col("id.train"))
    many, tokens, total = (x or 0 for x in chunks.agg(F.count(F.lit(1)), F.sum("size"), F.sum("train")).first())
    n = max(least, -(-tokens // PART))
    # beyond the session's partitions tasks grow in number, not in size
    by_part = lambda df: (df.repartition(n, "part") if n > least else df).groupBy("part")
    by_chunk = lambda df: (df.repartition(many, "chunk") if many > least else df).groupBy("chunk")

    words = stored(by_part(chunks.select("chunk", "words", "counts").mapInArrow(_word_requests(n), _REQUEST)).applyInArrow(_word_table(n, total), _ANSWER), "words")
    sums = words.where("kind = 'stats'").select(*(F.sum(F.col("n")[k]).alias(f"s{k}") for k in range(K + 4))).first()
    sums = [s or 0 for s in sums]
    distinct = sums[K + 3]
    small = discounts(dict(enumerate(sums[: K + 2])))
    unknown = sum(sums[r] * r * (1 - small[r]) for r in range(1, K + 1)) / total if total else 1.0
    if total and unknown <= 0:  # no word occurs as rarely as K times: one more in the total is free
        unknown = 1 / (total + 1)
        small = small * total / (total + 1)
    hot, spread = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for r in words.where("kind = 'top'").select("a", "b").toLocalIterator():
        hot, spread = np.append(hot, unpack(r["a"])), np.append(spread, (unpack(r["b"]) * n // total + 1).astype(np.uint64))
    order = np.argsort(hot)
    hot, spread = hot[order], np.minimum(spread[order], np.uint64(n))

    answers = words.where("kind = 'word'")
    flags = lambda row: row.column("ids").combine_chunks().flatten().field("train").to_numpy(zero_copy_only=False).astype(bool)
    requests = by_chunk(chunks).cogroup(by_chunk(answers)).applyInArrow(_pair_requests(n, hot, spread, flags), _REQUEST)
    pairs = stored(by_part(requests).applyInArrow(_pair_table(hot, small, total), _ANSWER), "pairs")
    counts = pairs.where("kind = 'stats'").select(*(F.sum(F.col("n")[k]).alias(f"s{k}") for k in range(K + 2))).first()
    big = discounts({k: c or 0 for k, c in enumerate(counts)})
    gathered = pairs.where("kind = 'hot'").groupBy(F.col("n")[0].alias("number")).agg(*(F.sum(F.col("n")[k + 1]).alias(f"s{k}") for k in range(K + 2)), F.sum("mass").alias("mass")).collect()
    hot_sums, hot_mass = np.zeros((len(hot), K + 2), np.int64), np.zeros(len(hot))
    for r in gathered:
        k = int(np.searchsorted(hot, np.int64(r["number"]).astype(np.uint64)))
        hot_sums[k], hot_mass[k] = [r[f"s{j}"] for j in range(K + 2)], r["mass"]

    kind = docs.schema[id].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    own = pa.struct([("id", to_arrow_type(kind)), ("train", pa.bool_())])
    run = _scores(n, hot, spread, hot_sums, hot_mass, small, big, total, distinct, unknown, own)
    everything = answers.unionByName(pairs.where("kind = 'pair'")).drop("n")
    scored = by_chunk(chunks).cogroup(by_chunk(everything)).applyInArrow(run, f"id struct<id:{kind.simpleString()},train:boolean>, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id.id").alias(id), "n_tokens", "n_known", "base_score", "score"), total, distinct
