"""Best-fit packing of token pieces by a linear grouping scheme.

Packing depends on lengths only, of which there are at most ``capacity``. So
the plan is made on the driver from the histogram of lengths, however many
documents there are, and its steps work on runs of equally filled sequences:

1. full pieces stand alone;
2. large lengths are sorted and cut into groups of equal cardinality, each
   rounded up to its largest (several numbers of groups are tried, none too,
   which is best fit alone, and the plan of fewest sequences is kept);
3. configurations of the few rounded sizes are optimised by column generation
   (revised simplex; a knapsack prices new configurations);
4. actual pieces take the places of their group, so a run is split wherever
   one of its lengths changes;
5. pieces that whole configurations left over and small ones are put, longest
   first, where they fit best.

The plan is a table of runs bounded by ``capacity`` and the number of groups,
and takes seconds on the driver whatever the number of documents.
Each piece finds its run by its length and its rank among equal lengths; ranks
come from a window over (length, salt) and offsets of the salts, so a length
that a third of all pieces share is spread over many tasks.

A null text is empty; an empty one still has the end token. Ties (equal
lengths) are ranked by id and piece. Repeated rows are packed each on its own.
An empty table gives no rows. Further columns aren't read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import partitions, stored
from .word_bpe import WordBpe

CAPACITY = 4096
#: Numbers of groups that plans are made with, until one is as near the lower bound as ``NEAR``.
GROUPS = (16, 64, 160)
NEAR = 1.0005
#: Lengths up to this part of the capacity are small.
SMALL = 4


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 1, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of ``capacity``: id, piece, start, length, ids_crc32 (and ids, little-endian uint32)."""
    path = path or tokenizer_path()
    tail = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)
        for b in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for k, t in enumerate(b.column(text)):
                ids = bpe.encode(t.as_py() or "") + tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    for column, x in zip(rows, (k, piece, at // 4, len(own) // 4, zlib.crc32(own), own if with_ids else b""), strict=True):
                        column.append(x)
            columns = [b.column(id).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:5])]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(rows[5], pa.binary())] if with_ids else [])], names)

    names = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    d = docs.select(id, text)
    kind = f"id {d.schema[id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return d.mapInArrow(run, kind).withColumnRenamed("id", id)


# --- the plan -------------------------------------------------------------


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration: how many of each size, sum at most ``capacity``."""
    best, steps = np.zeros(capacity + 1), []
    for k, s in enumerate(sizes):
        if values[k] <= 1e-12:
            continue
        for _ in range(capacity // int(s)):
            more = best[:-s] + values[k]
            better = more > best[s:] + 1e-12
            if not better.any():
                break
            steps.append((k, int(s), better))
            best[s:] = np.where(better, more, best[s:])
    out, at = np.zeros(len(sizes), np.int64), capacity
    for k, s, better in reversed(steps):
        if at >= s and better[at - s]:
            out[k] += 1
            at -= s
    return float(best[capacity]), out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of configurations of the rounded sizes, none of which holds more than the demand; what is left over is under one of each configuration."""
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.linalg.inv(basis)
    amount = inverse @ demand
    for k in range(rounds):
        value, column = _knapsack(sizes, np.ones(n) @ inverse, capacity)
        if value <= 1 + 1e-7:
            break
        u = inverse @ column
        ratio = np.where(u > 1e-9, amount / np.where(u > 1e-9, u, 1), np.inf)
        leave = int(ratio.argmin())
        basis[:, leave] = column
        if k % 32 == 31:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[leave] / u[leave]
            inverse = inverse - np.outer(u, row)
            inverse[leave] = row
        amount = np.maximum(inverse @ demand, 0)
    return [(basis[:, j].astype(np.int64), int(amount[j] + 1e-6)) for j in range(n) if amount[j] + 1e-6 >= 1]


class _Plan:
    """Runs of sequences with equal room, and where the pieces of each length went."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, pieces a sequence, offset
        self.ranks: dict[int, int] = {}
        self.rooms: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def put(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        rank = self.ranks.get(length, 0)
        self.rows.append((length, rank, sequence, each, offset))
        self.ranks[length] = rank + count

    def leave(self, room: int, sequence: int, count: int) -> None:
        if count and room:
            if room not in self.runs:
                bisect.insort(self.rooms, room)
            self.runs.setdefault(room, []).append((sequence, count))

    def best_fit(self, length: int, count: int) -> None:
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                n = -(-count // each)
                room, sequence, size = self.capacity, self.open(n), n
            else:
                room = self.rooms[at]
                sequence, size = self.runs[room].pop()
                if not self.runs[room]:
                    del self.runs[room], self.rooms[at]
                each = room // length
            whole = min(size, count // each)
            if whole:
                self.put(length, whole * each, sequence, each, self.capacity - room)
                self.leave(room - each * length, sequence, whole)
                count -= whole * each
            if whole < size:
                rest = min(count, each)
                if rest:
                    self.put(length, rest, sequence + whole, rest, self.capacity - room)
                    self.leave(room - rest * length, sequence + whole, 1)
                    count -= rest
                    whole += 1
                self.leave(room, sequence + whole, size - whole)


def least_sequences(histogram: dict[int, int], capacity: int) -> int:
    """No plan needs fewer: by volume, and as two lengths of over half the capacity never share."""
    return max(-(-sum(s * c for s, c in histogram.items()) // capacity), sum(c for s, c in histogram.items() if 2 * s > capacity))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, small: int = SMALL) -> tuple[np.ndarray, int]:
    """The plan of fewest sequences, the first of equal ones: its rows (length, first rank, first sequence, pieces a sequence, offset) sorted by length and rank, and the number of sequences."""
    best: _Plan | None = None
    for g in (0, *groups):
        own = grouped_plan(histogram, capacity, g, small)
        if best is None or own.sequences < best.sequences:
            best = own
        if g and best.sequences <= NEAR * least_sequences(histogram, capacity):
            break
    return np.array(sorted(best.rows), np.int64).reshape(-1, 5), best.sequences


def grouped_plan(histogram: dict[int, int], capacity: int, groups: int, small: int) -> _Plan:
    """One plan; without groups all lengths are put where they fit best."""
    out = _Plan(capacity)
    left = {int(s): int(c) for s, c in histogram.items() if c}
    if full := left.pop(capacity, 0):
        out.put(capacity, full, out.open(full), 1, 0)
    large = sorted((s for s in left if s * small > capacity), reverse=True) if groups else []
    total = sum(left[s] for s in large)
    if total:
        # Groups of equal cardinality over the lengths in descending order: (length, count) runs.
        width, members, room = -(-total // groups), [[]], -(-total // groups)
        for s in large:
            c = left[s]
            while c:
                if not room:
                    members.append([])
                    room = width
                take = min(c, room)
                members[-1].append([s, take])
                c, room = c - take, room - take
        sizes, demand = np.array([g[0][0] for g in members]), np.array([float(sum(c for _, c in g)) for g in members])
        unique, where = np.unique(sizes, return_inverse=True)  # groups rounded to the same size are one size
        joined: list[list] = [[] for _ in unique]
        for g, k in zip(members, where, strict=True):
            joined[k] += g
        need = np.bincount(where, demand, len(unique))
        for pattern, count in configurations(unique, need, capacity):
            slots = [k for k in range(len(unique)) for _ in range(pattern[k])]
            base, done = out.open(count), 0
            taken: list[list] = []  # for each slot its runs of lengths
            for k in slots:
                runs, want = [], count
                while want and joined[k]:
                    s, c = joined[k][0]
                    take = min(c, want)
                    runs.append([s, take])
                    want -= take
                    if take == c:
                        joined[k].pop(0)
                    else:
                        joined[k][0][1] = c - take
                if want:
                    runs.append([0, want])
                taken.append(runs)
            while done < count:
                step, offset = min((r[0][1] for r in taken), default=count), 0
                for r in taken:
                    s = r[0][0]
                    if s:
                        out.put(s, step, base + done, 1, offset)
                        left[s] -= step
                    offset += s
                    r[0][1] -= step
                    if not r[0][1]:
                        r.pop(0)
                out.leave(capacity - offset, base + done, step)
                done += step
    for s in sorted((s for s, c in left.items() if c), reverse=True):
        out.best_fit(s, left[s])
    return out


def place(rows: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by their length and rank."""
    key = lambda s, r: (s.astype(np.int64) << 48) + r
    own = rows[np.searchsorted(key(rows[:, 0], rows[:, 1]), key(length, rank), "right") - 1]
    k = rank - own[:, 1]
    return own[:, 2] + k // own[:, 3], own[:, 4] + (k % own[:, 3]) * length


def pack(pieces: DataFrame, id: str = "doc_id", capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, small: int = SMALL) -> DataFrame:
    """``pieces`` (id, piece, length and more) with sequence_id and offset. ``pieces`` is read several times: pass a stored table."""
    spark = pieces.sparkSession
    salts = max(64, partitions(spark))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(id, "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    rows, _ = plan(histogram, capacity, groups, small)
    before = counts.select("length", "_salt", (F.sum("count").over(W.partitionBy("length").orderBy("_salt")) - F.col("count")).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_salt").orderBy(id, "piece")) - 1)
    ranked = ranked.join(before, ["length", "_salt"]).select(*pieces.columns, (F.col("_before") + F.col("_rank")).cast("long").alias("_rank"))
    names = [*pieces.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = place(rows, b.column("length").to_numpy(), b.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False, path: str | None = None) -> DataFrame:
    """Tokenises and packs ``docs``: a row for each piece."""
    return pack(stored(token_pieces(docs, id, text, capacity, path=path, with_ids=with_ids), "pieces"), id, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids themselves: a row for each sequence, of ``capacity`` ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(parts.alias("_p")).select("sequence_id", F.unhex(F.array_join(F.col("_p.ids"), "")).alias("ids"))
