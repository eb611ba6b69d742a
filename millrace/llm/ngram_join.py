r"""Exact similarity self-join of word n-gram sets by set-relation skipping.

Words are runs of characters other than space and 0x09-0x0D, A-Z lower-cased.
A text's set holds its distinct 5-word shingles (with fewer words: the whole
sequence as one), as 64-bit hashes. Texts are linked when the Jaccard
similarity of their sets is 0.8 or more.

1. Equal sets become one class; its key is a 64-bit hash of the set. A group of
   copies of any size costs one row for each task that saw it.
2. Each set is ordered, rare shingles first (those that recur within a task's
   slice of the corpus come last, ``FREQUENT`` of them at most; the order only
   saves work, any order gives the same links). Only the first
   ``n - ceil(0.8 n) + 1`` places are indexed: two linked sets share one there.
3. Index lists. Within a list every set is first compared with one pivot, the
   set whose places are shared most (the original, in a group of near copies).
   As all sets near a pivot then carry its component, the answers of a set are
   taken from the answers of the similar set: pairs inside a component
   need no comparison, and a group of thousands of near copies costs one
   comparison each. A second round takes a pivot outside the first's component.
   From then on answers are derived before sketches are moved, where there are
   over ``DERIVE`` pairs (below, comparing costs less): if a is linked to p at
   distance x (1 - similarity, a metric) and b is known to be at least y from
   p, then a and b are at least y - x apart, and over 0.2 they are no link.
   Lists of over ``HOT`` sets are dealt by salt and their minima and pivots
   taken in two steps, never in one task.
4. What is left are lists that hold several components. They are joined in
   blocks by size band, and places are used to skip: with ``r`` shingles left
   from its place on, a set reaches only partners of up to ``2.25 r - n``
   shingles, so late places skip whole blocks and most are never probed.
5. Every candidate pair is first compared on sketches: ``SKETCH`` bits, each
   the parity of the number of elements that hash to it. Sets of a and b
   elements that are linked differ in (a + b) / 9 elements at most, and
   sketches differ in no more bits than sets in elements; so the rest can go,
   with what the bits say of their distance. Those that stay are compared on
   the full sets.

Nothing is capped: lists are joined by Spark, which splits hot ones. Sets are
built again for the texts of candidate pairs only, found by a bitmap with
``SPARE`` bits for each, or by a join where that would be over ``BITMAP`` bits; a
false hit costs time, no result.

Null and empty texts have no shingles and no links, rows with a null id none
but those of copies. Very long texts are sets like others. Repeated rows are one
class. Ties in order are broken by hash. An empty table gives an empty result.
Further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import stars
from .tables import drop, stored
from .textkit import mix, slices, word_hashes

WORDS = 5
#: Bounds: shingles that are ordered by frequency; most bits of the text filter, and its bits for each text.
FREQUENT, BITMAP, SPARE = 100_000, 1 << 26, 16
#: A shingle counted so often is hot: its list is dealt to ``SALTS`` parts. Pairs beyond which answers are derived.
HOT, SALTS, DERIVE = 1_000_000, 256, 1_000_000
#: Bits of a set's sketch.
SKETCH = 2048
#: Rounds of comparison with pivots.
PIVOTS = 2
#: A shingle that so many texts of a slice share counts as frequent there.
_SHARED, _SLICE = 4, 2_000_000
_MULTIPLIERS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    h, bounds = word_hashes(texts)
    s = np.zeros(0, np.uint64)
    if len(h) >= WORDS:
        n = len(h) - WORDS + 1
        s = h[:n] * _MULTIPLIERS[0]
        for k in range(1, WORDS):
            s = mix(s ^ h[k : k + n]) * _MULTIPLIERS[k] if k % 2 else s + h[k : k + n] * _MULTIPLIERS[k]
        s = mix(s)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WORDS:
            own = np.sort(s[a : b - WORDS + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes(), seed=b - a)], np.uint64))
        else:
            out.append(s[:0])
    return out


def set_key(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def sketch(own: np.ndarray) -> bytes:
    """The parity of the number of elements at each of ``SKETCH`` bits."""
    at = np.bincount((own >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(at.astype(np.uint8)).tobytes()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _scan(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Per text its set's size and key; and shingles that recur within a slice, with how often as a negative size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        held: list[np.ndarray] = []

        names = ["id", "n", "key", "sketch"]

        def recurring() -> pa.RecordBatch:
            s, n = np.unique(np.concatenate(held), return_counts=True)
            s, n = s[n >= _SHARED], n[n >= _SHARED]
            top = np.argsort(-n, kind="stable")[:FREQUENT]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(len(top), kind), pa.array(-n[top].astype(np.int64)), pa.array(_signed(s[top])), pa.nulls(len(top), pa.binary())], names)

        for whole in batches:
            kind = whole.column(id).type
            for b in slices(whole, text):
                sets = shingle_sets(b.column(text))
                keys = pa.array([set_key(x) if len(x) else None for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(id), pa.array([len(x) for x in sets], pa.int64()), keys, pa.array([sketch(x) if len(x) else None for x in sets], pa.binary())], names)
                held += sets
                if sum(map(len, held)) >= _SLICE:
                    yield recurring()
        if held:
            yield recurring()

    d = docs.select(id, text)
    return d.mapInArrow(run, f"id {d.schema[id].dataType.simpleString()}, n long, key long, sketch binary")


def prefix(own: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The indexed places of a sorted set, in the common order. ``frequent``: sorted shingles; ``rank``: theirs, the rarest first."""
    n = len(own)
    p = n - (4 * n + 4) // 5 + 1
    if not len(frequent):
        return own[:p]
    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
    often = frequent[at] == own
    rare = own[~often]
    if len(rare) >= p:
        return rare[:p]
    late = np.flatnonzero(often)
    return np.concatenate([rare, own[late[np.argsort(rank[at[late]], kind="stable")]]])[:p]


def _index(docs: DataFrame, text: str, frequent: np.ndarray, rank: np.ndarray, hot: np.ndarray) -> DataFrame:
    """(token, key, n, place) of each set's indexed places, and a salt, 0 but for hot tokens, if there are any. A set that a task has seen before is left out there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for b in slices(whole, text):
                parts: list[tuple] = []
                for own in shingle_sets(b.column(text)):
                    if not len(own) or (key := set_key(own)) in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(key)
                    p = prefix(own, frequent, rank)
                    parts.append((p, np.full(len(p), key), np.full(len(p), len(own), np.int32), np.arange(len(p), dtype=np.int32)))
                if parts:
                    token, key, n, place = (np.concatenate(c) for c in zip(*parts, strict=True))
                    salt = [pa.array(np.where(np.isin(token, hot), 1 + key % SALTS, 0).astype(np.int32))] if len(hot) else []
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(token)), pa.array(key), pa.array(n), pa.array(place), *salt], names)

    names = ["token", "key", "n", "place", *(["salt"] if len(hot) else [])]
    return docs.select(text).mapInArrow(run, "token long, key long, n int, place int" + ", salt int" * bool(len(hot)))


def over_lists(rows: DataFrame, **aggregates: Column) -> DataFrame:
    """``rows`` with aggregates of their lists: by windows, those of hot lists by an aggregate that Spark combines before it moves rows, and a join."""
    if "salt" not in rows.columns:
        return rows.select("*", *(a.over(W.partitionBy("token")).alias(n) for n, a in aggregates.items()))
    cold = rows.where("salt = 0").select("*", *(a.over(W.partitionBy("token")).alias(n) for n, a in aggregates.items()))
    hot = rows.where("salt > 0")
    found = hot.groupBy("token").agg(*(a.alias(n) for n, a in aggregates.items()))
    return cold.unionByName(hot.join(found, "token"))


def bitmap(ids: DataFrame, id: str, bits: int) -> np.ndarray:
    """A bitmap of the ids' hashes, in 64-bit words."""
    h = F.pmod(F.xxhash64(id), F.lit(bits))
    words = ids.select(F.shiftright(h, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{id}`), {bits}) & 63 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    out, found = np.zeros(bits >> 6, np.int64), words.toArrow()
    out[found["w"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def _sets(docs: DataFrame, id: str, text: str, keys: DataFrame) -> DataFrame:
    """(key, elements) of the texts whose ids are in ``keys`` (id, key), and of a few more."""
    size = max(1 << 16, 1 << (SPARE * keys.agg(F.approx_count_distinct("key")).first()[0]).bit_length())
    bits = bitmap(keys, id, size) if size <= BITMAP else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if bits is not None:
                h = whole.column("_h").to_numpy()
                whole = whole.filter(pa.array((bits[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for b in slices(whole, text):
                sets = shingle_sets(b.column(text))
                yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["key", "elements"])

    d = docs.select(id, text, F.pmod(F.xxhash64(id), F.lit(size)).alias("_h"))
    if bits is None:
        d = d.join(keys.select(id).distinct(), id, "left_semi")
    return d.mapInArrow(run, "key long, elements binary")


def _sketched(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``pairs`` with what their sketches say: whether they may be linked, and how far apart they are at least; and the first ids of those that may be."""
    kind = classes.schema["first"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(v.as_py() for v in b.column(c)), np.uint8).reshape(len(b), SKETCH // 8) for c in ("x", "y"))
            apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            both = b.column("na").to_numpy() + b.column("nb").to_numpy()
            likely = pa.array(9 * apart <= both)
            firsts = [pc.if_else(likely, b.column(c), pa.scalar(None, b.column(c).type)) for c in ("fa", "fb")]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), likely, pa.array((np.floor(2000 * apart / (both + apart)) / 1000).astype(np.float32)), *firsts], ["a", "b", "likely", "apart", "fa", "fb"])

    for own, other, n, first in (("a", "x", "na", "fa"), ("b", "y", "nb", "fb")):
        pairs = pairs.join(classes.select(F.col("key").alias(own), F.col("sketch").alias(other), F.col("n").alias(n), F.col("first").alias(first)), own)
    return pairs.mapInArrow(run, f"a long, b long, likely boolean, apart float, fa {kind}, fb {kind}")


def _underived(pairs: DataFrame, links: DataFrame, compared: DataFrame) -> DataFrame:
    """Those of ``pairs`` that no known answer rules out. links (a, b, apart): linked, with their distance; compared: with a lower bound of it."""
    ways = lambda df, x, p, d: df.select(F.col("a").alias(x), F.col("b").alias(p), F.col("apart").alias(d)).union(df.select(F.col("b").alias(x), F.col("a").alias(p), F.col("apart").alias(d)))
    near, far = ways(links, "x", "p", "near"), ways(compared.where("apart > 0.2"), "y", "q", "far")
    both = pairs.select("a", "b", F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("a", "b", "b", "a"))
    known = both.join(near, F.col("u") == F.col("x")).join(far, (F.col("v") == F.col("y")) & (F.col("p") == F.col("q")))
    return pairs.join(known.where("far - near > 0.2 + 1e-6").select("a", "b").distinct(), ["a", "b"], "left_anti")


def _linked(pairs: DataFrame, docs: DataFrame, id: str, text: str) -> DataFrame:
    """Those of ``pairs`` (a, b: keys; fa, fb: their first ids) whose sets' Jaccard similarity is 0.8 or more, and their distance, stored."""
    ends = F.array(*(F.struct(F.col(first).alias(id), F.col(key).alias("key")) for first, key in (("fa", "a"), ("fb", "b"))))
    keys = pairs.select(F.explode(ends).alias("e")).select("e.*")
    sets = stored(_sets(docs, id, text, keys), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, apart = [], []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                union = len(x) + len(y) - both
                keep.append(100 * both >= 80 * union)
                apart.append(1 - both / union)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(apart, pa.float64())], ["a", "b", "apart"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.select("a", "b").join(sets.select(F.col("key").alias("a"), F.col("elements").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("key").alias("b"), F.col("elements").alias("y")), "b")
    out = stored(with_b.mapInArrow(run, "a long, b long, apart double").distinct(), "links")
    drop(docs.sparkSession, sets)
    return out


def _fits(a: str, b: str) -> str:
    """Sizes within reach, and enough shingles left from both places on."""
    return f"5 * least({a}n, {b}n) >= 4 * greatest({a}n, {b}n) AND 9 * least({a}n - {a}place, {b}n - {b}place) >= 4 * ({a}n + {b}n)"


def _pivot_pairs(rows: DataFrame, k: int) -> DataFrame:
    """Each list's sets with its pivot: the heaviest set, later the heaviest outside the first pivot's component."""
    own = F.struct("weight", "key", "c", "n", "place")
    rows = over_lists(rows, p=F.max(own))
    if k:
        rows = over_lists(rows.withColumnRenamed("p", "p0"), p=F.max(F.when(F.col("c") != F.col("p0.c"), own)))
    pairs = rows.where(f"c <> p.c AND {_fits('', 'p.')}")
    return pairs.select(F.least("key", "p.key").alias("a"), F.greatest("key", "p.key").alias("b")).distinct()


def _block_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of sets in one list and different components that can be similar, by blocks of sizes."""
    band = lambda n: F.floor(F.log(n) / F.lit(float(np.log(1.25))))
    rows = rows.dropDuplicates(["token", "key"])
    reach = F.least(F.col("n") * 1.25, (F.col("n") - F.col("place")) * 2.25 - F.col("n"))
    probes = rows.where(reach >= F.col("n")).select("token", F.explode(F.sequence(band(F.col("n")), band(reach))).alias("band"), *(F.col(c).alias(f"a_{c}") for c in ("key", "n", "place", "c")))
    blocks = rows.select("token", band(F.col("n")).alias("band"), *(F.col(c).alias(f"b_{c}") for c in ("key", "n", "place", "c")))
    pairs = probes.join(blocks, ["token", "band"]).where(f"(a_n < b_n OR a_n = b_n AND a_key < b_key) AND a_c <> b_c AND {_fits('a_', 'b_')}")
    return pairs.select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b")).distinct()


def similar_classes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, n, key) of every text, and (key, first, component) of every class of equal sets: its least id, and the least id that its links reach."""
    scan = stored(_scan(docs, id, text), "shingles")
    members = scan.where("n > 0 AND id IS NOT NULL")
    top = scan.where("n < 0").groupBy("key").agg(F.sum(-F.col("n")).alias("c")).orderBy(F.desc("c"), "key").limit(FREQUENT).collect()
    often = np.array([r["key"] for r in top], np.int64).view(np.uint64)
    hot = np.array([r["key"] for r in top if r["c"] >= HOT], np.int64).view(np.uint64)
    order = np.argsort(often)
    frequent, rank = often[order], (len(often) - order).astype(np.int64)
    classes = stored(members.groupBy("key").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")

    # Index lists of two or more sets, each row with its set's weight; a hot list's parts are kept whatever they hold.
    salted = ["salt"] if len(hot) else []
    lists = W.partitionBy("token", *salted)
    index = _index(docs, text, frequent, rank, hot).select("*", F.min("key").over(lists).alias("k0"), F.max("key").over(lists).alias("k1"), F.count(F.lit(1)).over(lists).alias("many"))
    index = stored(index.where("k0 <> k1 OR salt > 0" if salted else "k0 <> k1").drop("k0", "k1"), "lists")
    weight = stored(index.groupBy("key").agg((F.sum("many") / F.max(F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1)).alias("weight")), "weights")
    rows = index.drop("many").join(weight, "key").withColumn("c", F.col("key"))

    # Rounds of comparison with one pivot for each list, then the rest in blocks.
    spark, spent = docs.sparkSession, [index, weight]
    done: DataFrame | None = None
    links: DataFrame | None = None
    found: DataFrame | None = None
    for k in range(PIVOTS + 1):
        if found is not None:
            c = F.coalesce("component", "key").alias("c")
            rows = rows.drop("c").join(found.withColumnRenamed("node", "key"), "key", "left").select("token", *salted, "key", "n", "place", "weight", c)
            rows = stored(over_lists(rows, c0=F.min("c"), c1=F.max("c")).where("c0 <> c1").drop("c0", "c1"), "mixed-lists")
            drop(spark, *spent)
            spent = [rows]
        pairs = _pivot_pairs(rows, k) if k < PIVOTS else _block_pairs(rows)
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        many = pairs.count()
        if not many:
            continue
        left = _underived(pairs, links, done) if done is not None and many > DERIVE else pairs
        compared = stored(_sketched(left, classes), "compared")
        drop(spark, pairs)
        done = compared if done is None else done.union(compared)
        more = _linked(compared.where("likely"), docs, id, text)
        links = more if links is None else links.union(more)
        # New links join the stars that are known.
        known = found
        found = stars(more if known is None else more.select("a", "b").union(known))
        if known is not None:
            drop(spark, known)
    drop(spark, *spent)
    component = F.coalesce("component", "key")
    if found is None:
        found = docs.sparkSession.createDataFrame([], "node long, component long")

    # Each class's component, named by its least id.
    named = classes.join(found.withColumnRenamed("node", "key"), "key", "left").select("key", "first", component.alias("c"))
    least = stored(named.groupBy("c").agg(F.min("first").alias("component")), "least")
    return scan.where("n >= 0").drop("sketch").withColumnRenamed("id", id), stored(named.join(least, "c").select("key", "first", "component"), "named")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every text with an id."""
    members, named = similar_classes(docs, id, text)
    return members.join(named.select("key", "component"), "key", "left").select(id, F.col("n").alias("n_shingles"), F.coalesce("component", id).alias("component_id"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, but of each component only the rows of its least id. Rows without shingles, or with a null id, stay.

    Only ids move: those to be dropped are few columns wide, and every
    document is looked up among them.
    """
    own = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    members, named = similar_classes(own, "id", "text")
    drop = members.join(named.select("key", "component"), "key").where(F.col("id") != F.col("component")).select(F.col("id").alias("copy"))
    copies = stored(drop.distinct(), "copies")
    return docs.join(copies, docs[f"`{id}`"] == copies["copy"], "left_anti")
