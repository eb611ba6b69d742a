import bisect
import random
import zlib

import numpy as np
import pytest

from millrace.llm import packing

pytest.importorskip("public_tokenizers")


def check(rows, capacity):
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
        assert ends[r["sequence_id"]] <= capacity
    return len(ends)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece(seed):
    rng = random.Random(seed)
    lengths = [min(256, max(1, int(rng.lognormvariate(3.5, 1.2)))) for _ in range(rng.choice([1, 30, 3000]))]
    histogram = {s: lengths.count(s) for s in set(lengths)}
    rows, n = packing.plan(histogram, 256)
    ranks, placed = {}, []
    for s in lengths:
        k = ranks[s] = ranks.get(s, -1) + 1
        q, o = packing.place(rows, np.array([s]), np.array([k]))
        placed.append({"sequence_id": int(q[0]), "offset": int(o[0]), "length": s})
    assert check(placed, 256) == n
    assert n <= 1.03 * -(-sum(lengths) // 256) + 2


def test_a_hot_length():
    rows, n = packing.plan({100: 10**9, 28: 10**9, 4096: 5}, 4096)
    assert n <= 1.01 * (128 * 10**9 / 4096) + 6 and len(rows) < 5000


def by_best_fit(lengths, capacity):
    """Sequences that best fit alone needs, a piece at a time."""
    rooms = []
    for s in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, s)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - s)
    return len(rooms)


@pytest.mark.parametrize("kind", ["uniform", "near a third", "just over half", "lognormal", "mixed"])
def test_never_more_sequences_than_best_fit(kind):
    rng = random.Random(9)
    draw = {"uniform": lambda: rng.randint(1, 4096), "near a third": lambda: rng.randint(1300, 1499), "just over half": lambda: rng.randint(2049, 2300), "lognormal": lambda: min(4096, 1 + int(rng.lognormvariate(6.5, 1))), "mixed": lambda: rng.randint(*rng.choice([(1300, 2047), (2049, 2300)]))}[kind]
    lengths = [draw() for _ in range(20000)]
    histogram = {s: lengths.count(s) for s in set(lengths)}
    rows, n = packing.plan(histogram)
    assert packing.least_sequences(histogram, 4096) <= n <= by_best_fit(lengths, 4096)
    ranks, placed = {}, []
    for s in lengths:
        k = ranks[s] = ranks.get(s, -1) + 1
        q, o = packing.place(rows, np.array([s]), np.array([k]))
        placed.append({"sequence_id": int(q[0]), "offset": int(o[0]), "length": s})
    assert check(placed, 4096) == n


def test_documents_round_trip(spark, odd_docs, odd_texts):
    packed = packing.pack_documents(odd_docs, with_ids=True, capacity=512)
    rows = packed.collect()
    check(rows, 512)
    bpe = packing.WordBpe(packing.tokenizer_path())
    for k, t in enumerate(odd_texts):
        own = sorted({(r["piece"], r["start"], bytes(r["ids"]), r["ids_crc32"]) for r in rows if r["doc_id"] == k})
        ids = bpe.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(b"".join(o[2] for o in own), "<u4").tolist() == ids
        assert all(zlib.crc32(o[2]) == o[3] for o in own) and [o[1] for o in own] == list(range(0, len(ids), 512))
    total = {r["sequence_id"]: len(bytes(r["ids"])) // 4 for r in packing.sequences(packed).collect()}
    assert sum(total.values()) == sum(r["length"] for r in rows) and max(total.values()) <= 512


def test_empty_table(empty_docs):
    assert packing.pack_documents(empty_docs).count() == 0
