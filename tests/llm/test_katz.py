import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import katz
from millrace.llm.katz import K, discounts

LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def brute(texts, train):
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["\n"] for i, t in texts.items()}
    c, b = collections.Counter(), collections.Counter()
    for i in train:
        c.update(tokens[i])
        b.update(zip(["<s>", *tokens[i]], tokens[i], strict=False))
    total, distinct = sum(c.values()), len(c)
    d1, d2 = discounts(collections.Counter(c.values())), discounts(collections.Counter(b.values()))
    unknown = sum(v * (1 - d1[v]) for v in c.values() if v <= K) / total
    word = lambda w: d1[min(c[w], K + 1)] * c[w] / total if c[w] else unknown
    after = collections.defaultdict(list)
    for (v, w), n in b.items():
        after[v].append((w, n))
    weights = {}
    for v, own in after.items():
        n = sum(k for _, k in own)
        free = sum(k * (1 - d2[k]) for _, k in own if k <= K)
        if all(k > K for _, k in own):
            n, free = n + 1, 1
        weights[v] = (n, free / n / (1 - sum(word(w) for w, _ in own)))
        seen = {w for w, _ in own}
        p = sum(d2[min(k, K + 1)] * k / n for _, k in own) + weights[v][1] * (sum(word(w) for w in c if w not in seen) + unknown)
        assert abs(p - 1) < 1e-9
    out = {}
    for i, t in tokens.items():
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
        score = 0.0
        for v, w in zip(["<s>", *t], t, strict=False):
            n = b[v, w]
            score += math.log10(d2[min(n, K + 1)] * n / weights[v][0] if n else (weights[v][1] if v in weights else 1) * word(w))
        out[i] = (len(t), sum(c[w] > 0 for w in t), base, score)
    return out, total


@pytest.mark.parametrize("chunk, part", [(1500, 8_000_000), (1500, 3000), (2_000_000, 8_000_000)])
def test_scores_equal_brute_force(spark, sf, monkeypatch, chunk, part):
    monkeypatch.setattr(katz, "CHUNK", chunk)
    monkeypatch.setattr(katz, "PART", part)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(12).collect()}
    texts |= {1000: None, 1001: "", 1002: "unseen words only qqq", 1003: "the " * 400}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    scores, total, _ = katz.katz_scores(docs, F.col("doc_id") % 5 != 1)
    want, n = brute(texts, [i for i in texts if i % 5 != 1])
    got = {r["doc_id"]: r for r in scores.collect()}
    assert total == n and got.keys() == want.keys()
    for i, (tokens, known, base, score) in want.items():
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (tokens, known)
        assert got[i]["base_score"] == pytest.approx(base) and got[i]["score"] == pytest.approx(score)


def test_odd_tables(odd_docs, empty_docs):
    scores, _, _ = katz.katz_scores(odd_docs, F.col("doc_id") > 3)
    assert scores.count() == odd_docs.count()
    scores, total, distinct = katz.katz_scores(odd_docs, F.lit(False))
    assert (total, distinct) == (0, 0) and scores.where("n_known > 0 OR isnan(score)").count() == 0
    assert katz.katz_scores(empty_docs, F.lit(True))[0].count() == 0


def test_counts_over_32_bits():
    request = lambda chunk: (0, chunk, katz.pack(np.array([5, 9], np.uint64)), katz.pack(np.array([3_000_000_000, 1])), None, None)
    t = pa.Table.from_batches([katz._rows([request(1), request(2)], katz._REQUEST_ARROW)])
    out = katz._word_table(4, 6_000_000_002)(t).to_pylist()
    assert [katz.unpack(r["b"]).tolist() for r in out if r["kind"] == "word"] == [[6_000_000_000, 2]] * 2
    assert [r["n"][-2:] for r in out if r["kind"] == "stats"] == [[6_000_000_002, 2]]
    assert [katz.unpack(r["b"]).tolist() for r in out if r["kind"] == "top"] == [[6_000_000_000]]


def test_pairs_of_words_numbered_over_32_bits():
    """Two histories whose numbers agree in their low 32 bits stay apart."""
    first, second = np.array([7, 2**40 + 7], np.uint64), np.array([2**35, 3], np.uint64)
    row = (0, 1, katz.pack(first), katz.pack(second), katz.pack(np.array([5_000_000_000, 1])), katz.pack(np.array([4, 4])))
    out = katz._pair_table(np.zeros(0, np.uint64), np.ones(K + 2), 10)(pa.Table.from_batches([katz._rows([row, row], katz._REQUEST_ARROW)])).to_pylist()
    answers = [r for r in out if r["kind"] == "pair"]
    assert [katz.unpack(r["a"]).tolist() for r in answers] == [[10_000_000_000, 2]] * 2
    sums, _ = katz._untwo(pa.scalar(answers[0]["b"], pa.binary()))
    assert sums.reshape(-1, K + 2)[:, K].tolist() == [10_000_000_000, 2]
