import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontam, quality_knn, token_counts, toxicity
from millrace.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    rows = QUERIES["op1_quality_knn"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    n, right, good, kept = rows.agg(F.count(F.lit(1)), F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.sum("quality"), F.sum(F.col("predicted") * F.col("quality"))).first()
    assert right / n > 0.95 and kept / good > 0.97


def test_toxicity_on_held_out_rows(spark):
    rows = QUERIES["op2_toxicity_chain"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    n, right, false = rows.agg(F.count(F.lit(1)), F.sum((F.col("predicted") == F.col("toxic")).cast("int")), F.sum(F.col("predicted") * (1 - F.col("toxic")))).first()
    assert right / n > 0.97 and false / n < 0.01


def test_chain_uses_earlier_probabilities():
    rng = np.random.default_rng(2)
    first = rng.integers(0, 2, 400)
    h, bounds = np.where(first > 0, 1, 2).astype(np.uint64), np.arange(401)
    words = [np.array([1, 2], np.uint64)] * (toxicity.FOLDS + 1)
    none = [np.zeros(0, np.uint64)] * (toxicity.FOLDS + 1)
    chain = toxicity.Chain().fit(h, bounds, np.column_stack([first, first]), np.arange(400) % toxicity.FOLDS, [words, none])
    p = chain.predict(h, bounds)  # the second category has no words of its own
    assert ((p[:, 1] > 0.5) == first).all() and abs(chain.models[1][1].b[1]) > 0.1


def test_vocabularies_leave_their_fold_out(spark):
    """A word that tells the label in one fold only isn't chosen without that fold; equal to a plain loop."""
    rng = random.Random(3)
    rows = [(w, [rng.randint(0, 9) for _ in range(3)]) for w in range(40)]
    rows = [(w, n, [rng.randint(0, x) for x in n]) for w, n in rows] + [(99, [9, 0, 0], [9, 0, 0])]
    counts = spark.createDataFrame(rows, "hash long, n array<long>, k array<long>")
    got = toxicity.telling(counts, [30, 30, 30], [12, 10, 9], most=8)
    for f in range(4):
        n, k = ([sum(x for j, x in enumerate(r[c]) if j != f) for r in rows] for c in (1, 2))
        texts, positive = sum(30 for j in range(3) if j != f), sum(x for j, x in enumerate((12, 10, 9)) if j != f)
        chi = {r[0]: (b - a * positive / texts) ** 2 / max(a * positive / texts * (1 - positive / texts) * (1 - a / texts), 1e-9) for r, a, b in zip(rows, n, k, strict=True) if a >= toxicity.LEAST}
        assert got[f].tolist() == sorted(sorted(chi, key=lambda w: (-chi[w], w))[:8])
    assert 99 in got[3] and 99 not in got[0]


def test_votes_equal_a_plain_loop():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 4, (60, quality_knn.TERMS)) * (rng.random((60, quality_knn.TERMS)) < 0.05)
    labels = rng.integers(0, 2, 60)
    model = quality_knn.Model(counts, labels, {0: 300, 1: 700}, (counts > 0).sum(0), 60)
    texts = rng.integers(0, 3, (20, quality_knn.TERMS)) * (rng.random((20, quality_knn.TERMS)) < 0.05)
    got = model.score(texts, block=7)
    z = model.latent(quality_knn.weighted(texts, model.idf))
    for row, s in zip(z, got, strict=True):
        near = sorted(((float(row @ v), -k) for k, v in enumerate(model.vectors)), reverse=True)[: quality_knn.NEIGHBOURS]
        votes = [(max(c, 1e-6) ** quality_knn.SHARPNESS * model.weights[-k], labels[-k]) for c, k in near]
        assert s == pytest.approx(sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs=1e-4)


def test_models_on_odd_tables(spark, odd_docs, empty_docs):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(14)] + [(None, 1, 1), (3, None, None), (3, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for own in (labels, none):
        model = quality_knn.fit(odd_docs, own)
        got = quality_knn.score(odd_docs.select("doc_id", "text", "lang"), model).collect()
        assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got) and {r["doc_id"]: r["score"] for r in got}[1] == 0
        assert quality_knn.keep_good(odd_docs, model).columns == odd_docs.columns
        chain = toxicity.fit(odd_docs, own)
        assert toxicity.score(odd_docs, chain).count() == odd_docs.count()
    assert quality_knn.score(empty_docs.select("doc_id", "text"), quality_knn.fit(empty_docs, labels)).count() == 0
    assert toxicity.score(empty_docs, toxicity.fit(empty_docs, labels)).count() == 0


def test_decontamination_finds_copies_and_paraphrases(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(k, text(rng.randint(12, 60))) for k in range(30)]
    docs, want = [], set()
    for k in range(120):
        t = text(rng.choice([5, 40, 400]))
        if k % 4 == 0:
            i, own = items[k // 4]
            words = own.split()
            if k % 8 == 0:  # a few words replaced or dropped
                for at in rng.sample(range(len(words)), len(words) // 10):
                    words[at] = rng.choice(["", "zz"])
            t, want = f"{t}. {' '.join(words)}, {text(30)}".upper() if k % 3 else f"{' '.join(words)} {t}", want | {(k, i)}
        docs.append((k, t))
    docs += [(500, None), (501, ""), (None, text(50))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([*items, (90, None), (91, ""), (92, "two words")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, b).collect()} == want
    assert {r["doc_id"] for r in decontam.decontaminate(d, b).collect()} == {k for k, _ in docs} - {k for k, _ in want}
    assert decontam.contaminated(d, b.limit(0)).count() == 0 and decontam.contaminated(d.limit(0), b).count() == 0


def test_decontamination_finds_every_exact_copy(spark):
    words = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    items = [(r["item_id"], words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(r["doc_id"], i) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for i, t in items if t in words(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op4_decontamination"](spark, SF).collect()}
    assert want and got >= want


def test_decontamination_finds_copies_of_thousands_of_items(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(20000)]
    text = lambda n: " ".join(vocabulary[int(20000 * rng.random() ** 3)] for _ in range(n))
    items = [(k, text(rng.choice([6, 10, 20, 40, 80]) if k % 100 else 600)) for k in range(2500)]
    docs = [(k, f"{text(rng.randint(0, 60))} {items[k][1]} {text(40)}") for k in range(0, 2500, 5)] + [(k, text(100)) for k in range(5000, 5200)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, b).collect()} == {(k, k) for k in range(0, 2500, 5)}


@pytest.mark.parametrize("paraphrased", [False, True])
def test_items_of_any_length_are_found(spark, paraphrased):
    """Items of 3 to 2,000 words (paraphrases from 10), inside longer texts; other texts of the same words stay."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(20000)]
    text = lambda n: " ".join(vocabulary[int(20000 * rng.random() ** 2)] for _ in range(n))
    sizes = [10, 20, 40, 63, 64, 65, 100, 130, 400, 500, 800, 1500, 2000] + ([] if paraphrased else [3, 4, 5, 6, 7])
    items = [(k, text(sizes[k % len(sizes)])) for k in range(6 * len(sizes))]
    docs = []
    for k, own in items:
        words = own.split()
        if paraphrased:  # one word in seven replaced, one in twenty left out
            words = [rng.choice(vocabulary) if rng.random() < 1 / 7 else w for w in words if rng.random() > 1 / 20]
        docs.append((k, f"{text(rng.randint(0, 300))} {' '.join(words)} {text(rng.randint(0, 300))}"))
    docs += [(1000 + k, text(rng.choice([5, 100, 3000]))) for k in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, b).collect()}
    want = {(k, k) for k, _ in items}
    assert len(want & got) >= (0.95 if paraphrased else 1) * len(want)
    assert len({p for p in got - want if len(items[p[1]][1].split()) > 5}) == 0


def test_an_item_longer_than_a_part(spark):
    rng = random.Random(13)
    text = lambda n: " ".join(f"w{int(9000 * rng.random() ** 2)}" for _ in range(n))
    item = text(9000)
    words = item.split()
    near = " ".join(w for k, w in enumerate(words) if k % 15)
    half = " ".join(words[:3000])
    d = spark.createDataFrame([(1, f"{text(500)} {item}"), (2, f"{near} {text(90)}"), (3, half), (4, text(9000))], "doc_id long, text string")
    found = {r["doc_id"]: r["covered"] for r in decontam.contaminated(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert found.keys() == {1, 2} and found[1] == 1


def test_the_latent_space_is_cut_and_loses_no_row():
    rng = np.random.default_rng(3)
    rows = []
    for k in range(90):
        own = np.unique(np.append(rng.choice(400, 20, replace=False), 400 + k))
        w = rng.random(len(own)) + 0.1
        rows.append((own, w / np.linalg.norm(w)))
    terms = np.unique(np.concatenate([own for own, _ in rows]))
    basis = decontam.latent_space(rows, terms)
    m = np.zeros((len(rows), len(terms)))
    for k, (own, w) in enumerate(rows):
        m[k, np.searchsorted(terms, own)] = w
    kept = ((m @ basis) ** 2).sum(1)
    assert basis.shape[1] < len(rows) and kept.min() >= decontam.EACH - 1e-4 and kept.mean() >= decontam.KEPT - 1e-4
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-3)


def test_candidates_come_through_the_latent_space_only(spark, monkeypatch):
    d = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "x a short item y"), (3, "other words")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "two three four five six seven eight nine"), (8, "a short item")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, b).collect()} == {(1, 7), (2, 8)}
    monkeypatch.setattr(decontam, "latent_space", lambda rows, terms: np.zeros((len(terms), 2), np.float32))
    assert decontam.contaminated(d, b).count() == 0


def test_decontamination_with_clashing_names(spark):
    d = spark.createDataFrame([(1, "one two three four five six seven", "a"), (2, "other words", "b"), (None, "x", "c")], "`doc.id` long, text string, hit string")
    b = spark.createDataFrame([(7, "two three four")], "item_id long, text string")
    out = decontam.decontaminate(d, b, id="doc.id")
    assert out.columns == d.columns and sorted(r["hit"] for r in out.collect()) == ["b", "c"]


def test_longest_common_subsequence():
    a, b = np.array([1, 2, 3, 4, 5]), np.array([9, 1, 3, 9, 4, 2, 5])
    x, y = decontam.common_subsequence(a, b)
    assert a[x].tolist() == b[y].tolist() == [1, 3, 4, 5]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_equal_brute_force(spark, odd_docs, odd_texts, rule):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    assert public_tokenizers
    bpe = token_counts.ByteBpe()
    got = {}
    for r in token_counts.section_tokens(odd_docs, rule=rule).collect():
        got.setdefault(r["doc_id"], {})[r["section"]] = (r["start"], r["length"], r["n_tokens"])
    for k, t in enumerate(odd_texts):
        t = t or ""
        lines = [x for x in re.findall(r"[^\n]*\n|[^\n]+$", t)] or [""]
        own, at = [], 0
        for x in lines:
            own.append([at, len(x), 0])
            at += len(x)
        first, last = bpe.spans(t)
        for p, q in zip(first.tolist(), last.tolist(), strict=True):
            held = [max(0, min(q + 1, a + n) - max(p, a)) for a, n, _ in own]
            j = {"first": next(i for i, h in enumerate(held) if h), "last": max(i for i, h in enumerate(held) if h), "most": held.index(max(held))}[rule]
            own[j][2] += 1
        assert [got[k][j] for j in range(len(own))] == [tuple(x) for x in own]


def test_field_counts_add_up(spark):
    rows = spark.createDataFrame([(1, "one two", None, "three"), (2, "", "é中", "x")], "doc_id long, a string, b string, c string")
    bpe = token_counts.ByteBpe()
    for r in token_counts.field_tokens(rows, ["a", "b", "c"]).collect():
        text = "one two\n\nthree" if r["doc_id"] == 1 else "\né中\nx"
        assert r["a"] + r["b"] + r["c"] == len(bpe.spans(text)[0])


def test_token_counts_empty_table(empty_docs):
    assert token_counts.section_tokens(empty_docs).count() == 0
