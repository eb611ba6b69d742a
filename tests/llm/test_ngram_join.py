import random
import re

import pytest

from millrace.llm import ngram_join
from millrace.llm.components import components

LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.fixture(scope="module")
def rows():
    """Exact and near copies in groups, chains of links, a passage that many share, borders of 0.8."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = " ".join(word() for _ in range(40))
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(rng.choice([1, 3, 12])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own))
    chain = [word() for _ in range(80)]
    for _ in range(8):
        chain = chain[2:] + [word(), word()]
        out.append(" ".join(chain))
    out += [passage + " " + " ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(40)]
    out += [None, "", "one", "One", "a b c d", "a b c d e", "a b c d e f"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("pivots, hot, most", [(0, 2000, 1 << 26), (2, 2000, 1 << 26), (2, 1, 1)])
def test_components_equal_brute_force(spark, rows, monkeypatch, pivots, hot, most):
    """With lists dealt as hot ones, texts found by a join and answers derived, too."""
    monkeypatch.setattr(ngram_join, "PIVOTS", pivots)
    monkeypatch.setattr(ngram_join, "DERIVE", 0 if hot == 1 else 10**6)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "BITMAP", most)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_keep_one(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in brute(rows).items() if c == i)


def test_odd_tables(odd_docs, empty_docs):
    got = ngram_join.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[9]["component_id"] == 8 and by[0]["n_shingles"] == 0 and by[0]["component_id"] == 0
    assert ngram_join.near_duplicates(empty_docs).count() == 0


def test_components_of_stars_chains_and_cycles(spark):
    links = [(k, k + 1) for k in range(100, 130)] + [(5, k) for k in range(6, 40)] + [(50, 51), (51, 52), (52, 50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 131)}, **{k: 5 for k in range(5, 40)}, **{k: 50 for k in (50, 51, 52)}}


def test_one_shingle_in_a_third_of_all_sets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 20)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    own = [(k, " ".join(["one two three four five", *(word() for _ in range(rng.choice([0, 0, 1, 2, 30])))]) if k % 3 == 0 else " ".join(word() for _ in range(12))) for k in range(360)]
    docs = spark.createDataFrame(own, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute(own)


def test_known_distances_rule_pairs_out(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "a long, b long")
    links = spark.createDataFrame([(1, 9, 0.05)], "a long, b long, apart double")
    compared = spark.createDataFrame([(2, 9, 0.4), (3, 9, 0.22), (1, 9, 0.04)], "a long, b long, apart double")
    assert sorted(tuple(r) for r in ngram_join._underived(pairs, links, compared).collect()) == [(1, 3), (2, 4)]


def test_components_of_random_links_take_few_tables(spark, monkeypatch):
    from millrace.llm import components as module

    tables, stored = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df, name: tables.append(name) or stored(df, name))
    rng = random.Random(3)
    for chunk, links, most in (
        (1_000_000, [(1, k) for k in range(2, 300)] + [(400, k) for k in range(401, 500)], 1),  # stars of their least nodes
        (1_000_000, [(k, 900) for k in range(300)], 3),  # of the largest
        (5, [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, 999) for k in range(500, 600)], 11),
        (3, [(k, k + 1) for k in range(1000, 1200)], 15),
    ):
        monkeypatch.setattr(module, "CHUNK", chunk)
        tables.clear()
        root: dict[int, int] = {}

        def find(x, root=root):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in links:
            if a != b:
                root[max(find(a), find(b))] = min(find(a), find(b))
        got = [tuple(r) for r in components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()]
        assert sorted(got) == sorted((x, find(x)) for x in list(root))
        assert len(tables) <= most, (len(tables), most)


def test_the_text_filter_is_read_in_one_job(spark):
    ids = spark.range(0, 100_000, 7, 5)
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("filter", "")
    words = ngram_join.bitmap(ids, "id", 1 << 20)
    jobs = seen.getJobIdsForGroup("filter")
    spark.sparkContext.setJobGroup("", "")
    h = [r[0] for r in ids.selectExpr("pmod(xxhash64(id), 1048576)").collect()]
    assert all(int(words[x >> 6]) >> (x & 63) & 1 for x in h)
    assert sum(int(w).bit_count() for w in words) == len(set(h)) and len(jobs) <= 2
