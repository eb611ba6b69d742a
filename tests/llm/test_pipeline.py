import zlib

import pytest

import corpus_pipeline
from millrace.llm import decontam, ngram_join, quality_knn, secrets
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], SF).write.parquet(f"{at}/{k}")
        out.append(spark.read.parquet(f"{at}/{k}"))
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns_and_rows_only_leave(stages):
    for before, after in zip(stages[:4], stages[1:5], strict=True):
        assert after.columns == stages[0].columns and ids(after) <= ids(before)


def test_quality_keeps_good_labels(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i in labels if labels[i] == 1]
    assert sum(i in ids(stages[1]) for i in good) / len(good) > 0.9
    model = quality_knn.fit(stages[0], quality_knn.training_labels(spark.read.parquet(f"{SF}/labels.parquet")))
    scores = {r["doc_id"]: r["score"] for r in quality_knn.score(stages[0].select("doc_id", "text"), model).collect()}
    assert ids(stages[1]) == {i for i, s in scores.items() if s >= 0.7}


def test_one_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    assert ids(stages[2]) == {i for i, (_, c) in brute(rows).items() if c == i}


def test_contaminated_documents_leave(spark, stages):
    bad = ids(decontam.contaminated(stages[2], spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert ids(stages[3]) == ids(stages[2]) - bad


def test_the_benchmark_stage_depends_on_the_latent_space(spark, stages, monkeypatch):
    import numpy as np

    kept, all_ids = ids(stages[3]), ids(stages[1])
    bench = corpus_pipeline.remove_benchmark(spark, stages[1], SF)
    assert ids(bench) < all_ids and kept <= ids(bench)
    monkeypatch.setattr(decontam, "latent_space", lambda rows, terms: np.zeros((len(terms), 2), np.float32))
    assert ids(corpus_pipeline.remove_benchmark(spark, stages[1], SF)) == all_ids


def test_secrets_are_redacted(stages):
    before, after = ({r["doc_id"]: r for r in s.collect()} for s in stages[3:5])
    assert before.keys() == after.keys()
    spans = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.find_secrets(stages[3]).collect()}
    for i, r in after.items():
        want = secrets._without(before[i]["text"], spans[i], "[SECRET]") if spans[i] else before[i]["text"]
        assert r["text"] == want and r["n_chars"] == (len(want) if spans[i] else before[i]["n_chars"])


def test_every_token_is_packed(stages):
    import numpy as np

    from millrace.llm.packing import WordBpe, tokenizer_path

    tokenizer = WordBpe(tokenizer_path()).tokenizer
    rows = stages[5].collect()
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    assert {r["doc_id"] for r in rows} == texts.keys()
    for r in rows[:50]:
        ids = np.array(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [1], "<u4")[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"]


def test_run_is_all_stages(spark, stages):
    key = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[5])


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
    assert docs.count() == 0


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "source AS _text", "doc_id AS copy", "lang AS hit", "lang AS `a.b`", "doc_id AS id", "1 AS score")
    names, rows = docs.columns, docs.count()
    for _, f in corpus_pipeline.STAGES[:4]:
        docs = f(spark, docs, SF)
        assert docs.columns == names
    assert 0 < docs.where("_text = source AND hit = lang AND id = doc_id AND copy = doc_id AND score = 1").count() == docs.count() < rows


def test_texts_come_in_batches_of_bounded_bytes(spark):
    import pyarrow as pa

    docs = spark.range(0, 12000, 1, 1).selectExpr("id AS doc_id", "repeat('abcd ', 400) AS text", "'en' AS lang", "'s' AS source", "2000L AS n_chars")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    corpus_pipeline.redact_secrets(spark, docs, SF)
    assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) < 2 * corpus_pipeline.BATCH
    spark.conf.set(corpus_pipeline._BATCH, 1 << 20)
    corpus_pipeline.redact_secrets(spark, docs, SF)
    assert spark.conf.get(corpus_pipeline._BATCH) == str(1 << 20)
    spark.conf.unset(corpus_pipeline._BATCH)


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert ngram_join.WORDS == 5
