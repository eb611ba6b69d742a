"""One query for each operator, over its whole table, and SQL for those that SQL can express.

What a method adds can't be said in SQL, but what it starts from can: the
queries ``secret_counts``, ``personal_data_counts`` and ``unigram_scores`` are
columns of the fifth, seventh and ninth operator's own results beside SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, quality_knn, token_counts, toxicity
from .katz import katz_scores
from .ngram_join import near_duplicates
from .packing import pack_documents
from .pii import count, detect_pii
from .quality_rules import RULES, STOP_WORDS, quality_rules
from .secrets import digest, find_secrets
from .tables import documents

_BLANK = r"[ \t\n\x0b\f\r]"
_WORDS = rf"list_filter(string_split_regex(coalesce(text, ''), '{_BLANK}+'), lambda x: x <> '')"
#: A-Z to a-z and nothing else, as the contracts have it.
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LOW_WORDS = rf"list_filter(string_split_regex({_LOW}, '{_BLANK}+'), lambda x: x <> '')"


def _crc_sql(x: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce([xor(c, b)] || [x::UBIGINT FOR x IN range(8)], lambda v, i: xor(v >> 1, 3988292384::UBIGINT * (v & 1)))"
    return f"xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split({x}, ''), lambda y: ascii(y)::UBIGINT), lambda c, b: {bits}), 4294967295::UBIGINT)"


def _rules_sql() -> str:
    """The threshold table as a condition."""
    parts = []
    for r in RULES:
        value = f"({r.measure} / greatest({r.per}, 1))" if r.per else r.measure
        parts += [f"{value} >= {r.least!r}"] * (r.least is not None) + [f"{value} <= {r.most!r}"] * (r.most is not None)
    return " AND ".join(parts)


_STOPS = ", ".join(f"'{w}'" for w in sorted({x for w in STOP_WORDS for x in (w, w.capitalize())}))
_QUALITY_SQL = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS lines FROM documents),
w AS (SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS g FROM t, unnest(range(1, len(words) - 1)) AS u(i)),
d AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY doc_id),
m AS (SELECT t.doc_id, len(words) AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines) AS n_lines,
(len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(list_filter(words, lambda x: x IN ({_STOPS}))) AS n_stop_words FROM t LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_rules_sql()} AS kept FROM f"""
_NEAR_SQL = f"""WITH RECURSIVE t AS (SELECT doc_id, {_LOW_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], chr(10)) ELSE 'all' || array_to_string(w, chr(10)) END AS g FROM t, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS u(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id WHERE 5 * least(p.n, q.n) >= 4 * greatest(p.n, q.n) GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS root FROM n UNION SELECT l.y, r.root FROM r JOIN l ON r.x = l.x WHERE r.root < l.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(min(r.root), d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id, n.n"""
_SECRET_SQL = r"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM documents"""
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(length({_DIGITS})), lambda i: list_sum([y::INTEGER FOR y IN string_split((({_DIGITS})[length({_DIGITS}) - i]::INTEGER * (1 + i % 2))::VARCHAR, '')]))) % 10 = 0"
_PII_SQL = rf"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_bool_and([coalesce(try_cast(p AS BIGINT) <= 255, false) FOR p IN string_split(x, '.')]))) AS n_ip,
len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]([ -]?[0-9])+'), lambda x: length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN})) AS n_card,
len(list_filter(regexp_extract_all(coalesce(text, ''), '\+[0-9][ ().0-9-]+[0-9]'), lambda x: length({_DIGITS}) BETWEEN 9 AND 15)) AS n_phone FROM documents"""
_UNIGRAM_SQL = f"""WITH t AS (SELECT doc_id, {_crc_sql("doc_id::VARCHAR")} % 5 = 1 AS held_out, {_LOW_WORDS} || [chr(10)] AS w FROM documents), k AS (SELECT doc_id, held_out, unnest(w) AS w FROM t),
c AS (SELECT w, count(*) AS c FROM k WHERE NOT held_out GROUP BY w), n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n.n) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.5) / (n.n + 0.5 * (n.v + 1)))), 6) AS base_score FROM k LEFT JOIN c USING (w), n GROUP BY doc_id, held_out"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {"op10_quality_rules": _QUALITY_SQL, "op8_ngram_jaccard_join": _NEAR_SQL, "secret_counts": _SECRET_SQL, "personal_data_counts": _PII_SQL, "unigram_scores": _UNIGRAM_SQL}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _remainder(by: int, of: int) -> F.Column:
    """Whether crc32 of the id leaves that remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(by)) == of, F.lit(False))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules(documents(spark, sf_dir).select("doc_id", "text")).select(*columns)


def _digests(spans: DataFrame, kinds: tuple[str, ...], *more: F.Column) -> DataFrame:
    counts = [count(k).alias(f"n_{k}") for k in kinds]
    base = F.filter("spans", lambda s: s["kind"].isin(list(kinds)))
    return spans.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), *more)


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(find_secrets(documents(spark, sf_dir)), ("assign", "access", "hex"))


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_pii(documents(spark, sf_dir))
    return _digests(found, ("email", "ip", "card", "phone"), F.size("spans").cast("long").alias("n_spans"), *(count(f"lstm_{k}").alias(f"n_lstm_{k}") for k in ("email", "ip", "card", "phone")))


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    return pack_documents(documents(spark, sf_dir)).select(*columns)


@query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


@query
def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _remainder(5, 1)
    scores, total, _ = katz_scores(documents(spark, sf_dir), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", (F.col("score") / F.col("n_tokens")).alias("score_per_token"), ((F.col("score") - F.col("base_score")) / F.col("n_tokens")).alias("gain_per_token"))


@query
def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality_knn.fit(docs, quality_knn.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = _remainder(4, 2)
    return quality_knn.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    chain = toxicity.fit(docs, quality_knn.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = _remainder(4, 2)
    return toxicity.score(docs, chain).select("doc_id", held_out.alias("held_out"), *(F.col(n).alias(f"p_{n}") for n in toxicity.NAMES), (F.col("toxic") >= 0.5).cast("int").alias("predicted"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(documents(spark, sf_dir))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


@query
def personal_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


@query
def unigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_katz_backoff(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))
