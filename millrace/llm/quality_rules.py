"""Quality rules: a table of thresholds compiled into one projection.

Words are runs of characters other than space and 0x09-0x0D. Every measure is
a column expression, so the whole operator is one narrow stage without a
shuffle; a long text costs time in proportion to its words (one sort of longs).

Null or empty texts have no words: all measures are 0, ``base_failed`` is true
and ``kept`` false. Each row is judged on its own, so repeated rows and ties
get equal results; an empty table gives an empty result. Further columns pass
through untouched. A measure takes the place of a column of its name, unless a
``prefix`` is given for the measures' names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and a in to is was for that with as on are this by at from or an be it not "
    "le la les de des du un une et est en que qui dans pour pas sur par au avec ou "
    "der die das den dem und ein eine ist von mit zu im für auf nicht "
    "el los las del y es una por con para se su al lo como o"
).split()

_BLANK = r"[ \t-\r]"


@dataclass(frozen=True)
class Rule:
    """A text fails when ``measure / per`` is outside ``[least, most]``."""

    measure: str
    per: str | None = None
    least: float | None = None
    most: float | None = None


#: The default table. Applied to texts that pass the base rule (50 words or more).
RULES = (
    Rule("word_chars", "n_words", least=2.0, most=14.0),
    Rule("n_symbols", "n_words", most=0.25),
    Rule("n_stop_words", "n_words", least=0.03),
    Rule("n_dup_lines", "n_lines", most=0.7),
    Rule("n_repeat_words", "n_words", most=0.4),
)


def passes(rules: tuple[Rule, ...], prefix: str = "") -> Column:
    """The table as one boolean expression over the measures."""
    ok = F.lit(True)
    for r in rules:
        value = F.col(prefix + r.measure).cast("double")
        if r.per:
            value = value / F.greatest(F.col(prefix + r.per), F.lit(1))
        if r.least is not None:
            ok = ok & (value >= F.lit(float(r.least)))
        if r.most is not None:
            ok = ok & (value <= F.lit(float(r.most)))
    return ok


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


def measures(docs: DataFrame, text: str = "text", stop_words: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_stop_words."""
    stops = sorted({x for w in (stop_words or STOP_WORDS) for x in (w, w.capitalize())})
    keep = [c for c in docs.columns if c not in {prefix + m for m in (*MEASURES, "base_failed", "kept")}]
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))  # no name within can clash
    t = F.col("_t")
    step = docs.select("*", F.filter(F.split(t, f"{_BLANK}+"), lambda w: w != "").alias("_words"), F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "").alias("_lines"))
    step = step.select("*", F.size("_words").cast("long").alias("n_words"))
    words = F.col("_words")
    step = step.select("*", F.length(F.bin("n_words")).alias("_bits"), F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int").alias("_n"))
    # A text without two equal hashes of 3-word windows has no repeat. In others each
    # window becomes one long, its hash above its position, so that a single sort
    # of longs brings equal windows together.
    step = step.select("*", F.transform(F.slice(words, F.lit(1), F.col("_n")), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))).alias("_hashes"))
    window = F.transform("_hashes", lambda h, i: F.call_function("shiftleft", h, F.col("_bits")).bitwiseOR(i.cast("long")))
    step = step.select(
        "*",
        F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(window)).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.size(F.split(t, r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(words, lambda w: w.isin(stops))).cast("long").alias("n_stop_words"),
    )
    # Places in the sorted array whose successor has the same hash, then those whose words are equal too.
    step = step.select("*", F.expr("filter(sequence(0, greatest(size(_windows) - 2, 0)), i -> shiftrightunsigned(get(_windows, i), _bits) = shiftrightunsigned(get(_windows, i + 1), _bits))").alias("_at"), F.expr("shiftleft(1L, _bits) - 1").alias("_mask"))
    here, there = "cast(get(_windows, i) & _mask as int)", "cast(get(_windows, i + 1) & _mask as int)"
    equal = " AND ".join(f"get(_words, {here} + {k}) = get(_words, {there} + {k})" for k in range(3))
    step = step.select("*", F.expr(f"filter(_at, i -> {equal})").alias("_same"))
    step = step.select("*", F.expr(f"sort_array(array_union(transform(_same, i -> {here}), transform(_same, i -> {there})))").alias("_starts"))
    # a window covers 3 words; from one start to the next at most the gap
    covered = F.expr("coalesce(aggregate(transform(_starts, (p, i) -> cast(least(3, coalesce(get(_starts, i + 1) - p, 3)) as bigint)), 0L, (s, x) -> s + x), 0L)")
    # plus 0, as a value that the optimiser can't copy: else a condition on a measure would bring all of its steps along, many times over
    zero = F.shiftrightunsigned(F.monotonically_increasing_id(), 63)
    step = step.select("_row", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", (covered + zero).alias("n_repeat_words"), "n_stop_words")
    return step.select("_row.*", *(F.col(m).alias(prefix + m) for m in MEASURES))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", least_words: int = 50, most_repeat_percent: int = 50, prefix: str = "") -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept``."""
    words, repeat = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    failed = (words < least_words) | (100 * repeat > most_repeat_percent * words)
    return measures(docs, text, prefix=prefix).select("*", failed.alias(f"{prefix}base_failed"), (~failed & passes(rules, prefix)).alias(f"{prefix}kept"))
