"""Forward-chaining rules over triples, as joins.

Facts are rows (session, s, p, o); each session is closed by itself, all at
once. An antecedent ``(s, p, o)`` matches facts, terms that begin with ``?``
being variables; rules are joins on the session and the variables that the
antecedents share, negated antecedents are anti-joins. Rules are ordered in
strata so that what a rule negates is complete before it runs; a program that
can't be ordered so is refused. Within a stratum rules run after those whose
facts they match, so most run once, in one pass with all others that are ready.
Only rules that feed themselves run in rounds: each joins a rule with the last
round's facts in one of its antecedents (semi-naive) and stores what is new; they
end when nothing is. A pass reads the facts whose predicates its rules name.

Objects are texts; numbers in filters and consequents are cast there. A fact
with a null in any column is left out. Repeated facts count once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rule_ops import compiled, truth
from ..storage import stored

Vars = dict[str, Column]
Term = str | Callable[[Vars], Column]
_FACT = ("session", "s", "p", "o")


@dataclass(frozen=True)
class Match:
    """An antecedent; ``negated`` ones bind no variables."""

    s: str
    p: str
    o: str
    negated: bool = False


@dataclass(frozen=True)
class Rule:
    name: str
    when: tuple[Match, ...]
    then: tuple[tuple[Term, str, Term], ...]
    where: Callable[[Vars], Column] | None = None
    salience: int = 100
    variables: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        bound = {t for m in self.when if not m.negated for t in (m.s, m.p, m.o) if t.startswith("?")}
        for m in self.when:
            if m.negated and any(t.startswith("?") and t not in bound for t in (m.s, m.o)):
                raise ValueError(f"{self.name}: a negated antecedent needs bound variables")
        for s, _, o in self.then:
            for t in (s, o):
                if isinstance(t, str) and t.startswith("?") and t not in bound:
                    raise ValueError(f"{self.name}: unbound variable {t}")
        object.__setattr__(self, "variables", tuple(sorted(bound)))


def from_config(rules: list[dict]) -> list[Rule]:
    """Rules from a configuration: ``{"name", "when": [[s, p, o], ["not", s, p, o]], "where": filter, "then": [[s, p, o]], "salience"}``.

    Terms that are lists, and the filter, are operators of ``rule_ops`` by
    name: ``[">", ["to_double", "?t"], 400000]``.
    """

    def term(t: object) -> Term:
        return t if isinstance(t, str) else (lambda at: compiled(t, at.__getitem__))

    out = []
    for r in rules:
        when = tuple(Match(*m[1:], negated=True) if m[0] == "not" and len(m) == 4 else Match(*m) for m in r["when"])
        where = (lambda at, node=r["where"]: truth(compiled(node, at.__getitem__))) if r.get("where") else None
        out.append(Rule(r["name"], when, tuple((term(s), p, term(o)) for s, p, o in r["then"]), where, r.get("salience", 100)))
    return out


def strata(rules: list[Rule]) -> list[list[Rule]]:
    """Rules in groups, each complete before the next; by salience within a group."""
    made = {p for r in rules for _, p, _ in r.then}
    level = dict.fromkeys(made, 0)
    for k in range(len(made) + 2):
        changed = False
        for r in rules:
            low = max([0, *(level[m.p] + m.negated for m in r.when if m.p in level)])
            for _, p, _ in r.then:
                if level[p] < low:
                    level[p], changed = low, True
        if not changed:
            break
    else:
        raise ValueError("negation in a cycle of rules")
    by: dict[int, list[Rule]] = {}
    for r in sorted(rules, key=lambda r: -r.salience):
        own = max([level[p] for _, p, _ in r.then] + [level[m.p] + m.negated for m in r.when if m.p in level])
        by.setdefault(own, []).append(r)
    return [by[k] for k in sorted(by)]


def passes(group: list[Rule]) -> list[tuple[list[Rule], bool]]:
    """The rules of a stratum in the order in which they can run, and whether they feed themselves."""
    if any(m.negated and m.p.startswith("?") for r in group for m in r.when):
        return [(group, True)]  # what such a rule negates has no place in the order
    feeds = lambda a, b: any(m.p.startswith("?") or m.p == p for m in b.when for _, p, _ in a.then)
    n = range(len(group))
    before = [{i for i in n if feeds(group[i], group[k])} for k in n]
    while True:  # all rules that feed a rule, by way of others too
        more = [own.union(*(before[i] for i in own)) for own in before]
        if more == before:
            break
        before = more
    out: list[tuple[list[Rule], bool]] = []
    done: set[int] = set()
    while len(done) < len(group):
        ready = [k for k in n if k not in done and before[k] <= done]
        again = not ready
        if again:
            k = min((k for k in n if k not in done), key=lambda k: len(before[k]))
            ready = sorted(before[k] - done)
        out.append(([group[k] for k in ready], again))
        done.update(ready)
    return out


def _matches(facts: DataFrame, m: Match) -> DataFrame:
    """The session and the variables of an antecedent; as facts don't repeat, nor do these."""
    out, columns = facts, {}
    for name, t in (("s", m.s), ("p", m.p), ("o", m.o)):
        if not t.startswith("?"):
            out = out.where(F.col(name) == t)
        elif t in columns:
            out = out.where(F.col(name) == columns[t])
        else:
            columns[t] = F.col(name)
    return out.select("session", *(c.alias(t) for t, c in columns.items()))


def _fire(rule: Rule, facts: DataFrame, fresh: DataFrame, place: int) -> DataFrame:
    """The consequents of a rule with antecedent ``place`` matched by fresh facts."""
    positive = [m for m in rule.when if not m.negated]
    order = [place, *(k for k in range(len(positive)) if k != place)]
    rows: DataFrame | None = None
    for k in order:
        own = _matches(fresh if k == place else facts, positive[k])
        rows = own if rows is None else rows.join(own, ["session", *(c for c in own.columns if c in rows.columns and c != "session")])
    for m in rule.when:
        if m.negated:
            own = _matches(facts, m)
            rows = rows.join(own, ["session", *(c for c in own.columns if c != "session")], "left_anti")
    at: Vars = {v: F.col(f"`{v}`") for v in rule.variables}
    if rule.where:
        rows = rows.where(rule.where(at))
    term = lambda t: (t(at) if callable(t) else at[t] if t.startswith("?") else F.lit(t)).cast("string")
    made = F.array(*(F.struct(term(s).alias("s"), F.lit(p).alias("p"), term(o).alias("o")) for s, p, o in rule.then))
    return rows.select("session", F.explode(made).alias("t")).select("session", "t.*")


def infer(facts: DataFrame, rules: list[Rule], most_rounds: int = 10_000) -> DataFrame:
    """All facts of each session, asserted and inferred."""
    full = lambda df: df.select(*(F.col(c).cast("string") for c in _FACT)).dropna().distinct()
    parts = [stored(full(facts), "facts")]

    def known() -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    for group, again in (p for s in strata(rules) for p in passes(s)):
        group = [r for r in group if any(not m.negated for m in r.when)]
        if not group:
            continue
        heads = sorted({p for r in group for _, p, _ in r.then})
        fresh: DataFrame | None = None
        for _ in range(most_rounds):
            everything, made = known(), None
            for r in group:
                positive = [m for m in r.when if not m.negated]
                for place in [0] if fresh is None else [k for k, m in enumerate(positive) if m.p.startswith("?") or m.p in heads]:
                    own = _fire(r, everything, everything if fresh is None else fresh, place)
                    made = own if made is None else made.union(own)
            if made is None:
                break
            fresh = stored(full(made).join(everything.where(F.col("p").isin(heads)), list(_FACT), "left_anti"), "inferred")
            if again and fresh.isEmpty():
                break
            parts.append(fresh)
            if not again:
                break
        else:
            raise RuntimeError(f"rules still fire after {most_rounds} rounds")
    return known()


def _fact_of(name: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(name).alias("p"), v.cast("string").alias("o"))


def assert_records(df: DataFrame, session: str, key: str, class_name: str) -> DataFrame:
    """Facts of records: their class, and a fact for each non-null column; arrays give a fact for each value."""
    parts = [F.array(F.struct(F.lit("rdf:type").alias("p"), F.lit(class_name).alias("o")))]
    for f in df.schema:
        if f.name == session:
            continue
        c = F.col(f"`{f.name}`")
        values = F.coalesce(c, F.array().cast(f.dataType)) if f.dataType.typeName() == "array" else F.array(c)
        parts.append(F.transform(values, _fact_of(f.name)))
    return df.select(F.col(session).cast("string").alias("session"), F.col(key).cast("string").alias("s"), F.explode(F.concat(*parts)).alias("t")).select("session", "s", "t.*").where("o IS NOT NULL")


def extract_entities(facts: DataFrame, class_name: str, properties: list[str], many: tuple[str, ...] = ()) -> DataFrame:
    """One row for each entity of a class; properties in ``many`` are sorted arrays, others their least value."""
    value = lambda p: F.when(F.col("p") == p, F.col("o"))
    aggs = [(F.array_sort(F.collect_set(value(p))) if p in many else F.min(value(p))).alias(p) for p in properties]
    member, own = "_member", facts.where(F.col("p").isin("rdf:type", *properties))
    while member in (*properties, "session", "s"):
        member += "_"
    of_class = (F.col("p") == "rdf:type") & (F.col("o") == class_name)
    return own.groupBy("session", "s").agg(F.max(of_class).alias(member), *aggs).where(F.col(member)).drop(member)
