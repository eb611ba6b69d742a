"""Pipelines: steps of pipes between named channels, from a configuration to lazy DataFrames.

    {"steps": [{"when": node?, "env": {...}?, "pipes": [
        {"type": "fan_out" | "splitter", "input": "channel", "splitter": {...}?, "apply": [
            {"type": operator, "output": "channel", "when": node?, "conditional_config": [{"when", "then"}]?, ...}]},
        {"type": "merge_files", "input": "channel", "path": ..., "format": ..., "output": "channel"?}]}],
     "channels": {"name": {"type": "generator" | "stage" | "csv" | "fixed_width" | "sql", ...}}}

Channels are entries of a dictionary; several applications may write to one,
whose rows are then united by name. Conditions on steps and applications see
the environment only and are decided while building the plan. Nothing runs
until a channel is written, but for writers (``partition_writer``,
``merge_files``, ``report``): they write when the plan is built, each in its
turn, and their output channel reads what they wrote. Under a splitter every
operator works within each key, and keeps it; those that can't are refused.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, DoubleType, IntegerType, LongType, DateType, StringType, StructType, TimestampNTZType

from ..operators import anonymize, clustering, profile, rules, transforms
from ..sources import readers, writers
from . import queries as structured
from .env import constant, substitute
from .evaluators import hashed

Apply = Callable[[DataFrame, dict[str, Any], dict[str, DataFrame], dict[str, Any], list[str]], DataFrame | dict[str, DataFrame]]


def env_truth(node: dict[str, Any] | None, env: dict[str, Any]) -> bool:
    """A condition over constants and ``$NAMES``, decided now."""
    if not node:
        return True
    if "value" in node:
        v = constant(node["value"], env)
        return v == "TRUE" if isinstance(v, str) else bool(v)
    if "select" in node:
        return bool(env.get(node["select"].lstrip("$")))
    op = node["op"]
    if op == "NOT":
        return not env_truth(node["arg"], env)
    if op in ("AND", "OR"):
        a, b = (env_truth(node[k], env) for k in ("lhs", "rhs"))
        return a and b if op == "AND" else a or b
    a, b = (constant(n["value"], env) if "value" in n else env.get(n["select"].lstrip("$")) for n in (node["lhs"], node["rhs"]))
    if a is None or b is None:
        return False
    return {"==": a == b, "!=": a != b}[op] if op in ("==", "!=") else {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _map_record(df: DataFrame, c: dict, channels: dict, env: dict, keys: list[str]) -> DataFrame:
    return transforms.map_record(df, c["columns"], env, c.get("new_record", True), c.get("errors"), channels, keys, c.get("class_name"), c.get("row_key"), c.get("fail_on_error", False))


def _map_reduce(df: DataFrame, c: dict, channels: dict, env: dict, keys: list[str]) -> DataFrame:
    return transforms.map_reduce(df, c["map_on"], c["apply_map"], c["apply_reduce"], keys, env, c.get("order"), c.get("alternate_map_on"))


def _analyze(df: DataFrame, c: dict, channels: dict, env: dict, keys: list[str]) -> DataFrame:
    lookups = {name: channels[table] for name, table in c.get("lookups", {}).items()}
    more = {k: c[k] for k in ("regex", "keywords", "scrub", "distinct_below", "hit_ratio") if k in c} | {k: tuple(c[k]) for k in ("blanks", "date_formats") if k in c}
    return profile.analyze(df, profile.Profile(lookups=lookups, entity_hints=tuple(map(tuple, c.get("entity_hints", []))), name_tokens=tuple(map(tuple, c.get("name_tokens", []))), **more), keys)


def _anonymize(df: DataFrame, c: dict, channels: dict, env: dict, keys: list[str]) -> dict[str, DataFrame]:
    if "metadata" in c:
        metadata = [{k: v for k, v in r.asDict().items() if v is not None} for r in channels[c["metadata"]].collect()]
        actions = anonymize.actions_from_metadata(df.columns, metadata, set(c.get("texts", [])), c.get("dates", {}), {k: channels[t] for k, t in c.get("deid_lookups", {}).items()}, c.get("deid_functions"), c.get("mode") == "de-identification", cap_years=c.get("cap_dob_years"), default_date=c.get("default_date"))
    else:
        actions = [anonymize.Action(**{k: channels[v] if k == "table" else v for k, v in a.items()}) for a in c["actions"]]
    out, crosswalk = anonymize.anonymize(df, actions, tuple(c.get("blanks", ())))
    return {"output": out, "keys_output": crosswalk}


def _rules(df: DataFrame, c: dict, channels: dict, env: dict, keys: list[str]) -> dict[str, DataFrame]:
    facts = rules.assert_records(df, c["session"], c["key"], c["class_name"])
    if c.get("static_facts"):
        facts = facts.unionByName(channels[c["static_facts"]].select("session", "s", "p", "o"))
    closed = rules.infer(facts, rules.from_config(c["rules"]), c.get("max_rounds", 10_000))
    made = {f"extract_{k}": rules.extract_entities(closed, x["class_name"], x["properties"], tuple(x.get("many", ()))) for k, x in enumerate(c.get("extract", []))}
    return {"output": made.pop("extract_0") if made else closed, **made, "facts_output": closed}


def _partition_writer(df: DataFrame, c: dict, channels: dict, env: dict, keys: list[str]) -> DataFrame:
    if c.get("sampling_rate") or c.get("sampling_max_count"):
        df = transforms.sample_rows(df, c["order"], c.get("sampling_rate"), c.get("sampling_max_count"))
    if c.get("columns"):
        df = transforms.map_record(df, c["columns"], env, tables=channels, keep=[*keys, *c.get("keys", [])])
    own, kind = [*keys, *c.get("keys", [])], c.get("format", "parquet")
    if kind == "fixed_width":
        writers.write_fixed_width(df, c["path"], c["widths"])
        return readers.read_fixed_width(df.sparkSession, c["path"], readers.fields_of(c["widths"]))
    writers.write_partitions(df, c["path"], own, kind, c.get("partition_size", 0), **c.get("options", {}))
    reader = df.sparkSession.read.options(**{k: str(v) for k, v in c.get("options", {}).items()})
    return reader.schema(df.schema).format(kind).load(c["path"]).select(*(F.col(f"`{n}`") for n in df.columns))


def _lookback(df: DataFrame, c: dict, channels: dict, env: dict, keys: list[str]) -> DataFrame:
    """``period`` is a number, or ``offset:n`` for so many before ``$PERIOD_ID``."""
    period = str(c["period"])
    period = int(env["PERIOD_ID"]) - int(period[7:]) if period.startswith("offset:") else int(period)
    return transforms.lookback(df, c["period_column"], period, int(c["periods"]))


OPERATORS: dict[str, Apply] = {
    "map_record": _map_record,
    "filter": lambda df, c, ch, env, keys: transforms.filter_rows(df, c.get("filter"), env, c.get("max_output_records"), c.get("columns"), keys),
    "aggregate": lambda df, c, ch, env, keys: transforms.aggregate_rows(df, c["columns"], keys, env, c.get("order")),
    "map_reduce": _map_reduce,
    "distinct": lambda df, c, ch, env, keys: transforms.distinct_on(df, [*keys, *c["distinct_on"]], c.get("order")),
    "sort": lambda df, c, ch, env, keys: transforms.sort_rows(df, c["sort_by"], c.get("max_output_records"), keys),
    "group_by": lambda df, c, ch, env, keys: transforms.group_by(df, c["order"], [*(keys if not c.get("consecutive") else []), *c["group_by"]] if c.get("group_by") else None, c.get("count"), c.get("name", "rows"), c.get("consecutive", False), keys or None),
    "merge": lambda df, c, ch, env, keys: transforms.merge(df, [ch[s] for s in c["sources"]], c["keys"], c["order"]),
    "lookup": lambda df, c, ch, env, keys: transforms.lookup(df, ch[c["table"]], c["keys"], c["table_keys"], c["values"], c.get("order")),
    "high_freq": lambda df, c, ch, env, keys: transforms.high_freq(df, c["columns"], c.get("top_pct", 100), c.get("key_regex"), keys),
    "shuffling": lambda df, c, ch, env, keys: transforms.shuffling(df, c["max_input_sample_size"], c["output_sample_size"], c.get("seed"), c.get("keep")),
    "analyze": _analyze,
    "clustering": lambda df, c, ch, env, keys: clustering.clustering(df, c["classification"], set(c["determining"]), set(c["transitive"]), tuple(c.get("tags", ())), tuple(c.get("solo", ())), c.get("least2", 0), c.get("least1", 0)),
    "anonymize": _anonymize,
    "rules": _rules,
    "partition_writer": _partition_writer,
    "lookback": _lookback,
    "sampling": lambda df, c, ch, env, keys: transforms.sample_rows(df, c["order"], c.get("sampling_rate"), c.get("sampling_max_count")),
}
#: Operators over a whole table, which a splitter can't cut.
WHOLE = ("merge", "shuffling", "clustering", "rules", "lookback", "sampling")
#: Fields of an application that name channels it writes.
OUTPUTS = ("output", "keys_output", "facts_output", *(f"extract_{k}" for k in range(1, 10)))


def open_channel(spark: SparkSession, spec: dict[str, Any], env: dict[str, Any]) -> DataFrame:
    """A source that a configuration names: generated rows, files, a stage's Parquet, or a statement."""
    c = substitute(spec, env)
    kind = c["type"]
    if kind == "generator":
        return readers.generate(spark, int(c["rows"]), c["columns"])
    if kind == "csv":
        df = readers.read_csv(spark, c["path"], c.get("header", True), c.get("columns"), c.get("delimiter"), c.get("encoding"))[0]
        return readers.several_columns(df) if c.get("several_columns") else df
    if kind == "fixed_width":
        return readers.read_fixed_width(spark, c["path"], [readers.Field(**f) for f in c["layout"]], tuple(c["type_at"]) if c.get("type_at") else None)
    if kind in ("stage", "parquet"):
        return readers.read_parquet(spark, c["path"], c.get("select"))
    if kind == "sql":
        return structured.run_report(spark, spec["statement"], env)
    raise ValueError(f"unknown channel type: {kind}")


def conditioned(a: dict[str, Any], env: dict[str, Any]) -> dict[str, Any]:
    """An application after its ``conditional_config``: each ``then`` whose ``when`` holds replaces it, if it has a type, else its fields that aren't empty."""
    own = dict(a)
    for c in own.pop("conditional_config", None) or []:
        if env_truth(c["when"], env):
            then = {k: v for k, v in c["then"].items() if v not in (None, "", [], {})}
            own = dict(then) if then.get("type") else own | then
    return own


def validate(config: dict[str, Any], env: dict[str, Any] | None = None) -> None:
    """Raises on unknown pipes and operators, operators that a splitter can't cut, and channels read before they are written."""
    known = {*config.get("sources", []), *config.get("channels", {})}
    for step in config["steps"]:
        for pipe in step["pipes"]:
            if pipe["type"] not in ("fan_out", "splitter", "merge_files"):
                raise ValueError(f"unknown pipe: {pipe['type']}")
            if pipe["input"] not in known and "sources" in config:
                raise ValueError(f"channel is read before it is written: {pipe['input']}")
            if pipe["type"] == "merge_files":
                known.add(pipe.get("output"))
                continue
            s = pipe.get("splitter", {})
            if pipe["type"] == "splitter" and not any(s.get(k) for k in ("column", "shard_on", "default")):
                raise ValueError("a splitter needs one of column, shard_on and default")
            for a in pipe["apply"]:
                a = conditioned(a, env or {})
                if a["type"] not in OPERATORS:
                    raise ValueError(f"unknown operator: {a['type']}")
                if pipe["type"] == "splitter" and a["type"] in WHOLE:
                    raise ValueError(f"{a['type']} can't work within the keys of a splitter")
                if not a.get("output"):
                    raise ValueError(f"{a['type']} has no output")
                known |= {a[k] for k in OUTPUTS if a.get(k)}


def _split(df: DataFrame, s: dict[str, Any]) -> DataFrame:
    """By column, else by hash, else one default key."""
    shard = hashed(s["shard_on"], df.schema) if s.get("shard_on") and not s.get("column") else None
    return transforms.splitter(df, s.get("column"), s.get("default"), shard, s.get("rows_each"), s.get("order"))


def build(spark: SparkSession, config: dict[str, Any], sources: dict[str, DataFrame], env: dict[str, Any] | None = None) -> dict[str, DataFrame]:
    """All channels of the pipeline, lazily but for its writers."""
    env = dict(env or {})
    validate(config, env)
    channels = dict(sources) | {name: open_channel(spark, c, env) for name, c in config.get("channels", {}).items() if name not in sources}
    for step in config["steps"]:
        if not env_truth(step.get("when"), env):
            continue
        env |= substitute(step.get("env", {}), env)
        fresh: set[str] = set()
        for pipe in step["pipes"]:
            df, keys = channels[pipe["input"]], []
            if pipe["type"] == "merge_files":
                own = substitute({k: v for k, v in pipe.items() if k != "input"}, env)
                writers.merge_files(df, own["path"], own.get("format", "csv"), own.get("header", True), own.get("headers"), **own.get("options", {}))
                if own.get("output"):
                    channels[own["output"]] = df
                continue
            if pipe["type"] == "splitter":
                df, keys = _split(df, pipe["splitter"]), ["split_key"]
            for a in pipe["apply"]:
                a = conditioned(a, env)
                if not env_truth(a.get("when"), env):
                    continue
                a = substitute({k: v for k, v in a.items() if k != "when"}, env)
                made = OPERATORS[a["type"]](df, a, channels, env, keys)
                for field, out in (made if isinstance(made, dict) else {"output": made}).items():
                    name = a.get(field)
                    if name:
                        channels[name] = channels[name].unionByName(out, allowMissingColumns=True) if name in fresh else out
                        fresh.add(name)
    return channels


def schema_of_class(classes: dict[str, dict[str, Any]], name: str, seen: tuple[str, ...] = ()) -> StructType:
    """The columns of a class and of all its ancestors, ancestors first, each once."""
    if name in seen:
        raise ValueError(f"class is its own ancestor: {name}")
    types: dict[str, DataType] = {"text": StringType(), "resource": StringType(), "date": DateType(), "datetime": TimestampNTZType(), "double": DoubleType(), "int": LongType(), "long": LongType(), "uint": LongType(), "ulong": DecimalType(20, 0), "bool": IntegerType()}
    out = StructType()
    for base in classes[name].get("base_classes", []):
        for f in schema_of_class(classes, base, (*seen, name)) if base in classes else []:
            if f.name not in out.names:
                out = out.add(f)
    for column, kind in classes[name].get("properties", {}).items():
        array = kind.startswith("array of ")
        t = types[kind.removeprefix("array of ")]
        if column not in out.names:
            out = out.add(column, ArrayType(t) if array else t)
    return out
