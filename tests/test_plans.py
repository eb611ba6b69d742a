import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from millrace.operators import anonymize, clustering, profile, rules, transforms
from millrace.plans import pipeline, queries
from millrace.plans.env import constant, substitute
from millrace.plans.expressions import compile_expression, predicate
from millrace.sources import readers, writers
from millrace.streaming import runner


def test_constants_and_environment():
    assert [constant(x) for x in ("NULL", "'a'", "1.5", "7")] == [None, "a", 1.5, 7] and math.isnan(constant("NaN"))
    assert substitute({"a": ["$X", "${Y}z"]}, {"X": "$Y", "Y": 3}) == {"a": ["3", "3z"]}


ROW = "a int, b double, s string, t string, d date, z int, flag boolean"
NODES = [
    ({"op": "==", "lhs": {"select": "a"}, "rhs": {"value": "5"}}, 1), ({"op": "==", "lhs": {"select": "s"}, "rhs": {"value": "12"}}, 1), ({"op": "!=", "lhs": {"select": "z"}, "rhs": {"value": "5"}}, 0),
    ({"op": "AND", "lhs": {"select": "a"}, "rhs": {"select": "z"}}, 0), ({"op": "OR", "lhs": {"select": "z"}, "rhs": {"select": "a"}}, 0), ({"op": "NOT", "arg": {"select": "z"}}, 0), ({"op": "IS", "lhs": {"select": "z"}, "rhs": {"value": "NULL"}}, 1),
    ({"op": "IS NOT", "lhs": {"select": "a"}, "rhs": {"value": "NULL"}}, 1), ({"op": "ABS", "arg": {"select": "z"}}, 0), ({"op": "LENGTH", "arg": {"select": "t"}}, 3), ({"op": "+", "lhs": {"select": "t"}, "rhs": {"select": "s"}}, "éx12"),
    ({"op": "+", "lhs": {"select": "a"}, "rhs": {"select": "t"}, "default": {"value": "-1"}}, -1.0), ({"op": "+", "lhs": {"select": "a"}, "rhs": {"select": "z"}, "default": {"value": "-1"}}, None), ({"op": "-", "lhs": {"select": "d"}, "rhs": {"value": "1"}}, date(2024, 2, 29)),
    ({"op": "IN_NO_CASE", "lhs": {"select": "t"}, "rhs": {"static_list": ["'ÉX'"]}}, 1), ({"op": "*", "lhs": {"select": "a"}, "rhs": {"select": "b"}}, 12.5), ({"op": "TO_DATE", "arg": {"value": "'03/01/2024'"}}, date(2024, 3, 1)), ({"select": "flag"}, 1), ({"select": "gone", "default": {"value": "9"}}, 9),
    ({"select": "s", "as_rdf_type": "int"}, 12), ({"op": "<", "lhs": {"select": "b"}, "rhs": {"select": "a"}}, 1), ({"op": ">=", "lhs": {"select": "z"}, "rhs": {"select": "a"}}, 0),
]


def test_expressions(spark):
    df = spark.createDataFrame([(5, 2.5, "12", "éx", date(2024, 3, 1), None, True)], ROW)
    got = df.select(*(compile_expression(n, df.schema).col.alias(f"c{k}") for k, (n, _) in enumerate(NODES))).first()
    assert list(got) == [want for _, want in NODES]
    nan = {"op": "/", "lhs": {"select": "a"}, "rhs": {"value": "0"}}
    assert math.isnan(df.select(compile_expression(nan, df.schema).col).first()[0])
    for bad in ({"op": "??", "arg": {"value": "1"}}, {"select": "gone"}, {"op": "IN", "lhs": {"select": "a"}, "rhs": {"value": "1"}}):
        with pytest.raises(ValueError):
            compile_expression(bad, df.schema)


def test_filters_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    node = {"op": "AND", "lhs": {"op": "<", "lhs": {"select": "l_quantity"}, "rhs": {"value": "24"}}, "rhs": {"op": "==", "lhs": {"select": "l_returnflag"}, "rhs": {"value": "'R'"}}}
    plan = df.where(predicate(node, df.schema)).select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_quantity" in plan and "EqualTo(l_returnflag,R)" in plan and "l_comment" not in plan


def test_group_by_and_merge(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(["5", "5", "5", "1", "1"])], "seq int, key string")
    assert sorted(len(r["rows"]) for r in transforms.group_by(df, "seq", ["key"]).collect()) == [2, 3]
    runs = spark.createDataFrame([(0, None), (1, None), (2, "a"), (3, "b"), (4, "a")], "seq int, key string")
    assert sorted(len(r["rows"]) for r in transforms.group_by(runs, "seq", ["key"], consecutive=True).collect()) == [1, 1, 1, 2]
    other = spark.createDataFrame([(k, v) for k, v in enumerate(["0", "1", "1", "5", "5", "5"])], "seq int, key string")
    assert sorted(len(r["rows"]) for r in transforms.merge(df, [other], ["key"], "seq").collect()) == [4, 6]


def test_lookup_last_of_equal_keys_wins(spark):
    table = spark.createDataFrame([(0, "k", "x"), (1, "k", "y"), (2, None, "z")], "seq int, key string, v string")
    df = spark.createDataFrame([("k",), ("m",), (None,)], "key string")
    assert [r["got"] for r in transforms.lookup(df, table, ["key"], ["key"], {"v": "got"}, "seq").orderBy("key").collect()] == [None, "y", None]


def test_map_reduce_counts_keys_with_several_rows(spark):
    df = spark.createDataFrame([(k,) for k in (1, 2, 3, 3, 4, 4, None, None)], "key int")
    many = {"op": ">", "lhs": {"select": "n"}, "rhs": {"value": "1"}}
    out = transforms.map_reduce(df, "key", [{"name": "n", "type": "count", "expr": "*"}], [{"name": "many", "type": "count", "expr": "*", "where": many}])
    assert out.first()["many"] == 2


def test_aggregate_of_nothing(spark):
    df = spark.createDataFrame([], "x int")
    r = transforms.aggregate_rows(df, [{"name": "n", "type": "count", "expr": "*"}, {"name": "d", "type": "distinct_count", "expr": "x"}]).first()
    assert (r["n"], r["d"]) == (None, 0)


def test_errors_go_to_their_own_rows(spark):
    df = spark.createDataFrame([("12",), ("2125550100",)], "phone string")
    spec = {"name": "p", "type": "map", "expr": "phone", "map_expr": {"cleansing_function": "format_phone", "default": "'none'"}}
    good, bad = transforms.split_errors(transforms.map_record(df, [spec], errors="_e"), "_e")
    assert sorted(r["p"] for r in good.collect()) == ["+12125550100", "none"] and [r["column_in_error"] for r in bad.collect()] == ["p"]


def test_pipeline_steps_and_conditions(spark):
    df = spark.createDataFrame([(k, k % 2) for k in range(10)], "x int, y int")
    when = lambda v: {"op": "==", "lhs": {"select": "$MODE"}, "rhs": {"value": f"'{v}'"}}
    apply = lambda n, v: {"type": "filter", "filter": {"op": "<", "lhs": {"select": "x"}, "rhs": {"value": n}}, "output": "out", "when": when(v)}
    config = {"sources": ["in"], "steps": [{"pipes": [{"type": "fan_out", "input": "in", "apply": [apply("$N", "a"), apply("2", "a"), apply("9", "b")]}]}, {"when": when("b"), "pipes": [{"type": "fan_out", "input": "out", "apply": [{"type": "sort", "sort_by": ["x"], "output": "sorted"}]}]}]}
    out = pipeline.build(spark, config, {"in": df}, {"MODE": "a", "N": "3"})
    assert out["out"].count() == 5 and "sorted" not in out
    for bad in ({"type": "loop", "input": "in", "apply": []}, {"type": "fan_out", "input": "later", "apply": []}, {"type": "fan_out", "input": "in", "apply": [{"type": "nothing", "output": "o"}]}):
        with pytest.raises(ValueError):
            pipeline.validate({"sources": ["in"], "steps": [{"pipes": [bad]}]})


def test_classes_inherit_columns():
    classes = {"Base": {"properties": {"key": "text", "tags": "array of text"}}, "Claim": {"base_classes": ["Base"], "properties": {"amount": "double", "key": "text"}}}
    assert [(f.name, f.dataType.simpleString()) for f in pipeline.schema_of_class(classes, "Claim")] == [("key", "string"), ("tags", "array<string>"), ("amount", "double")]
    with pytest.raises(ValueError):
        pipeline.schema_of_class({"A": {"base_classes": ["A"]}}, "A")


def test_profile_of_odd_values(spark):
    df = spark.createDataFrame([("xxxx", None), ("1930", "NULL"), ("1970", ""), ("2025", "2024-01-02"), ("2030", "2024-03-04"), ("ffff", "none")], "n string, d string")
    got = {r["column_name"]: r for r in profile.analyze(df).collect()}
    assert got["n"]["double_pct"] == pytest.approx(400 / 6) and got["n"]["minmax_type"] == "text"
    assert got["d"]["null_count"] == 4 and (got["d"]["minmax_type"], got["d"]["min_value"], got["d"]["max_value"], got["d"]["distinct_values"]) == ("date", "2024-01-02", "2024-03-04", "2024-01-02,2024-03-04")


def test_anonymize(spark):
    df = spark.createDataFrame([("Ann", "05/17/1931"), ("NULL", "bad"), (None, None)], "name string, dob string")
    names = spark.createDataFrame([("P",), ("Q",)], "v string")
    out, crosswalk = anonymize.anonymize(df, [anonymize.Action("name", "lookup", table=names, table_column="v"), anonymize.Action("dob", "dob", date_format="MM/dd/yyyy")])
    rows = out.collect()
    assert rows[0]["name"] in ("P", "Q") and [r["name"] for r in rows[1:]] == [None, None] and [r["dob"] for r in rows] == ["01/01/1931", "bad", None]
    assert crosswalk.count() == 3


def test_clusters():
    edges = [("a", "b", 1, 100), ("c", "d", 2, 100), ("a", "c", 50, 100), ("b", "e", 60, 100)]
    own = {frozenset(m) for m in clustering.merge_edges(edges, {"a", "c"})}
    assert own == {frozenset("abcde")}
    # clusters that were emptied by a merge don't lend their place to later ones
    own = [set(m) for m in clustering.merge_edges([("a", "b", 1, 100), ("c", "d", 2, 100), ("c", "a", 3, 100), ("e", "f", 4, 100)], {"a", "c"})]
    assert sorted(map(sorted, own)) == [["a", "b", "c", "d"], ["e", "f"]]


@pytest.mark.parametrize("tagged, merged", [({"a", "c"}, True), (set(), True), ({"a"}, False), ({"a", "x"}, False)])
def test_a_merge_leaves_a_cluster_without_tags(tagged, merged):
    """Ten edges before it, so that the first tenth's rule doesn't hold for the last."""
    edges = [("a", f"a{k}", 1, 100) for k in range(5)] + [("c", f"c{k}", 1, 100) for k in range(6)] + [("a", "c", 50, 100)]
    own = clustering.merge_edges(edges, {"a", "c"}, tagged)
    assert (len(own) == 1) == merged
    spare = clustering.merge_edges([*edges[:-1], ("p", "q", 2, 100), edges[-1]], {"a", "c"}, tagged)
    assert any({"a", "c"} <= set(m) for m in spare)


def test_rules_chain_negate_and_recur(spark):
    facts = spark.createDataFrame([("1", "x", "parent", "y"), ("1", "y", "parent", "z"), ("2", "x", "parent", "q"), ("1", "x", "rdf:type", "P"), ("1", "z", "rdf:type", "P"), (None, "a", "b", "c")], "session string, s string, p string, o string")
    m = rules.Match
    program = [
        rules.Rule("base", (m("?a", "parent", "?b"),), (("?a", "above", "?b"),)),
        rules.Rule("step", (m("?a", "above", "?b"), m("?b", "above", "?c")), (("?a", "above", "?c"),)),
        rules.Rule("top", (m("?a", "rdf:type", "P"), m("?a", "under", "?x", negated=False)), (("?a", "kind", "lower"),)),
        rules.Rule("inverse", (m("?a", "above", "?b"),), (("?b", "under", "?a"),)),
        rules.Rule("none", (m("?a", "rdf:type", "P"), m("?a", "kind", "lower", negated=True)), (("?a", "kind2", lambda v: F.concat(v["?a"], F.lit("!"))),)),
    ]
    got = {tuple(r) for r in rules.infer(facts, program).collect()}
    assert ("1", "x", "above", "z") in got and ("2", "x", "above", "z") not in got and ("1", "z", "kind", "lower") in got and ("1", "x", "kind2", "x!") in got and ("1", "z", "kind2", "z!") not in got
    loop = [rules.Rule("a", (m("?x", "p", "1"), m("?x", "r", "1", negated=True)), (("?x", "q", "1"),)), rules.Rule("b", (m("?x", "q", "1"),), (("?x", "r", "1"),))]
    with pytest.raises(ValueError):
        rules.strata(loop)


def test_rules_run_once_unless_they_feed_themselves(spark, monkeypatch):
    m, names = rules.Match, []
    rule = lambda name, p, q, **more: rules.Rule(name, (m("?x", p, "?y"), m("?y", p, "?z")) if more.get("two") else (m("?x", p, "?y"),), (("?x", q, "?z" if more.get("two") else "?y"),))
    group = [rule("last", "c", "d"), rule("chain", "b", "c"), rule("round", "c", "b"), rule("first", "a", "b"), rule("beside", "a", "e"), rule("any", "?p", "f")]
    assert [([r.name for r in own], again) for own, again in rules.passes(group)] == [(["first", "beside"], False), (["chain", "round"], True), (["last"], False), (["any"], True)]
    monkeypatch.setattr(rules, "stored", lambda df, name, f=rules.stored: names.append(name) or f(df, name))
    facts = spark.createDataFrame([("1", "x", "a", "y"), ("1", "y", "a", "z"), ("2", "x", "a", "y"), ("1", "x", "c", "z")], "session string, s string, p string, o string")
    got = sorted(tuple(r) for r in rules.infer(facts, [rule("third", "c", "d"), rule("first", "a", "b"), rule("second", "b", "c", two=True)]).collect())
    want = [("1", "x", "a", "y"), ("1", "x", "b", "y"), ("1", "x", "c", "z"), ("1", "x", "d", "z"), ("1", "y", "a", "z"), ("1", "y", "b", "z"), ("2", "x", "a", "y"), ("2", "x", "b", "y")]
    assert got == want and names == ["facts", "inferred", "inferred", "inferred"]


def test_entities_are_extracted_without_a_join(spark):
    rows = [("1", "x", "rdf:type", "A"), ("1", "x", "_member", "b"), ("1", "x", "_member", "a"), ("1", "y", "_member", "c"), ("1", "z", "rdf:type", "B"), ("1", "z", "other", "d"), ("2", "x", "rdf:type", "B"), ("2", "x", "rdf:type", "A")]
    facts = spark.createDataFrame(rows, "session string, s string, p string, o string")
    out = rules.extract_entities(facts, "A", ["_member", "rdf:type", "other"], ("rdf:type",))
    assert sorted((tuple(r) for r in out.collect()), key=str) == [("1", "x", "a", ["A"], None), ("2", "x", None, ["A", "B"], None)]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_rules_equal_a_plain_fixpoint(spark):
    """Joined, mutual, wildcard and negating rules over chance facts, beside a loop over all facts."""
    m, rng = rules.Match, random.Random(6)
    program = [
        rules.Rule("path", (m("?a", "p", "?b"), m("?b", "path", "?c")), (("?a", "path", "?c"), ("?c", "back", "?a"))),
        rules.Rule("start", (m("?a", "p", "?b"),), (("?a", "path", "?b"),)),
        rules.Rule("self", (m("?a", "path", "?a"),), (("?a", "loop", "1"),)),
        rules.Rule("even", (m("?a", "odd", "?b"), m("?b", "p", "?c")), (("?a", "even", "?c"),)),
        rules.Rule("odd", (m("?a", "even", "?b"), m("?b", "p", "?c")), (("?a", "odd", "?c"),)),
        rules.Rule("any", (m("?a", "?q", "3"),), (("?a", "near", "3"),)),
        rules.Rule("not", (m("?a", "p", "?b"), m("?a", "back", "?b", negated=True), m("?b", "loop", "1", negated=True)), (("?a", "away", "?b"),)),
    ]
    facts = {(s, str(rng.randrange(7)), p, str(rng.randrange(7))) for s in "12" for p in ("p", "odd") for _ in range(4 if p == "p" else 2)} | {("1", "0", "path", "1")}
    want = set(facts)
    for group in rules.strata(program):
        before = -1
        while len(want) > before:
            before = len(want)
            for r in group:
                found = [{}]
                for a in (a for a in r.when if not a.negated):
                    found = [{**e, **b} for e in found for s, *f in want if (b := {"session": s, **{t: v for t, v in zip((a.s, a.p, a.o), f, strict=True) if t[0] == "?"}}) and all(e.get(k, v) == v for k, v in b.items()) and all({**e, **b}.get(t, t) == v for t, v in zip((a.s, a.p, a.o), f, strict=True))]
                found = [e for e in found if not any((e["session"], e.get(a.s, a.s), a.p, e.get(a.o, a.o)) in want for a in r.when if a.negated)]
                want |= {(e["session"], e.get(s, s), p, e.get(o, o)) for e in found for s, p, o in r.then}
    got = [tuple(r) for r in rules.infer(spark.createDataFrame([*facts, *facts], "session string, s string, p string, o string"), program).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {f[2] for f in want} >= {"path", "back", "even", "near", "away"}


def test_reports_and_queries(spark):
    text = "--first; SELECT $X AS x;\n--second; SELECT 2 AS y"
    assert queries.report_statements(text) == {"first": "SELECT $X AS x", "second": "SELECT 2 AS y"}
    assert queries.run_report(spark, "SELECT $X AS x", {"X": "a'b"}).first()["x"] == "a'b"
    assert queries.report_name("r_{CLIENT}_{D:YYYY_MM_DD}", {"CLIENT": "c"}, date(2024, 5, 6)) == "r_c_2024_05_06"
    with pytest.raises(ValueError):
        queries.select({"a": spark.range(1), "b": spark.range(1)}, {"from": ["a", "b"], "columns": []})


def test_csv_dialects(spark, tmp_path):
    for name, raw, want in (("pipe", b"a|b|a\n1|\"x|y\"|\n2|z|w\n", [("1", "x|y", None), ("2", "z", "w")]), ("utf16", "a,b,a\n1,é,2\n".encode("utf-16"), [("1", "é", "2")]), ("latin", "a;b;a\n1;é;2\n".encode("iso-8859-1"), [("1", "é", "2")])):
        (tmp_path / f"{name}.csv").write_bytes(raw)
        good, _ = readers.read_csv(spark, str(tmp_path / f"{name}.csv"))
        assert good.columns == ["a", "b", "a_2"] and [tuple(r) for r in good.collect()] == want
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n3\n4,5,6\n7,8\n")
    good, bad = readers.read_csv(spark, str(tmp_path / "bad.csv"))
    assert [r["a"] for r in good.collect()] == ["1", "7"] and bad.count() == 2


def test_fixed_width_record_types(spark, tmp_path):
    (tmp_path / "f.txt").write_text("A001 x\nB002yy\nC003\n")
    layout = [readers.Field("id", 1, 4, "A"), readers.Field("v", 4, 6, "A"), readers.Field("id", 1, 4, "B")]
    rows = [tuple(r) for r in readers.read_fixed_width(spark, str(tmp_path / "f.txt"), layout, (0, 1)).collect()]
    assert rows == [("001", "x", None), (None, None, "002")]


def test_xlsx(spark, tmp_path):
    import zipfile

    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>name</t></si><si><t>Ann</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData><row><c r="A1" t="inlineStr"><is><t>title</t></is></c></row><row><c r="A2" t="s"><v>0</v></c><c r="B2" t="inlineStr"><is><t>age</t></is></c></row><row><c r="B3"><v>7</v></c></row><row><c r="A4" t="s"><v>1</v></c><c r="B4"><v>8</v></c></row></sheetData></worksheet>')
    got = [tuple(r) for r in readers.read_xlsx(spark, str(tmp_path / "w.xlsx"), ["name", "age"], "S").collect()]
    assert got == [(None, "7"), ("Ann", "8")]


def test_writers(spark, tmp_path):
    df = spark.range(10).select(F.col("id").cast("string").alias("v"), (F.col("id") % 2).alias("k"))
    writers.write_partitions(df, str(tmp_path / "p"), ["k"], rows_each=2)
    assert len(list((tmp_path / "p" / "k=0").glob("*.parquet"))) >= 3 and spark.read.parquet(str(tmp_path / "p")).count() == 10
    writers.merge_files(df, str(tmp_path / "one"), header=True)
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    assert [r["value"] for r in writers.fixed_width_lines(df.limit(1), {"v": 3, "k": 1}).collect()] == ["0  0"]


def test_files_on_arrival(spark, tmp_path):
    spark.range(6).write.parquet(str(tmp_path / "in"))
    config = {"sources": ["files"], "steps": [{"pipes": [{"type": "fan_out", "input": "files", "apply": [{"type": "filter", "filter": {"op": ">", "lhs": {"select": "id"}, "rhs": {"value": "2"}}, "output": "out"}]}]}]}
    for _ in range(2):  # a second start finds nothing new
        runner.run_on_arrival(spark, str(tmp_path / "in"), spark.range(1).schema, config, "files", "out", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [3, 4, 5]


def test_row_numbers_without_one_task(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1009).alias("o"))
    rows = transforms.numbered(df, "o").orderBy("o").collect()
    assert [r["_n"] for r in rows] == list(range(1000))


def test_shuffling(spark):
    df = spark.createDataFrame([(k, f"v{k}") for k in range(20)], "a int, b string")
    out = transforms.shuffling(df, 10, 50, seed=1)
    assert out.count() == 50 and out.select("a").distinct().count() > 3
    assert transforms.shuffling(df.limit(0), 10, 50).count() == 0


def test_splitter_refuses_what_it_cannot_cut(spark):
    df = spark.createDataFrame([(1, "a")], "x int, k string")
    for bad in ({"type": "shuffling", "output": "o"}, {"type": "merge", "output": "o"}):
        with pytest.raises(ValueError):
            pipeline.validate({"sources": ["in"], "steps": [{"pipes": [{"type": "splitter", "splitter": {"column": "k"}, "input": "in", "apply": [bad]}]}]})
    with pytest.raises(ValueError):
        pipeline.validate({"sources": ["in"], "steps": [{"pipes": [{"type": "splitter", "splitter": {}, "input": "in", "apply": []}]}]})
    pipes = lambda s, a: {"sources": ["in"], "steps": [{"pipes": [{"type": "splitter", "splitter": s, "input": "in", "apply": [a]}]}]}
    many = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(50)], "x int, k string")
    few = pipeline.build(spark, pipes({"column": "k"}, {"type": "filter", "max_output_records": 3, "output": "o"}), {"in": many})["o"]
    assert sorted(r["k"] for r in few.collect()) == ["a"] * 3 + ["b"] * 3
    all_rows = pipeline.build(spark, pipes({"column": "k"}, {"type": "filter", "max_output_records": 0, "output": "o"}), {"in": many})["o"]
    assert all_rows.count() == 50
    profile_rows = pipeline.build(spark, pipes({"column": "k"}, {"type": "analyze", "output": "o"}), {"in": many})["o"].collect()
    assert {(r["split_key"], r["column_name"], r["total_count"]) for r in profile_rows} >= {("a", "x", 25), ("b", "x", 25)}


def test_numbers_within_ranges(spark, monkeypatch):
    rng = __import__("random").Random(4)
    rows = [(x, None if rng.random() < 0.3 else "hot") for x in rng.sample(range(1000), 400)]
    df = spark.createDataFrame(rows, "x int, k string").repartition(3)
    got = {(r["k"], r["x"]): r["_n"] for r in transforms.numbered(df, "x", within=["k"], rows=20).collect()}
    for key in (None, "hot"):
        own = sorted(x for x, k in rows if k == key)
        assert [got[key, x] for x in own] == list(range(len(own)))
    monkeypatch.setattr(transforms, "RANGE_ROWS", 20)
    blend, k = 0.0, 0
    for x, _ in sorted(rows):
        k += 1
        blend += (x - blend) * 2 / (k + 1)
    out = transforms.aggregate_rows(df, [{"name": "b", "type": "avrg", "expr": "x"}, {"name": "n", "type": "count", "expr": "*"}], order="x").first()
    assert out["b"] == pytest.approx(blend) and out["n"] == 400
    runs = spark.createDataFrame([(k, k // 7 % 3) for k in range(200)], "seq int, key int").repartition(3)
    assert sorted(len(r["rows"]) for r in transforms.group_by(runs, "seq", ["key"], consecutive=True).collect()) == [4] + [7] * 28
    values = [(str(v),) for v in range(30) for _ in range(1 + v % 4)]
    kept = {r["freq_value"] for r in transforms.high_freq(spark.createDataFrame(values, "v string"), ["v"], 37).collect()}
    counts = sorted(((-(1 + v % 4), str(v)) for v in range(30)))
    total, before, want = len(values), 0, set()
    for n, v in counts:
        if before <= total * 37 / 100:
            want.add(v)
        before -= n
    assert kept == want


def test_record_class_key_and_errors(spark):
    df = spark.createDataFrame([("1", None), ("1", ""), ("1", None)], "a string, b string")
    out = transforms.map_record(df, [{"name": "a", "type": "select", "expr": "a"}], class_name="Claim", row_key="jets:key").collect()
    assert out[0]["rdf:type"] == ["Claim"] and out[0]["jets:key"] == out[2]["jets:key"] != out[1]["jets:key"]
    bad = spark.createDataFrame([("12",)], "phone string")
    spec = {"name": "p", "type": "map", "expr": "phone", "map_expr": {"cleansing_function": "format_phone"}}
    with pytest.raises(Exception, match="column in error"):
        transforms.map_record(bad, [spec], fail_on_error=True).collect()


def test_map_reduce_keeps_keys_and_takes_alternates(spark):
    df = spark.createDataFrame([("a", None, "x"), ("b", "1", "x"), ("b", "1", "y"), ("b", None, "z")], "k string, m string, alt string")
    spec = [{"type": "map_reduce", "map_on": "m", "apply_map": [{"name": "n", "type": "count", "expr": "*"}], "apply_reduce": [{"name": "keys", "type": "count", "expr": "*"}]}]
    assert {r["k"]: r["keys"] for r in transforms.aggregate_rows(df, spec, ["k"]).collect()} == {"a": None, "b": 1}
    spec[0]["alternate_map_on"] = ["alt"]
    assert {r["k"]: r["keys"] for r in transforms.aggregate_rows(df, spec, ["k"]).collect()} == {"a": 1, "b": 2}


def test_deidentification(spark):
    df = spark.createDataFrame([("Ann", "123"), (None, "9")], "name string, id string")
    table = spark.createDataFrame([("1", "x7y")], "key string, v string")
    a = anonymize.Action
    out = anonymize.anonymize(df, [a("name", "blank"), a("id", "lookup", table=table, table_column="v", table_key="key")])[0].collect()
    assert [tuple(r) for r in out] == [("", "7"), (None, "7")]
    actions = anonymize.actions_from_metadata(["name", "id"], [{"column_pos": "1", "data_classification": "id", "numeric_pct": "97"}], {"id"}, {}, deid_functions={"id": "hashed_value"}, deid=True)
    assert [(x.column, x.how) for x in actions] == [("id", "numeric_hashed_value")]
    assert anonymize.widened({"name": 5, "id": 30}, [a("name", "text", "p"), a("id", "text")]) == {"name": 28, "id": 30}


def test_profile_details(spark):
    with pytest.raises(ValueError):
        profile.analyze(spark.createDataFrame([], "x int"))
    df = spark.createDataFrame([("2024-01-02", "NEW YORK", 5e10), ("2024-02-03", "YORK N", 1.0), ("01/02/2024", "PARIS", 2.0)], "d string, city string, x double")
    names = spark.createDataFrame([("New",), ("York",)], "w string")
    got = {r["column_name"]: r for r in profile.analyze(df, profile.Profile(lookups={"city": names}, name_tokens=(("cit", "place"), ("d", "day")))).collect()}
    assert got["d"]["date_formats"] == "yyyy-MM-dd,MM/dd/yyyy" and got["x"]["large_double_pct"] == pytest.approx(100 / 3, abs=1e-5)
    assert got["city"]["city_pct"] == pytest.approx(200 / 3, abs=1e-5) and (got["city"]["name_token"], got["d"]["name_token"]) == ("place", "day")


def test_rule_functions(spark):
    from millrace.functions import rule_ops

    b, u = rule_ops.BINARY, rule_ops.UNARY
    r = spark.range(1).select(
        b["=="](F.lit(0.1) + F.lit(0.2).cast("double"), F.lit(0.3).cast("double")).alias("near"), b["=="](F.lit("a"), F.lit("b")).alias("text"), b["+"](F.lit("a"), F.lit("b"), True).alias("joined"), b["apply_format"](F.lit(date(2024, 3, 1)), "MM/dd/yyyy").alias("day"), b["apply_format"](F.lit(7), "%03d").alias("number"),
        u["trim"](F.lit("\t\n a b \u00a0")).alias("trimmed"), u["is_resource"](u["create_resource"](F.lit("x"))).alias("resource"), u["is_literal"](F.lit("x")).alias("literal"),
    ).first()
    assert tuple(r) == (1, 0, "ab", "03/01/2024", "007", "a b", 1, 1)
    table = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    found = rule_ops.multi_lookup_rand(spark.range(5).toDF("id"), table, "k", seed=1).collect()
    assert all(len(x["found"]) == (2 if x["found"][0]["k"] == "a" else 1) for x in found)
    with pytest.raises(ValueError):
        rules.from_config([{"name": "r", "when": [["?x", "p", "?y"]], "where": ["no such", "?y"], "then": [["?x", "q", "1"]]}])[0].where({"?y": F.lit(1)})


def test_files_in_and_out(spark, tmp_path):
    df = spark.createDataFrame([("1", "x"), ("2", "y")], "a string, b string")
    writers.write_report(df, str(tmp_path / "r"), "csv")
    assert sorted(r["b"] for r in readers.read_csv(spark, str(tmp_path / "r"))[0].collect()) == ["x", "y"]
    with pytest.raises(ValueError):
        readers.several_columns(spark.createDataFrame([("1,x", None)], "a string, b string"))
    got = writers.coerced(spark.createDataFrame([("12", ["7", "8"], "03/01/2024", "x")], "n string, l array<string>, d string, bad string"), {"n": "int", "l": "int", "d": "date", "bad": "double"}).first()
    assert tuple(got) == (12, 7, date(2024, 3, 1), None)
    writers.write_column_list(spark, ["a", 'b"c'], str(tmp_path / "list"))
    assert spark.read.text(str(tmp_path / "list")).first()[0] == '"a","b""c"'
    writers.copy_files(spark, str(tmp_path / "r"), str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 2
