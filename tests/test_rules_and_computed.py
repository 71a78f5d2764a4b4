"""Structured rules, computed properties and the helpers around them, on hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import predicates, texts
from corvane.operators import metadata, objects
from corvane.plans import computed, structured
from corvane.plans.rules import RuleError
from corvane.sources import properties

STEP = structured.Step("a", "a", (("k", "eq", "{{inputs.id}}"),), {"v": "v"})


def _tables(spark):
    return {"a": spark.createDataFrame([(1, 10), (2, 20), (2, 21), (4, None)], "k long, v long"), "b": spark.createDataFrame([(10, "x")], "v long, name string")}


def test_structured_rule_tells_missing_from_multiple(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    out = structured.run(ids, "id", structured.Rule((STEP,), ("id",), "v"), _tables(spark), {"id": "id"})
    assert sorted(map(tuple, out.collect())) == [(1, "ok", 10), (2, "multiple", None), (3, "missing", None), (4, "ok", None)]
    second = structured.Step("b", "b", (("v", "eq", "{{steps.a.v}}"),), {"name": "name"})
    out = structured.run(ids, "id", structured.Rule((STEP, second), ("id",), "name"), _tables(spark), {"id": "id"})
    assert {r["id"]: (r["status"], r["value"]) for r in out.collect()} == {1: ("ok", "x"), 2: ("multiple", None), 3: ("missing", None), 4: ("missing", None)}


def test_structured_rule_step_of_literals_and_empty_series(spark):
    ids = spark.createDataFrame([(1,), (3,)], "id long")
    fixed = structured.Step("b", "b", (("name", "eq", "x"),), {"v": "v"})
    out = structured.run(ids, "id", structured.Rule((fixed,), ("id",), "v"), _tables(spark), {"id": "id"})
    assert sorted(map(tuple, out.collect())) == [(1, "ok", 10), (3, "ok", 10)]
    many = structured.Step("a", "a", (("k", "eq", "{{inputs.id}}"),), {"v": "v", "t": "k"}, many=True)
    out = structured.run(ids, "id", structured.Rule((many,), ("id",), "v", "t"), _tables(spark), {"id": "id"})
    assert {r["id"]: [tuple(x) for x in r["series"]] for r in out.collect()} == {1: [(1, 10)], 3: []}


@pytest.mark.parametrize(
    "rule",
    [
        structured.Rule((), (), "v"),
        structured.Rule((STEP,), (), "v"),
        structured.Rule((STEP,), ("id",), "w"),
        structured.Rule((STEP, STEP), ("id",), "v"),
        structured.Rule((structured.Step("a", "a", (("k", "like", 1),), {"v": "v"}),), (), "v"),
        structured.Rule((structured.Step("a", "a", (("k", "eq", "{{oops}}"),), {"v": "v"}),), (), "v"),
        structured.Rule((STEP,), ("id",), "v", "v"),
        structured.Rule((structured.Step("a", "a", (("k", "gt", "{{inputs.id}}"),), {"v": "v"}),), ("id",), "v"),
    ],
)
def test_faulty_rules_are_refused(spark, rule):
    with pytest.raises(RuleError):
        structured.run(spark.createDataFrame([(1,)], "id long"), "id", rule, _tables(spark), {"id": "id"})


def test_inline_sql_is_one_select_and_keeps_quoted_text(spark):
    ids = spark.createDataFrame([(1,), (3,)], "id long")
    got = computed.sql_property(ids, "id", "v", "SELECT max(v) FROM {a} WHERE k = :instanceId AND ':instanceId' <> 'x'", {"a": _tables(spark)["a"]})
    assert sorted(map(tuple, got.collect())) == [(1, 10), (3, None)]
    for bad in ("WITH x AS (SELECT 1) SELECT * FROM x", "DROP TABLE x"):
        with pytest.raises(ValueError):
            computed.sql_property(ids, "id", "v", bad, {})


def test_formulas_follow_each_other_and_circles_are_named(spark):
    df = spark.createDataFrame([(8.0, 2.0), (8.0, 0.0)], "a double, b double")
    got = computed.calculated(df, {"d": "{c} + 1", "c": "{a} / {b}"}).orderBy("b").collect()
    assert (got[1]["c"], got[1]["d"], got[1]["errors"]) == (4.0, 5.0, [])
    assert got[0]["c"] is None and got[0]["errors"] == ["c", "d"]
    with pytest.raises(ValueError, match="circle"):
        computed.calculated(df, {"d": "{c} + 1", "c": "{d} / {b}"})
    with pytest.raises(ValueError, match="beside its contract"):
        computed.implemented(df, {"x": (computed.Contract(("a",), ("c",)), {"c": "{a} * {b}"})})


def test_absent_outputs_fields_and_values(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "k long, v string")
    with pytest.raises(ValueError):
        computed.declared(df, ["w"])
    assert computed.declared(df, ["k"])[1] == ["v"]
    with pytest.raises(ValueError):
        computed.field_path("k", {"type": "number"}, ["f"])
    with pytest.raises(Exception, match="no value for v"):
        properties.present(df, "v", "error").collect()
    assert computed.shaped(df.filter("false"), "object", [F.col("k")]).collect()[0].asDict() == {"k": None, "v": None}


def test_names_pass_over_numbers_that_are_taken(spark):
    rows = [(1, "a"), (2, "a"), (3, "A"), (4, "a (2)"), (5, " "), (6, None), (7, "b" * 100), (8, "b" * 100)]
    got = {r["id"]: r["final"] for r in metadata.suffixed(spark.createDataFrame(rows, "id long, name string"), "name", F.col("id")).collect()}
    assert got == {1: "a", 2: "a (3)", 3: "A (4)", 4: "a (2)", 5: "unnamed", 6: "unnamed (2)", 7: "b" * 80, 8: "b" * 76 + " (2)"}


def test_preview_says_whether_there_is_more(spark):
    df = spark.range(20)
    assert {r["truncated"] for r in metadata.preview(df, [F.col("id")]).collect()} == {False}
    assert [(r["id"], r["truncated"]) for r in metadata.preview(df, [F.col("id").desc()], 2).collect()] == [(19, True), (18, True)]


def test_components_paths_and_filters(spark):
    links = spark.createDataFrame([(n, n + 1) for n in range(40)] + [(90, 91), (7, 7), (None, 1)], "a long, b long")
    got = dict(map(tuple, objects.connected(links, "a", "b").collect()))
    assert got == {n: 0 for n in range(41)} | {90: 90, 91: 90}
    paths = spark.createDataFrame([("$.a.b",), ("a",), ("",), (None,), ("a[1]",), ("$..a..b.c.",)], "p string")
    assert [r[0] for r in paths.select(texts.object_path(F.col("p"))).collect()] == ["a", "", "", "", "a[1]", "a.b"]
    arrays = spark.createDataFrame([("[]",), ("[1, {\"y\": 1, \"x\": 2}, 2]",), ("no",), (None,)], "c string")
    got = [r[0] and tuple(r[0]) for r in arrays.select(texts.array_summary(F.col("c"))).collect()]
    assert got[:2] == [(0, "", None), (3, "bigint=2,object=1", "x,y")] and got[2][0] is None and got[3][0] is None
    df = spark.createDataFrame([(1, "North", None), (2, "", 5.0)], "k long, s string, v double")
    kept = lambda *a: [r["k"] for r in df.filter(predicates.explored(df, *a)).collect()]
    assert (kept("north"), kept("", "s", "missing"), kept("", "v", "gte", "5"), kept("", "v", "gte", "x"), kept("", "s", "gte", "5"), kept("", "s", "eq", "North")) == ([1], [2], [2], [], [], [1])
