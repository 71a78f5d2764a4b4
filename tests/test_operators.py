"""Hand-computed cases of the library's operators."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corvane.functions import calc, formats, sqltemplate, texts, valuetypes
from corvane.functions.predicates import Condition, conjunction
from corvane.operators import aggregate, facts, metadata, objects
from corvane.plans import flow, rules
from corvane.sources import materials, properties
from corvane.streaming import freshness

DEVICES = [(1, "A", "CZY", 0, 200.0), (2, "B", "CZY", 0, 300.0), (3, "other park", "OTHER", 0, 999.0), (4, "deleted", "CZY", 1, 500.0)]
ACTIVE = [Condition("park", "eq", "CZY"), Condition("del_flag", "eq", 0)]


def devices(spark, *more):
    return spark.createDataFrame(DEVICES + list(more), "id int, name string, park string, del_flag int, capacity double")


def verdict(spark, df, rule, scope="filtered"):
    rows = df.filter(conjunction(df, rule, scope)).withColumn("owner", F.lit(1))
    out = aggregate.relation_sum(spark.createDataFrame([(1,)], "owner int"), "owner", rows, "owner", "capacity").first()
    return out.verdict, out.total, out.n_members, out.n_missing


def test_relation_sum_verdicts(spark):
    assert verdict(spark, devices(spark), ACTIVE) == ("ok", 500.0, 2, 0)
    assert verdict(spark, devices(spark, (5, "C", "CZY", 0, None)), ACTIVE) == ("incomplete", None, 3, 1)
    assert verdict(spark, devices(spark), [Condition("park", "eq", "none")]) == ("empty", None, 0, 0)
    assert verdict(spark, devices(spark), [], "all") == ("ok", 1999.0, 4, 0)
    assert verdict(spark, devices(spark, (6, "N", None, 0, 42.0)), [Condition("park", "isnull")]) == ("ok", 42.0, 1, 0)
    nulls = devices(spark, (8, "x", "NULLTEST", None, 77.0), (9, "y", "NULLTEST", 0, 11.0))
    assert verdict(spark, nulls, [Condition("park", "in", ["NULLTEST"]), Condition("del_flag", "notnull")]) == ("ok", 11.0, 1, 0)


def test_bad_rules_are_refused(spark):
    df = devices(spark)
    for rule in ([], [Condition("nope", "eq", 1)], [Condition("id", "eq", 1.5)], [Condition("id", "in", [])], [Condition("id", "isnull", 3)], [Condition("id", "like", 3)]):
        with pytest.raises(ValueError):
            conjunction(df, rule)
    with pytest.raises(ValueError):
        aggregate.within_limit(df, 3)


def test_conflicting_copies_and_owners(spark):
    df = spark.createDataFrame([(7, 100.0), (7, 250.0), (8, 1.0), (8, 1.0), (9, None), (9, 2.0), (10, None), (10, None)], "id int, v double")
    assert {r.id: r.conflict for r in aggregate.deduplicated(df, ["id"], "v").collect()} == {7: True, 8: False, 9: True, 10: False}
    owned = aggregate.members(devices(spark), {"a": [Condition("park", "eq", "CZY")], "b": [Condition("id", "lte", 1)]})
    assert [tuple(r) for r in aggregate.ownership_conflicts(owned, "id").collect()] == [(1, 2)]


def test_as_of_weighted_mean_and_ties(spark):
    t0 = dt.datetime(2024, 1, 1, 12)
    obs = spark.createDataFrame([("a", t0, 1.0), ("a", t0 + dt.timedelta(hours=1), 40.0), ("a", t0 + dt.timedelta(hours=3), 9.0), ("b", t0, 5.0), ("b", t0, 6.0)], "k string, ts timestamp_ntz, v double")
    assert sorted((r.k, r.v, r.n_ties) for r in objects.as_of(obs, "k", "ts", "v", "2024-01-01 13:00:00").collect()) == [("a", 40.0, 1), ("b", 6.0, 2)]
    w = spark.createDataFrame([("s", 40.0, 100.0), ("s", 80.0, 300.0), ("t", 101.0, 1.0), ("t", 1.0, 1.0), ("u", None, 1.0)], "k string, v double, w double")
    assert {r.k: (r.mean, r.n_bad) for r in objects.weighted_mean(w, ["k"], "v", "w").collect()} == {"s": (70.0, 0), "t": (None, 1), "u": (None, 1)}


def test_closure_ends_on_cycles_and_aliases_too(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "parent string, child string")
    assert sorted(r.node for r in objects.closure(edges, spark.createDataFrame([("a",)], "node string")).collect()) == ["a", "b", "c"]
    aliases = spark.createDataFrame([("a", "b"), ("b", "c"), ("p", "q"), ("q", "p")], "key string, target string")
    assert {r.key: r.target for r in objects.resolve_aliases(aliases).collect()} == {"a": "c", "b": "c", "p": "p", "q": "q"}


def test_sources(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    with pytest.raises(PySparkException):
        properties.single(df, "k", "v").collect()
    series = spark.createDataFrame([(1, dt.datetime(2024, 1, d), None if d == 2 else float(d)) for d in (1, 2, 3)], "k int, ts timestamp_ntz, v double")
    got = properties.time_series(series, "k", "ts", "v", "2024-01-01 00:00:00", "2024-01-03 00:00:00").first().series
    assert [(p.timestamp.day, p.value) for p in got] == [(1, 1.0), (2, None)]
    store = spark.createDataFrame([("d:1", "7"), ("d:2", "x")], "key string, value string")
    objects_ = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    out = properties.key_value(objects_, properties.key_of("d:{id}", id=F.col("id")), store, "integer")
    assert sorted((r.id, r.value) for r in out.collect()) == [(1, 7), (2, None), (3, None)]


@pytest.mark.parametrize(
    ("formula", "values", "want"),
    [
        ("{a} / {b} * 100", (40.0, 100.0), 40.0),
        ('IF({b} > 0, {a}/{b}*100, ERROR("no base"))', (40.0, 8.0), 500.0),
        ("MAX({a},{b},10)", (3.0, 5.0), 10.0),
        ("ROUND({a}/{b},2)", (2.0, 3.0), 0.67),
        ("-{a} + (2 - {b}) * 3", (1.0, 1.0), 2.0),
    ],
)
def test_formula_values(spark, formula, values, want):
    df = spark.createDataFrame([values], "a double, b double")
    assert df.select(calc.strict(formula, {"a": "a", "b": "b"})).first()[0] == pytest.approx(want)


def test_rid_grammar(spark):
    df = spark.createDataFrame([("ri.a.x-1.b.c",), ("ri.a..b.c",), ("ri.a.-x.b.c",), ("ri.a.b",)], "x string")
    assert [bool(r.e) for r in df.select(valuetypes.rid(F.col("x")).alias("e")).collect()] == [False, False, True, True]


@pytest.mark.parametrize(
    "formula,value,error",
    [
        ("MIN({a} / {b}, 5)", None, "division by zero"),
        ("IF({a} / {b} > 1, 1, 2)", None, "division by zero"),
        ('1 / ERROR("bad")', None, "bad"),
        ('MIN(ERROR("bad"), 5)', None, "bad"),
        ("IF({b} > 0, {c}, -1)", -1.0, None),
        ("{a} / ABS({b})", None, "division by zero"),
        ("{a} / -{a}", -1.0, None),
        ("{a} / ROUND({a}, 2)", 1.0, None),
        ('IF({a} = 1, ERROR("first"), ERROR("second"))', None, "first"),
        ('IF({a} != 1, ERROR("first"), ERROR("second"))', None, "second"),
        ("{b} + {c} * 2", None, "missing input c"),
        ("1e200 * 1e200", None, "the result is not finite"),
    ],
)
def test_formula_errors_pass_through_all_parts(spark, formula, value, error):
    df = spark.createDataFrame([(1.0, 0.0, None)], "a double, b double, c double")
    got = df.select(calc.collect(formula, {"a": "a", "b": "b", "c": "c"}).alias("x")).first().x
    assert (got.value, got.error) == (value, error)


def test_formula_errors(spark):
    df = spark.createDataFrame([(40.0, 0.0), (1.0, None), (8.0, 2.0)], "a double, b double")
    names = {"a": "a", "b": "b"}
    got = [r.x for r in df.select(calc.collect('IF({b} > 0, {a}/{b}, ERROR("no base"))', names).alias("x")).collect()]
    assert [(x.value, x.error) for x in got] == [(None, "no base"), (None, "missing input b"), (4.0, None)]
    got = [r.x for r in df.select(calc.collect("{a} / {b}", names).alias("x")).collect()]
    assert [(x.value, x.error) for x in got] == [(None, "division by zero"), (None, "missing input b"), (4.0, None)]
    for bad in ("{a} / {b}", "1e200 * 1e200 + {a}"):
        with pytest.raises(PySparkException):
            df.select(calc.strict(bad, names)).collect()
    for refused in ("{c}", "SUM({a})", "{a} ? 1", "(" * 30 + "{a}" + ")" * 30, "1+" * 260 + "1", "MIN({a})", "ROUND({a}, 9)", "({a}"):
        with pytest.raises(calc.FormulaError):
            calc.spark_sql(refused, names)


def test_templates():
    sql, args = sqltemplate.render('SELECT * FROM t <where><if test="a">AND a < #{a}</if><if test="b">OR b = #{b}</if></where>', {"a": None, "b": 2})
    assert " ".join(sql.split()) == "SELECT * FROM t WHERE b = :p0" and args == {"p0": 2}
    sql, args = sqltemplate.render('UPDATE t <set><foreach collection="c" item="x" separator=" ">${x} = #{x},</foreach></set>', {"c": ["k", "v"]})
    assert " ".join(sql.split()) == "UPDATE t SET k = :p0, v = :p1" and args == {"p0": "k", "p1": "v"}
    assert sqltemplate.truth("a == 'x' or not (b >= 2 and c)", {"a": "y", "b": 1, "c": None})
    for test in ("a < 1", "__import__('os')", "a.b", "zz"):
        with pytest.raises(sqltemplate.TemplateError):
            sqltemplate.truth(test, {"a": None})
    for bad in ("<if>", "<choose><if test='a'>x</if></choose>"):
        with pytest.raises(sqltemplate.TemplateError):
            sqltemplate.render(bad, {"a": 1})
    with pytest.raises(sqltemplate.TemplateError):
        sqltemplate.render("${a}", {"a": "x; drop"})
    for bad in ("DELETE FROM t", "SELECT 1; SELECT 2"):
        with pytest.raises(sqltemplate.TemplateError):
            sqltemplate.read_only(bad)
    assert sqltemplate.checked('<if test="x">#{y}</if>', {"y", "z"}) == [("error", "undeclared parameter x"), ("warning", "unused parameter z")]


def test_value_types(spark):
    df = spark.createDataFrame([("1",), ("2.0",), ("x",), ("NaN",), ("2024-02-30",), ("2024-01-01T00:00:00Z",), (None,)], "v string")
    errors = lambda base: [r[0] for r in df.select(F.size(valuetypes.scalar(F.col("v"), base))).collect()]
    assert errors("integer") == [0, 0, 1, 1, 1, 1, 0]
    assert errors("dateTime") == [1, 1, 1, 1, 1, 0, 0]
    assert errors("date") == [1, 1, 1, 1, 1, 1, 0]
    assert valuetypes.cycle({"a": ["b"], "b": ["c"], "c": ["a"]}) == ["a", "b", "c", "a"] and valuetypes.cycle({"a": ["b"], "b": []}) == []


@pytest.mark.parametrize(
    ("value", "options", "want"),
    [
        (70.56, {"style": "percent", "source": "hundred", "decimals": 1}, "70.6%"),
        (0.7056, {"style": "percent", "decimals": 1}, "70.6%"),
        (-1234.5, {}, "-1,234.50"),
        (1234.5, {"suffix": " kW"}, "1,234.50 kW"),
        (2.5, {"decimals": 0}, "3"),
        (0.0, {}, "0.00"),
        (-1234.5, {"style": "currency"}, "-¥1,234.50"),
        (1234567.0, {"style": "compact", "decimals": 1}, "1.2M"),
        (None, {}, "—"),
    ],
)
def test_numbers_shown(spark, value, options, want):
    assert spark.createDataFrame([(value,)], "v double").select(formats.number(F.col("v"), **options)).first()[0] == want


def test_texts_shown(spark):
    row = spark.createDataFrame([("001", "", None, True, ["a", "b", "c"])], "a string, b string, c string, d boolean, e array<string>").select(
        formats.template(F.col("a"), "ESS-{value}"), formats.template(F.col("b"), "{value}"), formats.masked(F.col("c")), formats.boolean(F.col("d"), "yes", "no"), formats.listed(F.col("e"), most=2)
    ).first()
    assert tuple(row) == ("ESS-001", "", "—", "yes", "a, b … +1")


def test_rules(spark):
    step = rules.Step
    bad = [
        [step("a", "SELECT 1 AS x"), step("a", "SELECT 2 AS x")],
        [step("a", "SELECT :b.x AS x"), step("b", "SELECT 1 AS x")],
        [step("a", "SELECT 1 AS x", many=True), step("b", "SELECT :a.x AS y")],
    ]
    for steps in bad:
        with pytest.raises(rules.RuleError):
            rules.Rule(steps).run(spark)
    for sql in ("SELECT 1 AS x WHERE 1 = 0", "SELECT explode(array(1, 2)) AS x"):
        with pytest.raises(rules.RuleError):
            rules.Rule([step("a", sql), step("b", "SELECT :a.x AS y")]).run(spark)
    assert rules.Rule([step("a", "SELECT 41 AS x"), step("b", "SELECT :a.x + :n AS y")]).run(spark, n=1).first().y == 42


def test_flow_checks():
    node = flow.Node
    assert flow.check([node("a", "sql", ["b"]), node("b", "sql", ["a"])])[0].startswith("circle")
    assert flow.check([node("a", "sql", ["zz"]), node("a", "odd")]) == ["repeated id a", "a: unknown kind odd", "a: unknown input zz"]


def test_metadata(spark):
    v = spark.createDataFrame([("x", "1.9.3"), ("x", "1.10.0"), ("y", "0.0.9")], "k string, v string")
    assert {r.k: r.next_version for r in metadata.next_version(v, "k", "v").collect()} == {"x": "1.10.1", "y": "0.0.10"}
    snaps = spark.createDataFrame([("a", 1), ("a", 2)], "k string, seq int")
    new = spark.createDataFrame([("a", 3, 2), ("a", 3, 1), ("b", 1, None)], "k string, seq int, expected int")
    assert sorted(tuple(r) for r in metadata.appended(snaps, new, "k", "seq").collect()) == [("a", 3), ("b", 1)]


def test_facts_and_packing(spark):
    assert spark.range(1).select(facts.normal_name(F.lit("  stationName-ID2 "))).first()[0] == "station_name_id2"
    df = spark.createDataFrame([("p", i, n) for i, n in enumerate([5, 5, 5, 20, 1, 9])], "plan string, pos int, size int")
    assert [r.batch for r in facts.packed(df, "plan", "pos", "size", 10).orderBy("pos").collect()] == [0, 0, 1, 2, 3, 3]


def test_parsers_never_fail():
    for path, content in (("a.json", b"{"), ("b.csv", b""), ("c.toml", b"="), ("d.unknown", b"hi\xff"), ("e.ini", b"x"), ("f.jsonl", b'{"a":1}\nbad\n'), ("g.properties", b"a.b = c\\\n d\n# no\n")):
        assert isinstance(materials.parse(path, content), list)
    assert materials.parse("g.properties", b"a.b = c\\\n  d\n")[0][2:5] == ("a.b", 1, '"cd"')


def test_stream_of_files(spark, tmp_path):
    rows = [(i % 2, dt.datetime(2024, 1, 1, i % 5), float(i)) for i in range(20)]
    spark.createDataFrame(rows, "k int, ts timestamp, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = freshness.latest(stream, "k", "ts", "v").writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    assert {r.k: r.ts.hour for r in spark.sql("SELECT * FROM latest").collect()} == {0: 4, 1: 4}


def test_types_fit_by_structure():
    from corvane import types

    wide = {"object": {"a": "number", "b": {"list": {"object": {"c": "text"}}}, "d": "text"}}
    asked = {"object": {"a": "number", "b": {"list": {"object": {"c": "text"}}}}}
    assert types.fits(wide, asked) and not types.fits(asked, wide) and not types.fits("text", "number")
    assert types.nested(wide) == 2
    assert types.json_value({"d": dt.datetime(2024, 1, 2, 3), "b": b"\xff", "n": None}) == {"d": "2024-01-02 03:00:00", "b": "�", "n": None}


def test_texts(spark):
    from corvane.functions import texts

    row = spark.range(1).select(
        texts.redacted(F.lit("password = abc token: x1 Bearer a.b-c")).alias("r"), texts.terms(F.lit("Ab_1 电池电压 x")).alias("t"),
        texts.conflicting(F.array(F.lit("A"), F.lit("b")), F.array(F.lit("a"), F.lit("c"))).alias("c"), texts.coordinate(F.lit("91"), -90, 90).alias("l"),
    ).first()
    assert row.r == "password = *** token: *** Bearer ***" and row.t == ["ab_1", "x", "电池", "池电", "电压"] and row.c == ["a"] and row.l is None


def test_sinks(spark, tmp_path):
    from corvane.sources import sinks

    path = str(tmp_path / "facts")
    rows = lambda *r: spark.createDataFrame(list(r), "material string, n int")
    sinks.replace_partitions(rows(("a", 1), ("a", 2), ("b", 3)), path, ["material"])
    for _ in range(2):
        sinks.replace_partitions(rows(("a", 9)), path, ["material"])
    assert sorted((r.material, r.n) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 3)]
    store = spark.createDataFrame([("x", "1"), ("y", "5")], "key string, value string")
    added = sinks.counted(store, spark.createDataFrame([("x", 2), ("x", -1), ("z", 4)], "key string, by int"))
    assert {r.key: r.value for r in added.collect()} == {"x": 2, "y": 5, "z": 4}
    absent = sinks.set_if_absent(store, spark.createDataFrame([("x", "9", 1), ("z", "b", 2), ("z", "a", 1)], "key string, value string, seq int"))
    assert {r.key: r.value for r in absent.collect()} == {"x": "1", "y": "5", "z": "a"}
    assert sinks.fetched(spark, ["u"], lambda u: '{"a": {"b": 3}}', "a.b").first().value == "3"
    entries = spark.createDataFrame([("../x", 1, 1), ("C:/x", 1, 1), ("a/b", 1, 1), ("big", 10**6, 10)], "name string, size long, packed long")
    assert {r.name: r.why for r in sinks.unsafe_entries(entries).collect()} == {"../x": "unsafe path", "C:/x": "unsafe path", "big": "ratio"}


def test_office_files():
    import io
    import zipfile

    def archive(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in files.items():
                z.writestr(name.replace("__", "/") + ".xml", text)
        return out.getvalue()

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>te</w:t><w:t>xt</w:t></w:r></w:p></w:body></w:document>'
    assert [(f[1], f[2], f[4]) for f in materials.parse("a.docx", archive(word__document=doc))] == [("heading", "Top", '""'), ("paragraph", "", '"text"')]
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><f>1+1</f><v>2</v></c><c r="C1" t="e"><v>#REF!</v></c></row></sheetData></worksheet>'
    book = archive(xl__workbook=f'<workbook {s}><sheets><sheet name="S"/></sheets></workbook>', xl__sharedStrings=f"<sst {s}><si><t>hi</t></si></sst>", xl__worksheets__sheet1=sheet)
    assert [(f[1], f[2], f[4]) for f in materials.parse("b.xlsx", book)] == [("cell", "S!A1", '"hi"'), ("cell", "S!B1", '"2"'), ("error_cell", "S!C1", '"#REF!"')]
    assert materials.parse("c.xlsx", b"no zip")[0][1] == "failure"


def test_facts_of_a_large_file_all_stay_and_long_lines_are_whole(spark):
    lines = "\n".join(f"line {i}" for i in range(25_000)) + "\n" + "x" * 5_000
    files = spark.createDataFrame([("big.txt", lines.encode()), ("bad.xlsx", b"no zip")], "path string, content binary")
    found = materials.facts(files)
    assert found.filter("path = 'big.txt'").count() == 25_001
    assert found.filter("kind = 'line' AND length(data) = 5002").count() == 1
    assert [r.kind for r in found.filter("path = 'bad.xlsx'").collect()] == ["failure"]


def test_nearest_rank_leaves_out_nulls(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", None), ("a", 2.0), ("b", None)], "k string, v double")
    got = {r.k: r.p for r in df.groupBy("k").agg(texts.nearest_rank("v", 0.5).alias("p")).collect()}
    assert got == {"a": 2.0, "b": None}


def test_owner_before_the_first_object_is_the_first_after(spark):
    properties = spark.createDataFrame([("m", 1), ("m", 5), ("m", 9), ("n", 1)], "m string, at int")
    objects_ = spark.createDataFrame([("m", 3, "a"), ("m", 7, "b")], "m string, at int, object string")
    got = sorted((r.m, r["at"], r.owner) for r in facts.owners(properties, objects_, "m", "at").collect())
    assert got == [("m", 1, "a"), ("m", 5, "a"), ("m", 9, "b"), ("n", 1, None)]
