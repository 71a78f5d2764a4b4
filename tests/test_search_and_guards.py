import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from corvane.functions import formats, sqltemplate
from corvane.operators import ontology, search

WRITES = ["WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "FROM x INSERT INTO t SELECT *", "WITH x AS (SELECT 1) DELETE FROM t"]


@pytest.mark.parametrize("sql", WRITES)
def test_a_write_behind_a_query_is_refused(spark, sql):
    with pytest.raises((ParseException, sqltemplate.TemplateError)):
        spark.sql(sqltemplate.read_only(sql))


def test_scripts_are_refused():
    with pytest.raises(sqltemplate.TemplateError):
        sqltemplate.read_only("SELECT TRANSFORM(a) USING 'cat' AS b FROM t")


def test_queries_pass(spark):
    for sql in ("SELECT 'insert into; t' AS a -- one", "WITH x AS (SELECT 1 AS a) SELECT a FROM x ORDER BY a;", "FROM VALUES (1) AS t(a) SELECT a", "SELECT a FROM VALUES (1) t(a) JOIN VALUES (1) u(a) USING (a)", "VALUES (1)"):
        assert spark.sql(sqltemplate.read_only(sql)).count() == 1


def test_numbers_are_rounded_before_their_power_is_chosen(spark):
    def shown(x, **style):
        return spark.range(1).select(formats.number(F.lit(x), **style)).first()[0]

    assert [shown(x, style="scientific") for x in (9.996, -9.996, 9.994, 0.0, 123.0, 0.00999999)] == ["1.00E1", "-1.00E1", "9.99E0", "0.00E0", "1.23E2", "1.00E-2"]
    assert [shown(x, style="compact") for x in (999_999.0, -999_999.0, 999.0, 1000.0, 999.999, 999_994.0, 1e15)] == ["1.00M", "-1.00M", "999.00", "1.00K", "1.00K", "999.99K", "1000.00T"]


def test_a_vocabulary_of_ones_own(spark):
    rows = [("valueTypes", "v", "V", None, None, 1), ("objectTypes", "o", "O", None, None, 1)]
    nodes = spark.createDataFrame(rows, "group string, id string, name string, domain string, range string, model int")
    own = ontology.STANDARD | {"valueTypes": "my:Value"}
    assert {r.group for r in ontology.decoded(ontology.encoded(nodes, "model", own), vocabulary=own).collect()} == {"valueTypes", "objectTypes"}


FACTS = [(1, "alpha beta_2 订单金额"), (2, "Alpha alpha 金额"), (3, None), (4, ""), (5, "ab"), (6, "beta_2"), (6, "beta_2"), (7, "客户订单金额汇总表的计算方法说明书"), (8, "beta_2 alpha")]


def test_search_ranks_strong_terms_before_weak_ones(spark, tmp_path):
    facts = spark.createDataFrame(FACTS, "id long, text string").selectExpr("*", "'x' AS term", "1 AS bucket", "'k' AS key")
    search.build_index(facts, "id", "text", f"{tmp_path}/index")
    asked = spark.createDataFrame([("a", "ALPHA beta_2 xy"), ("b", "客户订单金额汇总表的计算方法说明书"), ("c", None), ("d", "金额")], "q string, ask string")
    found = {}
    for r in sorted(search.search(spark, f"{tmp_path}/index", asked, "q", "ask", top=3).collect(), key=lambda r: (r["query"], r["rank"])):
        found.setdefault(r["query"], []).append((r["key"], r["strong_hits"], r["weak_hits"]))
    long = FACTS[7][1]
    pieces = {long[i : i + n] for n in (2, 3) for i in range(len(long) - n + 1)}
    assert found["a"] == [(1, 2, 0), (8, 2, 0), (2, 1, 0)]
    assert found["b"] == [(7, 1, len(pieces)), (1, 0, 5), (2, 0, 1)]
    assert found["d"] == [(2, 1, 0)] and "c" not in found
    search.build_index(facts.limit(0), "id", "text", f"{tmp_path}/empty")
    assert search.search(spark, f"{tmp_path}/empty", asked, "q", "ask").count() == 0


def test_tasks_of_an_index_follow_its_input(spark, tmp_path, monkeypatch):
    """Postings of one bucket and hits of one query go to many tasks when there is much of them; the ranks stay, by either join."""
    from pyspark.sql import functions as F

    facts = spark.range(400).selectExpr("id", "concat('common word', id % 7) AS text")
    asked = spark.createDataFrame([("a", "common word3"), ("b", "word5")], "q string, ask string")
    monkeypatch.setattr(search, "TEXT_A_TASK", 64, raising=False)
    monkeypatch.setattr(search, "PAIRS_A_TASK", 50, raising=False)
    search.build_index(facts, "id", "text", f"{tmp_path}/index")
    postings = spark.read.parquet(f"{tmp_path}/index")
    assert postings.count() == 800
    assert postings.filter("term = 'common'").select(F.input_file_name().alias("f")).distinct().count() > 8
    want = [("a", 3 + 7 * i, 2, i + 1) for i in range(10)] + [("b", 5 + 7 * i, 1, i + 1) for i in range(10)]
    for sent in (1 << 18, 0):
        monkeypatch.setattr(search, "TERMS_SENT", sent, raising=False)
        found = search.search(spark, f"{tmp_path}/index", asked, "q", "ask")
        assert sorted((r["query"], r["key"], r["strong_hits"], r["rank"]) for r in found.collect()) == sorted(want)
