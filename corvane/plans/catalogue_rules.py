"""More registered queries: structured rules, computed properties, shapes of results, and sums and filters around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import predicates, texts
from corvane.operators import aggregate, metadata, objects, search
from corvane.plans import catalogue, computed, structured
from corvane.plans.catalogue import query
from corvane.sources import properties


def t(spark, sf, name):
    return catalogue.t(spark, sf, name)


# Structured rules


@query("""
WITH a AS (SELECT c_custkey, count(n_nationkey) AS k1, min(n_regionkey) AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey >= 1 GROUP BY 1),
b AS (SELECT c_custkey, k1, count(r_regionkey) AS k2, min(r_name) AS r FROM a LEFT JOIN region ON r_regionkey = region GROUP BY 1, 2)
SELECT c_custkey, CASE WHEN k1 = 1 AND k2 = 1 THEN 'ok' ELSE 'missing' END AS status, CASE WHEN k1 = 1 AND k2 = 1 THEN r END AS value FROM b
""")
def rule_structured(spark, sf):
    rule = structured.Rule(
        (
            structured.Step("nation", "nation", (("n_nationkey", "eq", "{{inputs.nation}}"), ("n_regionkey", "gte", 1)), {"region": "n_regionkey"}),
            structured.Step("region", "region", (("r_regionkey", "eq", "{{steps.nation.region}}"),), {"name": "r_name"}),
        ),
        ("nation",), "name",
    )
    tables = {n: t(spark, sf, n) for n in ("nation", "region")}
    return structured.run(t(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey", rule, tables, {"nation": "c_nationkey"})


@query("""
WITH s AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM orders
  WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT c_custkey, 'ok' AS status, coalesce(n, 0) AS n, round(coalesce(total, 0), 2) AS total, first_at, last_at FROM customer LEFT JOIN s ON o_custkey = c_custkey
""")
def rule_structured_series(spark, sf):
    where = (("o_custkey", "eq", "{{inputs.id}}"), ("o_orderdate", "gte", "1996-01-01"), ("o_orderdate", "lt", "1998-01-01"))
    rule = structured.Rule((structured.Step("orders", "orders", where, {"at": "o_orderdate", "price": "o_totalprice"}, many=True),), ("id",), "price", "at")
    out = structured.run(t(spark, sf, "customer").select("c_custkey"), "c_custkey", rule, {"orders": t(spark, sf, "orders")}, {"id": "c_custkey"})
    total = F.aggregate("series", F.lit(0.0), lambda a, x: a + x["value"])
    ends = [F.try_element_at("series", F.lit(i))["timestamp"].alias(n) for i, n in ((1, "first_at"), (-1, "last_at"))]
    return out.select("c_custkey", "status", F.size("series").cast("long").alias("n"), F.round(total, 2).alias("total"), *ends)


# Computed properties


@query("""
SELECT s_suppkey, s_nationkey, (SELECT round(sum(l_quantity), 2) FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 10 AND l_returnflag <> ':instanceId') AS moved FROM supplier
""")
def computed_property_sql(spark, sf):
    sql = "SELECT round(sum(l_quantity), 2) FROM {lines} WHERE l_suppkey = :instanceId AND l_quantity >= :least AND l_returnflag <> ':instanceId'"
    return computed.sql_property(t(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey", "moved", sql, {"lines": t(spark, sf, "lineitem")}, least=10)


@query("""
SELECT o_orderkey, o_totalprice, o_totalprice / 4 AS quarter, round(((o_totalprice / 4 * 1.5)::VARCHAR)::DECIMAL(38, 18), 3)::DOUBLE AS padded, greatest(o_totalprice / 4, 20000) AS floor_ FROM orders
""")
def computed_property_chain(spark, sf):
    formulas = {"padded": "ROUND({quarter} * 1.5, 3)", "floor_": "MAX({quarter}, 20000)", "quarter": "{o_totalprice} / 4"}
    return computed.calculated(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), formulas).drop("errors")


@query("""
SELECT p_partkey, p_retailprice * p_size AS stock, p_retailprice * p_size - 500 AS net FROM part
""")
def computed_contract(spark, sf):
    parts = {
        "second": (computed.Contract(("stock",), ("net",)), {"net": "{stock} - 500"}),
        "first": (computed.Contract(("p_retailprice", "p_size"), ("stock",)), {"stock": "{p_retailprice} * {p_size}"}),
    }
    return computed.implemented(t(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size"), parts).select("p_partkey", "stock", "net")


# Shapes


@query("""
SELECT 'list' AS kind, count(*) AS n, NULL AS first_name FROM customer WHERE c_nationkey = 3
UNION ALL SELECT 'object', 1, (SELECT c_name FROM customer WHERE c_nationkey = 3 ORDER BY c_acctbal DESC, c_custkey LIMIT 1)
UNION ALL SELECT 'text', 1, (SELECT c_name FROM customer WHERE c_nationkey = 3 ORDER BY c_acctbal DESC, c_custkey LIMIT 1)
UNION ALL SELECT 'none', 1, NULL
""")
def flow_result_shapes(spark, sf):
    c = t(spark, sf, "customer").filter("c_nationkey = 3").select("c_name", "c_acctbal", "c_custkey")
    order = [F.col("c_acctbal").desc(), F.col("c_custkey")]
    n = F.count(F.lit(1)).alias("n")
    every = computed.shaped(c, "list", order).agg(F.lit("list").alias("kind"), n, F.lit(None).cast("string").alias("first_name"))
    one = computed.shaped(c, "object", order).select(F.lit("object").alias("kind"), F.lit(1).cast("long").alias("n"), F.col("c_name").alias("first_name"))
    value = lambda df, kind: computed.shaped(df, "text", order).select(F.lit(kind).alias("kind"), F.lit(1).cast("long").alias("n"), F.col("value").alias("first_name"))
    return every.unionByName(one).unionByName(value(c, "text")).unionByName(value(c.filter("false"), "none"))


@query("SELECT s_suppkey, s_name AS label, s_nationkey + 1 AS nation FROM supplier")
def field_path(spark, sf):
    node = F.struct(F.col("s_name").alias("label"), F.struct((F.col("s_nationkey") + 1).alias("nation")).alias("place"))
    df = t(spark, sf, "supplier").select("s_suppkey", node.alias("out"))
    place = {"type": "object", "fields": [{"id": "f3", "name": "nation", "type": {"type": "number"}}]}
    kind = {"type": "object", "fields": [{"id": "f1", "name": "label", "type": {"type": "text"}}, {"id": "f2", "name": "place", "type": place}]}
    shown = df.select("s_suppkey", computed.field_path("out", kind, ["f1"]).alias("label"), computed.field_path("out", kind, ["f2", "f3"]).alias("nation"), F.lit(0).alias("extra"))
    return computed.declared(shown, ["s_suppkey", "label", "nation"])[0]


@query("SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders) > 20 AS truncated FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def preview_truncated(spark, sf):
    return metadata.preview(t(spark, sf, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])


# Observations and absent values


@query("""
SELECT coalesce(CASE WHEN c_custkey IS NULL THEN 'unknown object' WHEN ts IS NULL THEN 'bad time' WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 'bad value' END, '') AS problem, count(*) AS n, round(sum(CASE WHEN isfinite(v) THEN v END), 2) AS total
FROM (SELECT user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS ts, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE WHEN event_id % 13 = 0 THEN 'inf'::DOUBLE ELSE value END AS v FROM events)
LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = user_id GROUP BY 1
""")
def observation_semi_join(spark, sf):
    value = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 13 == 0, float("inf")).otherwise(F.col("value"))
    e = t(spark, sf, "events").select("user_id", F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("ts"), value.alias("v"))
    out = objects.observed(e, "user_id", F.col("ts"), "v", t(spark, sf, "customer").filter("c_custkey % 3 <> 0"), "c_custkey")
    finite = F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))
    return out.groupBy(F.coalesce("problem", F.lit("")).alias("problem")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(finite), 2).alias("total"))


@query("SELECT c_custkey, n_name AS value FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 2")
def kv_missing_policy(spark, sf):
    store = t(spark, sf, "nation").filter("n_regionkey <> 2").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value"))
    c = t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return properties.present(properties.key_value(c, properties.key_of("nation:{id}", id=F.col("c_nationkey")), store), "value", "null").select("c_custkey", "value")


# Sums, counters and filters


@query("""
WITH r AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, max(n) AS n, count(*) AS n_kept, round(CASE WHEN max(n) < 20 THEN max(l_quantity) ELSE quantile_cont(l_quantity, 0.9) END * 1.25, 6) AS budget FROM r WHERE k <= 20 GROUP BY 1
""")
def calibration_last20(spark, sf):
    order = [F.col(c).desc() for c in ("l_shipdate", "l_orderkey", "l_linenumber")]
    return aggregate.calibrated_last(t(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", order).withColumn("budget", F.round("budget", 6))


@query("SELECT o_orderpriority, count(*) AS n, coalesce(max(o_custkey), 0) + 1 AS next_seq, round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0), 2) AS total FROM orders GROUP BY 1")
def counters(spark, sf):
    o = t(spark, sf, "orders").withColumn("v", F.expr("CASE WHEN o_orderstatus = 'F' THEN o_totalprice END"))
    return aggregate.counters(o, ["o_orderpriority"], "o_custkey", "v").withColumn("total", F.round("total", 2))


@query("SELECT event_type, coalesce(sum(try_cast(json_extract_string(props, '$.k') AS DOUBLE)), 0) AS k, 0.0::DOUBLE AS absent FROM events GROUP BY 1")
def json_field_sum(spark, sf):
    return aggregate.json_sum(t(spark, sf, "events"), ["event_type"], "props", {"k": "$.k", "absent": "$.none"})


@query("SELECT user_id, median(v) AS median, count(v) AS n_known, count(*) AS n FROM (SELECT user_id, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events) GROUP BY 1")
def median_known(spark, sf):
    e = t(spark, sf, "events").select("user_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"))
    return aggregate.median_known(e, ["user_id"], "v")


@query("SELECT c_custkey, CASE WHEN k = 1 THEN c_mktsegment ELSE c_mktsegment || ' (' || k || ')' END AS final FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k FROM customer)")
def name_suffixes(spark, sf):
    return metadata.suffixed(t(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", F.col("c_custkey")).select("c_custkey", "final")


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey % 25 END AS before, CASE WHEN o_orderkey % 9 = 0 THEN 99 ELSE o_orderkey % 25 END AS after,
  CASE WHEN o_orderkey % 9 = 0 THEN 'unknown target' WHEN o_custkey % 4 <> 0 AND o_custkey % 25 = o_orderkey % 25 THEN 'unchanged' ELSE 'ok' END AS status FROM orders
""")
def dry_run_moves(spark, sf):
    o = t(spark, sf, "orders")
    now = o.select("o_orderkey", F.expr("CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 25 END").alias("parent"))
    moves = o.select("o_orderkey", F.expr("CASE WHEN o_orderkey % 9 = 0 THEN 99 ELSE o_orderkey % 25 END").alias("target"))
    known = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("target"))
    return metadata.moved(now, "o_orderkey", "parent", moves, known, "target")


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name || '|' || c_mktsegment), 'build') AND c_acctbal >= 1000.5")
def explorer_filter(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return c.filter(predicates.explored(c, " BUILD ", "c_acctbal", "gte", "1000.5")).select("c_custkey")


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey + 10 AS b FROM part WHERE p_partkey % 30 < 20), walk AS (SELECT a AS node, a AS component FROM e UNION SELECT b, b FROM e
  UNION SELECT CASE WHEN e.a = w.node THEN e.b ELSE e.a END, w.component FROM walk w JOIN e ON w.node = e.a OR w.node = e.b)
SELECT node, min(component) AS component FROM walk GROUP BY 1
""")
def link_components(spark, sf):
    p = t(spark, sf, "part").filter("p_partkey % 30 < 20").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 10).alias("b"))
    return objects.connected(p, "a", "b")


# Paths and JSON arrays


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'a.b' || p_size WHEN 2 THEN 'a.items[' || p_size || ']' WHEN 3 THEN '' ELSE 'x.y[1]' END AS path FROM part
""")
def object_paths(spark, sf):
    key = F.expr("CASE p_partkey % 5 WHEN 0 THEN '$' WHEN 1 THEN concat('$.a.b', p_size, '.leaf') WHEN 2 THEN concat('a.items[', p_size, ']') WHEN 3 THEN '$.leaf' ELSE 'x.y[1].z.' END")
    return t(spark, sf, "part").select("p_partkey", texts.object_path(key).alias("path"))


@query("SELECT event_id, 5 AS length, 'bigint=1,boolean=1,object=1,string=1,void=1' AS types, 'k' AS keys FROM events")
def array_summary(spark, sf):
    c = F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(',"'), F.col("event_type"), F.lit('",true,'), F.col("props"), F.lit(",null]"))
    return t(spark, sf, "events").select("event_id", texts.array_summary(c).alias("s")).select("event_id", "s.*")


# Search


@query("""
WITH d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{3,}'))) AS term FROM documents),
q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{3,}'))) AS term FROM benchmark),
hits AS (SELECT item_id AS query, doc_id AS key, count(*) AS strong_hits FROM q JOIN d USING (term) GROUP BY ALL)
SELECT query, key, strong_hits, 0 AS weak_hits, row_number() OVER (PARTITION BY query ORDER BY strong_hits DESC, key) AS rank FROM hits
QUALIFY rank <= 10
""")
def search_index(spark, sf):
    path = objects.shared_path(spark, "search")
    search.build_index(t(spark, sf, "documents"), "doc_id", "text", path)
    return search.search(spark, path, t(spark, sf, "benchmark"), "item_id", "text")
