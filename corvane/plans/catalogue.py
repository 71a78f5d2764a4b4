"""The registered queries over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import calc, formats, sqltemplate, texts, valuetypes
from corvane.functions.predicates import Condition, conjunction
from corvane.operators import aggregate, candidates, facts, metadata, objects, ontology
from corvane.plans import flow, rules
from corvane.sources import catalog, materials, properties, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Objects and links


@query("""
SELECT 'shop:Customer:' || c_custkey AS id, 'Customer' AS type, c_custkey::VARCHAR AS source_id, coalesce(c_name, 'shop:Customer:' || c_custkey) AS display_name,
       c_acctbal AS balance, c_mktsegment AS segment FROM customer WHERE c_custkey IS NOT NULL
""")
def object_instances(spark, sf):
    return objects.instances(t(spark, sf, "customer"), "shop", "Customer", "c_custkey", {"balance": "c_acctbal", "segment": "c_mktsegment"}, "c_name")


@query("""
SELECT 'shop:Customer:' || c_custkey AS object_id, 'livesIn' AS relation, 'shop:Nation:' || c_nationkey AS parent_id FROM customer
UNION ALL SELECT 'shop:Supplier:' || s_suppkey, 'basedIn', 'shop:Nation:' || s_nationkey FROM supplier
UNION ALL SELECT 'shop:Nation:' || n_nationkey, 'partOf', 'shop:Region:' || n_regionkey FROM nation
""")
def object_links(spark, sf):
    a = objects.links(t(spark, sf, "customer"), "shop", "Customer", "c_custkey", "livesIn", "c_nationkey", "Nation")
    b = objects.links(t(spark, sf, "supplier"), "shop", "Supplier", "s_suppkey", "basedIn", "s_nationkey", "Nation")
    return a.unionByName(b).unionByName(objects.links(t(spark, sf, "nation"), "shop", "Nation", "n_nationkey", "partOf", "n_regionkey", "Region"))


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)")
def dangling_parents(spark, sf):
    lines = t(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return objects.dangling(lines, "l_partkey", t(spark, sf, "part").filter("p_size <= 40"), "p_partkey")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark, sf):
    return objects.repeated_keys(t(spark, sf, "lineitem"), "l_orderkey")


def _edges(spark, sf):
    tag = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    return (
        t(spark, sf, "nation").select(tag("r", "n_regionkey").alias("parent"), tag("n", "n_nationkey").alias("child"))
        .unionByName(t(spark, sf, "customer").select(tag("n", "c_nationkey").alias("parent"), tag("c", "c_custkey").alias("child")))
        .unionByName(t(spark, sf, "supplier").select(tag("n", "s_nationkey").alias("parent"), tag("s", "s_suppkey").alias("child")))
    )


@query("""
WITH RECURSIVE edges AS (
  SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
), walk AS (SELECT 'r1' AS node, 0 AS depth UNION SELECT child, depth + 1 FROM edges JOIN walk ON parent = node)
SELECT node, min(depth) AS depth FROM walk GROUP BY node
""")
def scope_closure(spark, sf):
    return objects.closure(_edges(spark, sf), spark.sql("SELECT 'r1' AS node"))


@query("""
WITH RECURSIVE a AS (SELECT p_partkey AS key, p_partkey // 2 AS target FROM part WHERE p_partkey > 1), walk AS (
  SELECT key, target FROM a UNION ALL SELECT w.key, a.target FROM walk w JOIN a ON a.key = w.target)
SELECT key, min(target) AS target FROM walk GROUP BY key
""")
def alias_chains(spark, sf):
    return objects.resolve_aliases(t(spark, sf, "part").filter("p_partkey > 1").select(F.col("p_partkey").alias("key"), F.expr("p_partkey div 2").alias("target")))


# Members and verdicts


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' AND o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) AND o_orderdate IS NOT NULL")
def members_eq_in_null(spark, sf):
    orders = t(spark, sf, "orders")
    rule = [Condition("o_orderstatus", "eq", "O"), Condition("o_orderpriority", "ne", "1-URGENT"), Condition("o_custkey", "in", [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]), Condition("o_orderdate", "notnull")]
    return orders.filter(conjunction(orders, rule)).select("o_orderkey", "o_orderpriority")


@query("""
WITH m AS (SELECT c_nationkey, CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 8000),
s AS (SELECT c_nationkey, count(*) AS n, count(*) - count(v) AS missing, sum(v) AS total FROM m GROUP BY 1)
SELECT n_nationkey, n_name, CASE WHEN missing = 0 THEN round(total, 2) END AS total, coalesce(n, 0) AS n_members, coalesce(missing, 0) AS n_missing,
       CASE WHEN n IS NULL THEN 'empty' WHEN missing > 0 THEN 'incomplete' ELSE 'ok' END AS verdict
FROM nation LEFT JOIN s ON n_nationkey = c_nationkey
""")
def relation_sum_verdict(spark, sf):
    customer = t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    rows = customer.filter(conjunction(customer, [Condition("c_mktsegment", "eq", "BUILDING"), Condition("c_acctbal", "gt", 8000)]))
    rows = rows.withColumn("v", F.when(F.col("c_custkey") % 97 != 0, F.col("c_acctbal")))
    out = aggregate.relation_sum(t(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", rows, "c_nationkey", "v")
    return out.withColumn("total", F.round("total", 2))


@query("""
WITH r AS (SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 WHEN c_custkey % 10 = 1 THEN NULL ELSE c_acctbal END FROM customer WHERE c_custkey % 3 = 0)
SELECT c_custkey, min(c_acctbal) AS c_acctbal, count(*) AS n_rows,
       coalesce(min(c_acctbal) <> max(c_acctbal), false) OR (count(c_acctbal) > 0 AND count(c_acctbal) < count(*)) AS conflict FROM r GROUP BY 1
""")
def member_dedupe_conflict(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_acctbal")
    other = F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal") + 1).when(F.col("c_custkey") % 10 != 1, F.col("c_acctbal"))
    return aggregate.deduplicated(c.unionByName(c.filter("c_custkey % 3 = 0").withColumn("c_acctbal", other)), ["c_custkey"], "c_acctbal")


def _owned(spark, sf):
    return aggregate.members(t(spark, sf, "supplier"), {"rich": [Condition("s_acctbal", "gt", 5000)], "low": [Condition("s_nationkey", "lt", 10)], "odd": [Condition("s_nationkey", "in", [1, 3, 5, 7, 9, 11])]})


@query("SELECT s_suppkey, n_owners FROM (SELECT s_suppkey, (s_acctbal > 5000)::BIGINT + (s_nationkey < 10)::BIGINT + (s_nationkey IN (1, 3, 5, 7, 9, 11))::BIGINT AS n_owners FROM supplier) WHERE n_owners > 1")
def ownership_conflict(spark, sf):
    return aggregate.ownership_conflicts(_owned(spark, sf), "s_suppkey")


@query("""
SELECT 'rich' AS instance, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier WHERE s_acctbal > 5000 UNION ALL
SELECT 'low', count(*), round(sum(s_acctbal), 2) FROM supplier WHERE s_nationkey < 10 UNION ALL SELECT 'odd', count(*), round(sum(s_acctbal), 2) FROM supplier WHERE s_nationkey IN (1, 3, 5, 7, 9, 11)
""")
def membership_join(spark, sf):
    return _owned(spark, sf).groupBy("instance").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 5000 OR s_nationkey < 10")
def union_of_rules(spark, sf):
    s = t(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    return aggregate.union_members([s.filter("s_acctbal > 5000"), s.filter("s_nationkey < 10")], "s_suppkey").select("s_suppkey", "s_name")


@query("""
SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
""")
def group_marginals(spark, sf):
    return aggregate.marginals(t(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"])


@query("""
SELECT event_type, CASE WHEN count(*) = count(v) THEN round(sum(v), 4) END AS total, round(coalesce(sum(v), 0), 4) AS known_total, count(*) - count(v) AS n_unknown
FROM (SELECT event_type, CASE WHEN event_type <> 'view' AND event_id % 50 = 0 THEN NULL ELSE value END AS v FROM events) GROUP BY 1
""")
def usage_unknown_null(spark, sf):
    e = t(spark, sf, "events").select("event_type", F.when(~((F.col("event_type") != "view") & (F.col("event_id") % 50 == 0)), F.col("value")).alias("v"))
    return aggregate.null_if_unknown(e, ["event_type"], "v").select("event_type", F.round("total", 4).alias("total"), F.round("known_total", 4).alias("known_total"), "n_unknown")


@query("SELECT l_suppkey, count(l_quantity) AS n, round(CASE WHEN count(l_quantity) < 20 THEN max(l_quantity) ELSE quantile_cont(l_quantity, 0.9) END * 1.25, 6) AS budget FROM lineitem GROUP BY 1")
def calibration_p90(spark, sf):
    return aggregate.calibrated(t(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity").withColumn("budget", F.round("budget", 6))


# Observations


@query("""
WITH r AS (SELECT user_id, ts, value, rank() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events WHERE ts <= (SELECT min(ts) FROM events) + INTERVAL 20 DAY)
SELECT user_id, max(ts) AS ts, max(value) AS value, count(*) AS n_ties FROM r WHERE k = 1 GROUP BY 1
""")
def asof_latest(spark, sf):
    e = t(spark, sf, "events")
    start = e.agg(F.min("ts").alias("m")).first()["m"]
    return objects.as_of(e, "user_id", "ts", "value", F.lit(start) + F.expr("INTERVAL 20 DAYS"))


@query("""
WITH latest AS (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY 1, 2), a AS (SELECT event_type, date_diff('second', ts, TIMESTAMP '2024-02-01 00:00:00') AS age FROM latest)
SELECT event_type, count(*) AS n_members, max(age) AS oldest_age, max(age) - min(age) AS spread,
       CASE WHEN max(age) > 864000 THEN 'stale' WHEN max(age) - min(age) > 3600 THEN 'misaligned' ELSE 'ok' END AS verdict FROM a GROUP BY 1
""")
def asof_freshness_tolerance(spark, sf):
    latest = t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.date_trunc("second", F.max("ts")).cast("timestamp_ntz").alias("ts"))
    return objects.freshness(latest, "ts", "2024-02-01 00:00:00", 864_000, "event_type", 3600)


@query("""
SELECT l_returnflag, count(*) AS n, count(*) FILTER (NOT (l_discount * 100 BETWEEN 0 AND 100 AND l_quantity > 0)) AS n_bad, round(sum(l_discount * 100 * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY 1
""")
def weighted_mean_metric(spark, sf):
    lines = t(spark, sf, "lineitem").select("l_returnflag", (F.col("l_discount") * 100).alias("v"), "l_quantity")
    return objects.weighted_mean(lines, ["l_returnflag"], "v", "l_quantity").withColumn("mean", F.round("mean", 6))


# Property sources


@query("SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1")
def source_latest_tiebreak(spark, sf):
    return properties.latest(t(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderdate", "o_orderkey")


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1")
def source_sum(spark, sf):
    return properties.total(t(spark, sf, "orders"), "o_custkey", "o_totalprice").withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("SELECT o_custkey, round(avg(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1")
def source_average(spark, sf):
    return properties.average(t(spark, sf, "orders"), "o_custkey", "o_totalprice").withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("""
SELECT user_id, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S') || '=' || event_id, ';' ORDER BY ts DESC, event_id DESC) AS series FROM events
WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-10' GROUP BY 1
""")
def source_timeseries_range(spark, sf):
    s = properties.time_series(t(spark, sf, "events"), "user_id", "ts", "event_id", "2024-01-03 00:00:00", "2024-01-10 00:00:00", descending=True)
    shown = F.transform("series", lambda p: F.concat(F.date_format(p["timestamp"], "yyyy-MM-dd HH:mm:ss"), F.lit("="), p["value"].cast("string")))
    return s.select("user_id", F.array_join(shown, ";").alias("series"))


@query("""
SELECT event_type, hour, event_id, n_at_time FROM (SELECT event_type, date_trunc('hour', ts) AS hour, event_id, count(*) OVER w AS n_at_time, row_number() OVER (w ORDER BY value DESC, event_id) AS k
FROM events WINDOW w AS (PARTITION BY event_type, date_trunc('hour', ts))) WHERE k = 1
""")
def source_timeseries_duplicate(spark, sf):
    e = t(spark, sf, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return properties.one_per_time(e, ["event_type"], "hour", F.struct(-F.col("value"), F.col("event_id"))).select("event_type", "hour", "event_id", "n_at_time")


@query("""
SELECT event_id, date_trunc('second', ts) AS from_seconds, date_trunc('millisecond', ts) AS from_millis, date_trunc('second', ts) - INTERVAL 8 HOUR AS from_zone FROM events
""")
def source_epoch_encoding(spark, sf):
    e = t(spark, sf, "events").withColumn("u", F.col("ts").cast("timestamp"))
    ntz = lambda c, encoding, zone="UTC": properties.time_of(c, encoding, zone).cast("timestamp_ntz")
    return e.select(
        "event_id", ntz(F.unix_seconds("u"), "epochSeconds").alias("from_seconds"), ntz(F.unix_millis("u"), "epochMillis").alias("from_millis"),
        ntz(F.date_trunc("second", "u"), "datetime", "Asia/Shanghai").alias("from_zone"),
    )


@query("SELECT o_orderkey, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def source_match_property(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    with_nation = properties.related(o, "o_custkey", t(spark, sf, "customer"), "c_custkey", "c_nationkey", "nation_key")
    return properties.related(with_nation, "nation_key", t(spark, sf, "nation"), "n_nationkey", "n_name", "n_name").select("o_orderkey", "n_name")


@query("""
SELECT u.user_id, try_cast(e.props->>'k' AS BIGINT) AS value FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN events e ON e.event_id = u.user_id * 7
""")
def kv_row_lookup(spark, sf):
    e = t(spark, sf, "events")
    store = e.select(F.concat(F.lit("event:"), F.col("event_id").cast("string"), F.lit(":props")).alias("key"), F.from_json("props", "map<string,string>").alias("fields"))
    users = e.select("user_id").distinct()
    return properties.key_value(users, properties.key_of("event:{id}:props", id=F.col("user_id") * 7), store, "integer", field="k")


@query("SELECT event_id, list_sort(json_keys(props)) AS keys, len(json_keys(props)) AS n FROM events")
def kv_hash_reads(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("fields"))
    return e.select("event_id", properties.READS["HKEYS"](F.col("fields")).alias("keys"), properties.READS["HLEN"](F.col("fields")).cast("long").alias("n"))


@query("SELECT * FROM (VALUES ('plant-a', 'Plant A', 2::BIGINT), ('plant-b', 'Plant B', 2::BIGINT)) AS v(id, label, n_words)")
def registered_instances(spark, sf):
    return properties.registered(spark, [("plant-a", "Plant A"), ("plant-b", "Plant B")]).withColumn("n_words", F.size(F.split("label", " ")).cast("long"))


# Rules and templates


def _views(spark, sf, *names):
    for n in names:
        t(spark, sf, n).createOrReplaceTempView(n)


@query("SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region WHERE r_regionkey = 2))")
def rule_chained_steps(spark, sf):
    _views(spark, sf, "region", "nation", "customer")
    text = """
-- @step area one
SELECT r_regionkey FROM region WHERE r_regionkey = :region
-- @step first one
SELECT min(n_nationkey) AS n_nationkey FROM nation WHERE n_regionkey = :area.r_regionkey
-- @step people many
SELECT c_custkey, c_name FROM customer WHERE c_nationkey = :first.n_nationkey
"""
    return rules.Rule(rules.steps_of(text)).run(spark, region=2)


@query("SELECT s_suppkey AS key, s_name AS name FROM supplier WHERE s_acctbal > 9000")
def rule_dynamic_identifier(spark, sf):
    _views(spark, sf, "supplier")
    where = "SELECT 'supplier' AS tab, 's_suppkey' AS k, 's_name' AS v, 's_acctbal' AS f"
    steps = [rules.Step("place", where), rules.Step("rows", "SELECT {{place.k}} AS key, {{place.v}} AS name FROM {{place.tab}} WHERE {{place.f}} > :least", many=True)]
    return rules.Rule(steps).run(spark, least=9000)


def _template(spark, sf, template, **params):
    _views(spark, sf, "orders", "lineitem")
    return sqltemplate.run(spark, template, params)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 150000 AND o_orderstatus = 'F'")
def template_if_where(spark, sf):
    sql = """SELECT o_orderkey, o_totalprice FROM orders <where><if test="custkey">AND o_custkey = #{custkey}</if>
      <if test="least != null and least > 0">AND o_totalprice >= #{least}</if><if test="status == 'F' or status == 'O'"> AND o_orderstatus = #{status}</if></where>"""
    return _template(spark, sf, sql, custkey=None, least=150000.0, status="F")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY 1")
def template_choose(spark, sf):
    sql = """SELECT o_orderstatus, count(*) AS n FROM orders WHERE <choose><when test="mode == 'all'">1 = 1</when><when test="before">o_orderdate < cast(#{before} AS TIMESTAMP_NTZ)</when>
      <otherwise>1 = 0</otherwise></choose> GROUP BY o_orderstatus"""
    return _template(spark, sf, sql, mode="some", before="1995-01-01 00:00:00")


@query("SELECT l_shipdate, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linenumber IN (1, 7) AND l_quantity > 49")
def template_foreach(spark, sf):
    sql = """SELECT ${a}, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN <foreach collection="flags" item="f" open="(" close=")">#{f}</foreach>
      AND l_linenumber IN <foreach collection="numbers" item="n" open="(" close=")" separator=",">#{n}</foreach> AND l_quantity > #{q}"""
    return _template(spark, sf, sql, a="l_shipdate", flags=["A", "R"], numbers=[1, 7], q=49)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag, l_linestatus")
def template_trim_set(spark, sf):
    sql = """SELECT <trim suffixOverrides=",">l_returnflag, <if test="status">l_linestatus,</if></trim>, count(*) AS n FROM lineitem
      <trim prefix="WHERE" prefixOverrides="AND | OR">AND l_discount > #{d}</trim> GROUP BY <trim suffixOverrides=",">l_returnflag, <if test="status">l_linestatus,</if></trim>"""
    return _template(spark, sf, sql, status=True, d=0.05)


# Formulas


def _lines(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


NAMES = {"q": "l_quantity", "p": "l_extendedprice", "d": "l_discount", "t": "l_tax"}


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS v FROM lineitem")
def calc_arith(spark, sf):
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", F.round(calc.strict("{p} * (1 - {d}) * (1 + {t})", NAMES), 6).alias("v"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN round(l_tax / l_discount, 6) ELSE -1.0::DOUBLE END AS v FROM lineitem")
def calc_if_lazy(spark, sf):
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", F.round(calc.strict("IF({d} > 0, {t} / {d}, -1)", NAMES), 6).alias("v"))


@query("SELECT l_orderkey, l_linenumber, least(l_quantity, round(abs(l_extendedprice - 30000) / 1000, 0), greatest(l_discount * 100, l_tax * 100)) AS v FROM lineitem")
def calc_minmax_abs_round(spark, sf):
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", calc.strict("MIN({q}, ROUND(ABS({p} - 30000) / 1000), MAX({d} * 100, {t} * 100))", NAMES).alias("v"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 45 AND l_discount > 0 THEN round(l_tax / l_discount, 6) END AS v,
       CASE WHEN l_quantity > 45 THEN 'too many' WHEN l_discount = 0 THEN 'division by zero' END AS error FROM lineitem
""")
def calc_error_collect(spark, sf):
    got = calc.collect('IF({q} > 45, ERROR("too many"), {t} / {d})', NAMES)
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", got.alias("r")).select("l_orderkey", "l_linenumber", F.round("r.value", 6).alias("v"), F.col("r.error").alias("error"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 'division by zero' WHEN l_quantity > 45 THEN 'too many' END AS error,
       CASE WHEN l_discount > 0 AND l_quantity <= 45 THEN round(least(l_tax / abs(l_discount), 1.5), 6) END AS v FROM lineitem
""")
def calc_collect_nested(spark, sf):
    got = calc.collect('MIN({t} / ABS({d}), IF({q} > 45, ERROR("too many"), 1.5))', NAMES)
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", got.alias("r")).select("l_orderkey", "l_linenumber", F.round("r.value", 6).alias("v"), F.col("r.error").alias("error"))


# Constraints


def _broken(df, key, errors):
    return df.select(key, F.array_join(errors, ";").alias("errors")).filter("errors <> ''")


@query("SELECT p_partkey, CASE WHEN p_size < 5 THEN 'too small' ELSE 'too large' END AS errors FROM part WHERE p_size < 5 OR p_size >= 45")
def value_range(spark, sf):
    return _broken(t(spark, sf, "part"), "p_partkey", valuetypes.in_range(F.col("p_size"), 5, 45, high_in=False))


@query("SELECT c_custkey, 'not in list' AS errors FROM customer WHERE lower(c_mktsegment) NOT IN ('building', 'machinery')")
def value_enum(spark, sf):
    return _broken(t(spark, sf, "customer"), "c_custkey", valuetypes.one_of(F.col("c_mktsegment"), ["Building", "MACHINERY"], ignore_case=True))


@query("SELECT p_partkey, 'no match' AS errors FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#[1-3][0-9]')")
def value_regex(spark, sf):
    return _broken(t(spark, sf, "part"), "p_partkey", valuetypes.matches(F.col("p_brand"), "Brand#[1-3][0-9]"))


@query("""
SELECT doc_id, 'not a uuid' AS errors FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(text) ELSE regexp_replace(md5(text), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') END AS u FROM documents)
WHERE NOT regexp_full_match(u, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}')
""")
def value_uuid(spark, sf):
    h = F.md5("text")
    u = F.when(F.col("doc_id") % 3 == 0, h).otherwise(F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    return _broken(t(spark, sf, "documents").withColumn("u", u), "doc_id", valuetypes.uuid(F.col("u")))


@query("""
WITH x AS (SELECT vec_id, list_concat(CASE WHEN len(embedding) > 8 THEN ['too many'] ELSE [] END, CASE WHEN len(list_distinct(embedding)) < len(embedding) THEN ['not unique'] ELSE [] END,
  [CASE WHEN embedding[i] > 0 THEN '[' || (i - 1) || '] too large' END FOR i IN range(1, len(embedding) + 1) IF embedding[i] > 0]) AS found FROM embeddings)
SELECT vec_id, array_to_string(found[1:20], ';') AS errors FROM x WHERE len(found) > 0
""")
def value_array(spark, sf):
    checked = valuetypes.array(F.col("embedding"), most=8, unique=True, each=lambda x: valuetypes.in_range(x, high=0))
    return _broken(t(spark, sf, "embeddings"), "vec_id", checked)


@query("""
SELECT o_orderkey, concat_ws(';', CASE WHEN o_totalprice > 100000 THEN 'price: too large' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status: not in list' END) AS errors
FROM orders WHERE o_totalprice > 100000 OR o_orderstatus NOT IN ('O', 'F')
""")
def value_struct(spark, sf):
    s = F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    check = valuetypes.struct(F.col("s"), ["price"], {"price": lambda c: valuetypes.in_range(c, high=100_000), "status": lambda c: valuetypes.one_of(c, ["O", "F"])})
    return _broken(t(spark, sf, "orders").withColumn("s", s), "o_orderkey", check)


# Formats


@query("SELECT o_orderkey, format('{:,.2f}', round(o_totalprice, 2)) || ' kW' AS shown FROM orders")
def format_number(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", formats.number(F.col("o_totalprice"), suffix=" kW").alias("shown"))


@query("SELECT l_orderkey, l_linenumber, format('{:.1f}', round(l_discount * 100, 1)) || '%' AS shown FROM lineitem")
def format_percent(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", formats.number(F.col("l_discount"), "percent", 1).alias("shown"))


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)) ELSE left(c_name, 2) || repeat('*', length(c_name) - 4) || right(c_name, 2) END AS shown FROM customer")
def format_text_mask(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", formats.masked(F.col("c_name")).alias("shown"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE o_orderstatus END AS shown FROM orders")
def format_mapping(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", formats.mapping(F.col("o_orderstatus"), {"O": "open", "F": "done"}).alias("shown"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS shown FROM orders")
def format_date(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", formats.date(F.col("o_orderdate"), "DD/MM/YYYY").alias("shown"))


@query("SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS shown FROM events")
def format_time_zone(spark, sf):
    return t(spark, sf, "events").select("event_id", formats.time(F.col("ts")).alias("shown"))


@query("SELECT o_custkey, CASE WHEN len(k) > 3 THEN array_to_string(k[1:3], ', ') || ' … +' || (len(k) - 3) ELSE array_to_string(k, ', ') END AS shown FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k FROM orders GROUP BY 1)")
def format_array(spark, sf):
    keys = t(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("k"))
    return keys.select("o_custkey", formats.listed(F.col("k"), most=3).alias("shown"))


@query("SELECT n_nationkey, 'n_name: ' || n_name || ', n_regionkey: ' || n_regionkey AS shown FROM nation")
def format_struct(spark, sf):
    n = t(spark, sf, "nation")
    return n.select("n_nationkey", formats.pairs(F.struct("n_name", "n_regionkey"), ["n_name", "n_regionkey"]).alias("shown"))


@query("""
SELECT user_id, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S') || '  ' || format('{:,.2f}', round(value, 2)), chr(10) ORDER BY ts, value) AS shown FROM events
WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-05' GROUP BY 1
""")
def format_series(spark, sf):
    s = properties.time_series(t(spark, sf, "events"), "user_id", "ts", "value", "2024-01-03 00:00:00", "2024-01-05 00:00:00")
    return s.select("user_id", formats.series(F.col("series")).alias("shown"))


# Flows


@query("""
SELECT u.user_id, n, round(total / n, 6) AS mean, try_cast(props->>'k' AS DOUBLE) AS label FROM (SELECT user_id, count(*)::DOUBLE AS n, sum(value) AS total FROM events WHERE value > 10 GROUP BY 1) u
LEFT JOIN events e ON e.event_id = u.user_id
""")
def flow_sql_calc_kv(spark, sf):
    e = t(spark, sf, "events")
    store = e.select(F.concat(F.lit("u:"), F.col("event_id").cast("string")).alias("key"), F.get_json_object("props", "$.k").alias("value"))
    nodes = [
        flow.Node("stats", "sql", ["events"], {"template": "SELECT user_id, cast(count(*) AS DOUBLE) AS n, sum(value) AS total FROM {events} <where><if test=\"least\">value > #{least}</if></where> GROUP BY user_id"}),
        flow.Node("rated", "calc", ["stats"], {"outputs": {"mean": "{total} / {n}"}}),
        flow.Node("named", "kv", ["rated", "store"], {"key": "u:{user_id}", "conversion": "number", "as": "label"}),
        flow.Node("broken", "sql", ["events"], {"template": "SELECT missing_column FROM {events}"}),
        flow.Node("after", "calc", ["broken"], {"outputs": {"x": "1 + 1"}}),
    ]
    out = flow.run(spark, nodes, {"least": 10}, {"events": e, "store": store})
    assert (out["broken"].status, out["after"].status) == ("failed", "skipped")
    return out["named"].data.select("user_id", "n", F.round("mean", 6).alias("mean"), "label")


# Metadata


@query("SELECT coalesce(nullif(split_part(u, '/', 1), u), '') AS folder, count(*) AS n, sum(strlen(html))::BIGINT AS bytes FROM (SELECT regexp_replace(url, '^[a-z]+://', '') AS u, html FROM pages) GROUP BY 1")
def folder_rollup(spark, sf):
    p = t(spark, sf, "pages").withColumn("u", F.regexp_replace("url", "^[a-z]+://", ""))
    return metadata.folder_counts(p, F.col("u"), F.octet_length("html").cast("long"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 50")
def keyset_page(spark, sf):
    return metadata.keyset_page(t(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 100, 50)


@query("SELECT c_custkey, c_acctbal, (SELECT count(*) FROM customer) > 60 AS has_more FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def offset_page_lookahead(spark, sf):
    return metadata.page(t(spark, sf, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], 40, 20)


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a')")
def definition_search(spark, sf):
    return metadata.search(t(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "A")


@query("""
WITH o AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 11 <> 0), n AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 13 <> 0)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'removed' WHEN o.c_acctbal <> n.c_acctbal THEN 'changed' ELSE 'kept' END AS change
FROM o FULL JOIN n ON o.c_custkey = n.c_custkey
""")
def version_diff(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.filter("c_custkey % 13 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return metadata.version_diff(c.filter("c_custkey % 11 <> 0"), new, "c_custkey", ["c_name", "c_acctbal"])


def _broken_refs(spark, sf, least):
    c, s = t(spark, sf, "customer"), t(spark, sf, "supplier")
    nations = t(spark, sf, "nation").filter(F.col("n_nationkey") >= least)
    return metadata.broken_references([("customer.nation", c, "c_custkey", "c_nationkey"), ("supplier.nation", s, "s_suppkey", "s_nationkey")], {"nation": (nations, "n_nationkey")})


@query("""
SELECT slot, owner, target, row_number() OVER (PARTITION BY slot, target ORDER BY owner) - 1 AS occurrence FROM (
  SELECT 'customer.nation' AS slot, c_custkey::VARCHAR AS owner, c_nationkey::VARCHAR AS target FROM customer WHERE c_nationkey < 3
  UNION ALL SELECT 'supplier.nation', s_suppkey::VARCHAR, s_nationkey::VARCHAR FROM supplier WHERE s_nationkey < 3)
""")
def broken_refs(spark, sf):
    return metadata.numbered(_broken_refs(spark, sf, 3)).withColumn("occurrence", F.col("occurrence").cast("long"))


@query("SELECT 'customer.nation' AS slot, c_custkey::VARCHAR AS owner, c_nationkey::VARCHAR AS target FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'supplier.nation', s_suppkey::VARCHAR, s_nationkey::VARCHAR FROM supplier WHERE s_nationkey = 3")
def new_broken_refs(spark, sf):
    return metadata.newly_broken(_broken_refs(spark, sf, 3), _broken_refs(spark, sf, 4))


@query("""
WITH b AS (SELECT l_orderkey || ':' || l_linenumber AS binding_id, l_partkey, l_suppkey FROM lineitem)
SELECT 'part:' || p_partkey AS change_id, binding_id FROM part JOIN b ON p_partkey = l_partkey
UNION SELECT 'supplier:' || s_suppkey, binding_id FROM supplier JOIN b ON s_suppkey = l_suppkey
""")
def impact_join(spark, sf):
    named = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("change_id")
    parts = t(spark, sf, "part").select(named("part", "p_partkey"), F.col("p_partkey").alias("part"), F.lit(None).cast("long").alias("supplier"))
    suppliers = t(spark, sf, "supplier").select(named("supplier", "s_suppkey"), F.lit(None).cast("long").alias("part"), F.col("s_suppkey").alias("supplier"))
    bindings = t(spark, sf, "lineitem").select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("binding_id"), "l_partkey", "l_suppkey")
    return metadata.impact(parts.unionByName(suppliers), bindings, [("part", "l_partkey"), ("supplier", "l_suppkey")])


@query("""
WITH v AS (SELECT p_brand, max((p_size // 10, p_size, p_partkey % 12)) AS m FROM part GROUP BY 1) SELECT p_brand, m[1] || '.' || m[2] || '.' || (m[3] + 1) AS next_version FROM v
""".replace("max((p_size // 10, p_size, p_partkey % 12))", "max([p_size // 10, p_size, p_partkey % 12])"))
def next_version(spark, sf):
    v = F.concat_ws(".", F.expr("p_size div 10").cast("string"), F.col("p_size").cast("string"), (F.col("p_partkey") % 12).cast("string"))
    return metadata.next_version(t(spark, sf, "part").withColumn("version", v), "p_brand", "version")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1")
def snapshot_latest(spark, sf):
    return metadata.heads(t(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn")


@query("""
WITH e AS (SELECT l_partkey AS k FROM lineitem WHERE l_linestatus = 'F'), g AS (SELECT l_partkey AS k FROM lineitem WHERE l_linestatus <> 'F'),
x AS (SELECT k, sum(e)::BIGINT AS n_expected, sum(g)::BIGINT AS n_got FROM (SELECT k, 1 AS e, 0 AS g FROM e UNION ALL SELECT k, 0, 1 FROM g) GROUP BY k)
SELECT *, CASE WHEN n_got = 0 THEN 'missing' WHEN n_expected = 0 THEN 'extra' WHEN n_got > n_expected THEN 'duplicate' ELSE 'missing' END AS problem FROM x WHERE n_expected <> n_got
""")
def coverage_multiset(spark, sf):
    lines = t(spark, sf, "lineitem")
    part = lambda rule: lines.filter(rule).select(F.col("l_partkey").alias("k"))
    return metadata.coverage(part("l_linestatus = 'F'"), part("l_linestatus <> 'F'"), "k")


@query("SELECT c_custkey, coalesce(n_name, c_mktsegment) AS label FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON c_nationkey = n_nationkey")
def shared_inheritance(spark, sf):
    own = t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("shared_id"), F.col("c_mktsegment").alias("label"))
    shared = t(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))
    return metadata.inherited(own, shared, ["label"]).select("c_custkey", "label")


# Facts

INCLUDE, EXCLUDE = ["licen", "@mail"], ["cookie", "der die"]


@query("""
WITH d AS (SELECT doc_id, source, text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) < doc_id AS dup, regexp_matches(lower(text), 'licen|@mail') AS i, regexp_matches(lower(text), 'cookie|der die') AS x FROM documents),
s AS (SELECT *, CASE WHEN i AND dup THEN 'related' WHEN i THEN 'relevant' WHEN x THEN 'excluded' END AS scope FROM d),
n AS (SELECT source, count(*) AS n FROM s WHERE scope = 'relevant' GROUP BY 1),
f AS (SELECT doc_id, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY s.source ORDER BY doc_id) AS k FROM s LEFT JOIN n USING (source) WHERE scope IS NULL)
SELECT doc_id, scope FROM s WHERE scope IS NOT NULL UNION ALL SELECT doc_id, CASE WHEN k <= n * 5 THEN 'related' ELSE 'other' END FROM f
""")
def scope_select(spark, sf):
    return facts.select_scope(t(spark, sf, "documents"), "doc_id", "text", "source", INCLUDE, EXCLUDE)


@query("SELECT doc_id, min(doc_id) OVER w AS first_key, min(doc_id) OVER w <> doc_id AS is_duplicate FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))")
def snippet_duplicates(spark, sf):
    return facts.duplicates(t(spark, sf, "documents"), "doc_id", "text", "doc_id")


@query("""
SELECT lower(trim(regexp_replace(regexp_replace(p_type, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^\\p{L}\\p{N}]+', '_', 'g'), '_')) AS name, p_brand AS kind, list(DISTINCT p_partkey ORDER BY p_partkey)::VARCHAR AS evidence, count(*) AS n,
       min(p_size) AS lowest, max(p_size) AS highest, min(p_size) < max(p_size) AS conflict FROM part GROUP BY 1, 2
""")
def align_groups(spark, sf):
    out = facts.aligned(t(spark, sf, "part"), "p_type", "p_brand", "p_partkey", "p_size")
    return out.withColumn("evidence", F.concat(F.lit("["), F.array_join(F.transform("evidence", lambda x: x.cast("string")), ", "), F.lit("]")))


@query("""
WITH a AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run FROM a)
SELECT user_id, run, min(event_type) AS kind, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM b GROUP BY 1, 2
""")
def adjacent_windows(spark, sf):
    return facts.adjacent_groups(t(spark, sf, "events"), "user_id", "event_id", F.col("event_type"))


@query("""
WITH p AS (SELECT user_id, event_id FROM events WHERE event_type <> 'purchase'), o AS (SELECT user_id, event_id FROM events WHERE event_type = 'purchase')
SELECT user_id, event_id, coalesce((SELECT max(o.event_id) FROM o WHERE o.user_id = p.user_id AND o.event_id <= p.event_id), (SELECT min(o.event_id) FROM o WHERE o.user_id = p.user_id AND o.event_id > p.event_id))::VARCHAR AS owner FROM p
""")
def owner_resolution(spark, sf):
    e = t(spark, sf, "events")
    return facts.owners(e.filter("event_type <> 'purchase'"), e.filter("event_type = 'purchase'").withColumn("object", F.col("event_id").cast("string")), "user_id", "event_id")


@query("""
WITH x AS (SELECT toxic = 1 AS t, quality = 1 AS p FROM labels), c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM x)
SELECT tp, fp, fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM c
""")
def precision_recall(spark, sf):
    return facts.precision_recall(t(spark, sf, "labels"), F.col("toxic") == 1, F.col("quality") == 1)


@query("""
WITH g AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey) AS k FROM lineitem WHERE l_linestatus = 'F'), f AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey) AS k FROM lineitem WHERE l_linestatus <> 'F')
SELECT coalesce(g.l_partkey, f.l_partkey) AS l_partkey, coalesce(g.k, f.k) AS k, CASE WHEN g.k IS NOT NULL AND f.k IS NOT NULL THEN 'hit' WHEN g.k IS NOT NULL THEN 'missed' ELSE 'extra' END AS outcome
FROM g FULL JOIN f ON g.l_partkey = f.l_partkey AND g.k = f.k
""")
def golden_matching(spark, sf):
    lines = t(spark, sf, "lineitem")
    out = facts.matched_golden(lines.filter("l_linestatus = 'F'"), lines.filter("l_linestatus <> 'F'"), ["l_partkey"])
    return out.withColumn("k", F.col("k").cast("long"))


@query("""
WITH o AS (SELECT p_partkey, p_size AS s, p_size > 48 AS ex FROM part WHERE p_partkey % 5 <> 0), n AS (SELECT p_partkey, p_size + (p_partkey % 4 = 0)::INT AS s FROM part WHERE p_partkey % 7 <> 0)
SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN coalesce(ex, false) THEN 'excluded' WHEN o.s IS NULL THEN 'added' WHEN n.s IS NULL THEN 'removed' WHEN o.s <> n.s THEN 'changed' ELSE 'kept' END AS change
FROM o FULL JOIN n ON o.p_partkey = n.p_partkey
""")
def batch_diff(spark, sf):
    p = t(spark, sf, "part")
    old = p.filter("p_partkey % 5 <> 0").select("p_partkey", F.col("p_size").alias("s"), (F.col("p_size") > 48).alias("excluded"))
    new = p.filter("p_partkey % 7 <> 0").select("p_partkey", (F.col("p_size") + (F.col("p_partkey") % 4 == 0).cast("int")).alias("s"))
    return facts.batch_diff(old, new, "p_partkey", "s")


@query("""
WITH RECURSIVE d AS (SELECT source, doc_id, n_chars AS size, greatest(coalesce(n_chars, 0), 1) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id, n_chars) AS i FROM documents),
w AS (SELECT source, i, 0 AS batch, n AS used FROM d WHERE i = 1 UNION ALL
  SELECT d.source, d.i, CASE WHEN used + n > 20000 THEN batch + 1 ELSE batch END, CASE WHEN used + n > 20000 THEN n ELSE used + n END FROM w JOIN d ON d.source IS NOT DISTINCT FROM w.source AND d.i = w.i + 1)
SELECT d.source, doc_id, size, batch FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source AND d.i = w.i
""")
def greedy_packing(spark, sf):
    docs = t(spark, sf, "documents").select("source", "doc_id", F.col("n_chars").alias("size"))
    return facts.packed(docs, "source", "doc_id", "size", 20_000)


@query("SELECT event_id, 'k' AS path, props->>'k' AS value FROM events")
def json_paths(spark, sf):
    return materials.json_leaves(t(spark, sf, "events"), "event_id", "props")


@query("""
SELECT 'p_partkey' AS "column", count(p_partkey) AS non_empty, 'integer' AS type, min(p_partkey::VARCHAR) AS sample FROM part UNION ALL SELECT 'p_name', count(p_name), 'text', min(p_name) FROM part
UNION ALL SELECT 'p_brand', count(p_brand), 'text', min(p_brand) FROM part UNION ALL SELECT 'p_type', count(p_type), 'text', min(p_type) FROM part
UNION ALL SELECT 'p_size', count(p_size), 'integer', min(p_size::VARCHAR) FROM part UNION ALL SELECT 'p_retailprice', count(p_retailprice), 'number', min(p_retailprice::VARCHAR) FROM part
""")
def csv_profile(spark, sf):
    return materials.csv_profile(t(spark, sf, "part"))


MATERIAL = {
    "db/shop.sql": "CREATE TABLE log (\n  id BIGINT PRIMARY KEY,\n  device VARCHAR(64) NOT NULL,\n  note TEXT,\n  UNIQUE KEY u (device)\n);\n",
    "docs/readme.md": "# Title\n\n| a | b |\n|---|---|\n| 1 | 2 |\n[site](http://x.test)\n```sql\nSELECT 1\n```\n## Part\n",
    "conf/app.ini": "[db]\nhost = h\nport = 1\n",
    "conf/a.json": '{"a": {"b": [1, {"c": null}]}, "@graph": [{"@id": "x", "@type": "Node", "name": "n"}]}',
    "conf/b.toml": "x = 1\n[t]\ny = 'z'\n",
    "data/t.csv": "id;name\n1;a\n2;b\n3\n",
    "bad.json": "{",
}


def _facts(spark, kinds):
    files = spark.createDataFrame([(p, c.encode()) for p, c in MATERIAL.items()], "path string, content binary")
    return materials.facts(files).filter(F.col("kind").isin(*kinds))


@query("""SELECT * FROM (VALUES ('db/shop.sql', 'table', 'log', 1, '""', 'high'), ('db/shop.sql', 'column', 'log.id', 2, '{"nullable": false, "primary": true, "type": "bigint"}', 'high'),
('db/shop.sql', 'column', 'log.device', 3, '{"nullable": false, "primary": false, "type": "varchar(64)"}', 'high'), ('db/shop.sql', 'column', 'log.note', 4, '{"nullable": true, "primary": false, "type": "text"}', 'high'),
('db/shop.sql', 'key', 'log', 5, '{"columns": ["device"], "kind": "unique"}', 'high')) AS v(path, kind, name, line, data, quality)""")
def ddl_facts(spark, sf):
    return _facts(spark, ["table", "column", "key"]).filter("path LIKE 'db/%'")


@query("""SELECT * FROM (VALUES ('docs/readme.md', 'heading', 'Title', 1, '1', 'high'), ('docs/readme.md', 'heading', 'Part', 10, '2', 'high'), ('docs/readme.md', 'table_row', '', 3, '["a", "b"]', 'high'),
('docs/readme.md', 'table_row', '', 5, '["1", "2"]', 'high'), ('docs/readme.md', 'link', 'site', 6, '"http://x.test"', 'high'), ('docs/readme.md', 'code', 'sql', 7, '""', 'medium')) AS v(path, kind, name, line, data, quality)""")
def md_facts(spark, sf):
    return _facts(spark, ["heading", "table_row", "link", "code"])


@query()
def material_facts(spark, sf):
    return _facts(spark, ["leaf", "node", "ragged", "failure", "column"])


# Catalogs, ontology graphs, candidates and texts


@query("""
SELECT table_name AS "table", column_name AS field, ordinal_position AS place, CASE WHEN column_name IN ('n_nationkey', 'r_regionkey', 'p_partkey') THEN 'pri' ELSE '' END AS key
FROM information_schema.columns WHERE table_name IN ('nation', 'region', 'part') AND table_schema = 'main'
""")
def catalog_scan(spark, sf):
    tables = {n: t(spark, sf, n) for n in ("nation", "region", "part")}
    return catalog.catalog(spark, tables, {"nation": "n_nationkey", "region": "r_regionkey", "part": "p_partkey"}).drop("type")


def _nodes(spark, sf):
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    blank = F.lit(None).cast("string")
    return (
        r.select(F.lit("objectTypes").alias("group"), key("R", "r_regionkey").alias("id"), F.col("r_name").alias("name"), blank.alias("domain"), blank.alias("range"))
        .unionByName(n.select(F.lit("linkTypes").alias("group"), key("L", "n_nationkey").alias("id"), F.col("n_name").alias("name"), key("R", "n_regionkey").alias("domain"), F.lit("R0").alias("range")))
        .unionByName(n.select(F.lit("properties").alias("group"), key("P", "n_nationkey").alias("id"), F.col("n_name").alias("name"), key("R", "n_regionkey").alias("domain"), F.lit("string").alias("range")))
    )


@query("""
SELECT 'objectTypes' AS "group", 'R' || r_regionkey AS id, r_name AS name, NULL::VARCHAR AS domain, NULL::VARCHAR AS range FROM region
UNION ALL SELECT 'linkTypes', 'L' || n_nationkey, n_name, 'R' || n_regionkey, 'R0' FROM nation UNION ALL SELECT 'properties', 'P' || n_nationkey, n_name, 'R' || n_regionkey, 'string' FROM nation
""")
def jsonld_round_trip(spark, sf):
    return ontology.decoded(ontology.encoded(_nodes(spark, sf).withColumn("model", F.lit(1)), "model"))


@query("SELECT 'link' AS kind, 'R' || n_regionkey AS source FROM nation UNION ALL SELECT 'property', 'P' || n_nationkey FROM nation WHERE n_regionkey = 0")
def deletion_dependencies(spark, sf):
    return ontology.users(ontology.edges(_nodes(spark, sf)), "R0")


@query("SELECT 'source' AS side, l_partkey::VARCHAR AS value, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 2 HAVING count(DISTINCT l_suppkey) > 1")
def link_cardinality(spark, sf):
    return ontology.cardinality_faults(t(spark, sf, "lineitem"), "l_partkey", "l_suppkey", "many-to-one")


@query("""
WITH c AS (SELECT o_custkey, list(DISTINCT l_partkey) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1), x AS (SELECT o_custkey, unnest(e) AS id FROM c),
f AS (SELECT p_partkey AS id, CASE WHEN p_size < 40 THEN 'low' ELSE 'high' END AS quality FROM part WHERE p_partkey % 3 <> 0)
SELECT o_custkey, count(quality) AS known, count(*) FILTER (quality IS NULL) AS unknown, CASE WHEN count(*) FILTER (quality = 'high') > 0 THEN 'supported' WHEN count(quality) > 0 THEN 'weak' ELSE 'missing' END AS status
FROM x LEFT JOIN f USING (id) GROUP BY 1
""")
def evidence_status(spark, sf):
    lines = t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    cand = lines.groupBy("o_custkey").agg(F.collect_set("l_partkey").alias("e"))
    known = t(spark, sf, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") < 40, "low").otherwise("high").alias("quality"))
    return candidates.evidence_status(cand, known, "o_custkey", "e")


@query("""
SELECT CASE WHEN p_partkey % 4 = 0 THEN 'b:' ELSE '' END || p_partkey AS key, CASE WHEN (p_partkey // 10) % 4 = 0 THEN 'b:' ELSE '' END || (p_partkey // 10) AS owner_key FROM part
""")
def namespace_batch(spark, sf):
    p = t(spark, sf, "part")
    new = p.select(F.col("p_partkey").cast("string").alias("key"), F.expr("p_partkey div 10").cast("string").alias("owner_key"))
    return candidates.namespaced(new, p.filter("p_partkey % 4 = 0").select(F.col("p_partkey").cast("string").alias("key")), "b:")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type <> 'view') WHERE k <= 8")
def context_picker(spark, sf):
    return candidates.context(t(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "view").select("user_id", "event_id")


@query("""
WITH live AS (SELECT * FROM events e WHERE event_type <> 'click' AND NOT EXISTS (SELECT 1 FROM events u WHERE u.event_type = 'click' AND u.event_id - 1 = e.event_id))
SELECT user_id, arg_max(event_type, event_id) AS operation FROM live GROUP BY 1
""")
def review_replay(spark, sf):
    e = t(spark, sf, "events")
    log = e.select("user_id", "event_id", F.col("event_type").alias("operation"), F.when(F.col("event_type") == "click", F.col("event_id") - 1).alias("undoes"))
    return candidates.decided(log, "user_id", "event_id")


@query("SELECT p_partkey FROM part WHERE p_size > 10 AND (p_partkey % 5 = 0 OR (p_retailprice <= 1500 AND p_size > 30))")
def delivery_gate(spark, sf):
    p = t(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") > 10, "include").otherwise("exclude").alias("decision"), (F.col("p_partkey") % 5 == 0).alias("reviewed"),
        (F.col("p_retailprice") > 1500).alias("conflict"), F.when(F.col("p_size") > 30, "supported").otherwise("weak").alias("status"),
    )
    return candidates.deliverable(p).select("p_partkey")


@query("""
SELECT p_name || ' ' || p_partkey AS reference, CASE WHEN p_partkey % 2 = 0 THEN 'k' || p_partkey WHEN p_partkey % 3 = 0 THEN 'i' || p_partkey WHEN p_partkey % 5 = 0 THEN 'a' || p_partkey END AS target FROM part
""")
def reference_resolution(spark, sf):
    p = t(spark, sf, "part").withColumn("name", F.concat_ws(" ", F.col("p_name"), F.col("p_partkey").cast("string")))
    side = lambda rule, mark: p.filter(rule).select("name", F.concat(F.lit(mark), F.col("p_partkey").cast("string")).alias("target"))
    return candidates.resolved(p.select(F.col("name").alias("reference")), side("p_partkey % 2 = 0", "k"), side("p_partkey % 3 = 0", "i"), side("p_partkey % 5 = 0", "a"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'hard' WHEN page_id % 4 = 1 THEN 'soft' WHEN page_id % 4 = 2 THEN 'allowed' ELSE 'taken' END AS verdict FROM pages")
def upload_filter(spark, sf):
    name = F.element_at(F.array(F.lit(".git/config.md"), F.lit("/x.LOG"), F.lit("/y.bak"), F.lit("/z.md")), (F.col("page_id") % 4 + 1).cast("int"))
    return t(spark, sf, "pages").select("page_id", texts.upload_verdict(F.concat(F.lit("a/"), name), allow=("bak",)).alias("verdict"))


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)((?:password|passwd|secret|token|api_?key)\s*[=:]\s*)\S+', '\1***', 'g'), '(?i)(bearer\s+)[A-Za-z0-9._-]+', '\1***', 'g') AS shown FROM documents
""")
def redaction(spark, sf):
    return t(spark, sf, "documents").select("doc_id", texts.redacted(F.col("text")).alias("shown"))


@query("SELECT doc_id, strlen(text) + 64 AS tokens_in, greatest(1024, 256 * (doc_id % 9) + ceil(0.25 * (strlen(text) + 64)))::BIGINT AS tokens_out FROM documents")
def token_budget(spark, sf):
    d = t(spark, sf, "documents").withColumn("tokens_in", texts.token_estimate(F.col("text"), 2))
    return d.select("doc_id", "tokens_in", texts.output_budget(F.col("doc_id") % 9, F.col("tokens_in")).alias("tokens_out"))


@query("SELECT n_nationkey, 'http://x.test/q?n=' || replace(n_name, ' ', '%20') || '&r=' || n_regionkey AS url FROM nation")
def url_template(spark, sf):
    return t(spark, sf, "nation").select("n_nationkey", texts.url("http://x.test/q?n={n}&r={r}", n=F.col("n_name"), r=F.col("n_regionkey")).alias("url"))


@query("SELECT user_id, list_sort(list(value))[greatest(ceil(count(*) * 0.95), 1)::INT] AS p95 FROM events GROUP BY 1")
def nearest_rank_percentile(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(texts.nearest_rank("value", 0.95).alias("p95"))


@query("SELECT c_custkey, CASE WHEN c_acctbal / 50 BETWEEN -90 AND 90 THEN c_acctbal / 50 END AS lat FROM customer")
def coordinates(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", texts.coordinate((F.col("c_acctbal") / 50).cast("string"), -90, 90).alias("lat"))


# Writes, as the tables they leave


@query("""
WITH c AS (SELECT 'k' || (event_id % 50) AS key, event_type AS value, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'DEL' ELSE 'SET' END AS op FROM events),
a AS (SELECT 'k' || n_nationkey AS key, n_name AS value, -1 AS seq, 'SET' AS op FROM nation UNION ALL SELECT * FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM a)
SELECT key, value FROM r WHERE n = 1 AND op <> 'DEL'
""")
def kv_upsert(spark, sf):
    store = t(spark, sf, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value"))
    changes = t(spark, sf, "events").select(F.concat(F.lit("k"), (F.col("event_id") % 50).cast("string")).alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 == 0, "DEL").otherwise("SET").alias("op"))
    return sinks.upserted(store, changes)


@query("""
WITH q AS (SELECT c_custkey AS key, c_mktsegment AS digest FROM customer), d AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 4 = 0 THEN 'other' ELSE c_mktsegment END AS digest, c_name AS response FROM customer WHERE c_custkey % 2 = 0)
SELECT q.key, q.digest, CASE WHEN d.key IS NULL THEN 'new' WHEN d.digest = q.digest THEN 'replay' ELSE 'conflict' END AS outcome, CASE WHEN d.digest = q.digest THEN response END AS response FROM q LEFT JOIN d ON q.key = d.key
""")
def idempotent_requests(spark, sf):
    c = t(spark, sf, "customer")
    done = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 4 == 0, "other").otherwise(F.col("c_mktsegment")).alias("digest"), F.col("c_name").alias("response"))
    return sinks.answered(c.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("digest")), done)


@query("SELECT s_suppkey + CASE WHEN s_suppkey % 3 = 0 THEN 1000000 ELSE 0 END AS s_suppkey, s_nationkey FROM supplier")
def import_id_remap(spark, sf):
    s = t(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    ids = s.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") + 1_000_000).alias("new"))
    return sinks.renamed_ids(s, ids, ["s_suppkey"]).select("s_suppkey", "s_nationkey")
