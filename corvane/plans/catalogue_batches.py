"""Registered queries on batches of facts, and properties that flows give."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import batches, facts, graphs
from corvane.plans import catalogue, flow, flow_property
from corvane.plans.catalogue import query


def t(spark, sf, name):
    return catalogue.t(spark, sf, name)


PART_CHARS, PART_ROWS, DEEPEST = 12_000, 12, 8


@query(f"""
WITH RECURSIVE d AS (SELECT source, lang, doc_id, n_chars, greatest(coalesce(n_chars, 0), 1) AS n, min(doc_id) OVER (PARTITION BY source, lang) AS unit FROM documents),
s AS (SELECT *, 'root' AS path, 0 AS depth FROM d UNION ALL
  SELECT source, lang, doc_id, n_chars, n, unit, path || CASE WHEN units > 1 THEN CASE WHEN u <= (units + 1) // 2 THEN '/L' ELSE '/R' END WHEN i <= (k + 1) // 2 THEN '/L' ELSE '/R' END, depth + 1
  FROM (SELECT *, max(u) OVER (PARTITION BY source, path) AS units FROM
    (SELECT *, dense_rank() OVER (PARTITION BY source, path ORDER BY unit) AS u, row_number() OVER (PARTITION BY source, path ORDER BY unit, doc_id) AS i,
       count(*) OVER (PARTITION BY source, path) AS k, sum(n) OVER (PARTITION BY source, path) AS total FROM s))
  WHERE k > 1 AND (total > {PART_CHARS} OR k > {PART_ROWS}) AND depth < {DEEPEST}),
last AS (SELECT doc_id, arg_max(path, depth) AS path FROM s GROUP BY doc_id),
p AS (SELECT source, lang, doc_id, n_chars, path, count(*) OVER w AS k, sum(n) OVER w AS total FROM d JOIN last USING (doc_id) WINDOW w AS (PARTITION BY source, path))
SELECT source, lang, doc_id, n_chars, path, CASE WHEN total <= {PART_CHARS} AND k <= {PART_ROWS} THEN 'fits' WHEN k = 1 THEN 'too large' ELSE 'too deep' END AS status FROM p
""")
def split_batches(spark, sf):
    return batches.split(t(spark, sf, "documents"), "source", "lang", "doc_id", "n_chars", PART_CHARS, PART_ROWS, DEEPEST)


@query("SELECT source, count(*) AS n_parents, count(*) AS n_parts, 0 AS n_lost, 0 AS n_doubled, 0 AS n_foreign, true AS conserved FROM documents GROUP BY 1")
def split_conserved(spark, sf):
    return batches.conserved(t(spark, sf, "documents"), split_batches(spark, sf), "source", "doc_id")


@query("""
WITH m AS (SELECT doc_id, source, lang, regexp_matches(lower(text), 'licen|@mail') AS hit, NOT regexp_matches(lower(text), 'licen|@mail|cookie|der die') AS free FROM documents),
pairs AS (SELECT h.doc_id AS h, f.doc_id AS f, 'm' AS link FROM m h JOIN m f USING (source) WHERE h.hit AND f.free UNION ALL
  SELECT h.doc_id, f.doc_id, 'f' FROM m h JOIN m f USING (lang) WHERE h.hit AND f.free),
ranked AS (SELECT f, row_number() OVER (PARTITION BY h, link, f < h ORDER BY abs(f - h)) AS k FROM pairs)
SELECT DISTINCT f AS doc_id FROM ranked WHERE k <= 5
""")
def scope_neighbours(spark, sf):
    docs = t(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    hit, out = facts.any_of(F.col("text"), catalogue.INCLUDE), facts.any_of(F.col("text"), catalogue.EXCLUDE)
    return facts.neighbours(docs, "doc_id", ["source", "lang"], hit, ~hit & ~out)


# Properties from flows

SPENDING = flow_property.Flow(
    [
        flow.Node("mine", "sql", ["instance", "orders"], {"template": "SELECT i.instance, o.o_orderdate AS at, o.o_totalprice AS price, i.share FROM {instance} i JOIN {orders} o ON o.o_custkey = i.instance AND o.o_totalprice >= i.least"}),
        flow.Node("sums", "sql", ["mine"], {"template": "SELECT instance, sum(price) AS total, cast(count(*) AS DOUBLE) AS n, max(share) AS share FROM {mine} GROUP BY instance"}),
        flow.Node("rated", "calc", ["sums"], {"outputs": {"mean": "{total} / {n} * {share}"}}),
    ],
    {"least": "number", "share": "number"},
    {"mean": flow_property.Output("rated", "number", "mean"), "each": flow_property.Output("mine", {"price": "number", "at": "datetime"})},
)
BOUND = {"least": ("property", "c_acctbal"), "share": ("constant", 0.5)}


@query("""
WITH s AS (SELECT c_custkey, sum(o_totalprice) / count(*) * 0.5 AS mean FROM customer JOIN orders ON o_custkey = c_custkey AND o_totalprice >= c_acctbal GROUP BY 1)
SELECT c_custkey AS instance, CASE WHEN mean IS NULL THEN 'missing' ELSE 'ok' END AS status, mean AS value FROM customer LEFT JOIN s USING (c_custkey)
""")
def flow_property_scalar(spark, sf):
    return flow_property.scalar(spark, SPENDING, flow_property.Binding("mean", BOUND), t(spark, sf, "customer"), "c_custkey", {"orders": t(spark, sf, "orders")})


@query("SELECT c_custkey AS instance, o_orderdate::TIMESTAMP AS time, o_totalprice AS value FROM customer JOIN orders ON o_custkey = c_custkey AND o_totalprice >= c_acctbal")
def flow_property_series(spark, sf):
    bound = flow_property.Binding("each", BOUND, "price", "at")
    return flow_property.series(spark, SPENDING, bound, t(spark, sf, "customer"), "c_custkey", {"orders": t(spark, sf, "orders")})


# Versions of graphs


def _graph(spark, sf, balance, kept):
    c = t(spark, sf, "customer").filter(kept)
    n = t(spark, sf, "nation")
    body = F.concat_ws("|", "c_name", F.expr(balance).cast("string"))
    nodes = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), body.alias("body")).unionByName(n.select(F.concat(F.lit("n"), "n_nationkey"), "n_name").toDF("id", "body"))
    edges = c.filter("c_nationkey <> 3").select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.lit("livesIn").alias("relation"), F.concat(F.lit("n"), "c_nationkey").alias("target"))
    return nodes, edges


def _half(at):
    return f"sum(('0x' || substr(md5(x), {at}, 15))::BIGINT)"


@query(f"""
WITH c AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS n, c_nationkey, c_name || '|' || (c_custkey % 100)::VARCHAR AS body FROM customer),
e AS (SELECT CASE WHEN c_nationkey = 3 THEN id ELSE (SELECT min(i) FROM (SELECT id AS i, n FROM c UNION ALL SELECT n, n FROM c) z WHERE z.n = c.n) END AS component, 'node ' || length(id) || ':' || id || length(body) || ':' || body AS x, 1 AS node FROM c
  UNION ALL SELECT (SELECT min(i) FROM (SELECT id AS i, n FROM c UNION ALL SELECT n, n FROM c) z WHERE z.n = c.n), 'edge ' || length(id) || ':' || id || '7:livesIn' || length(n) || ':' || n, 0 FROM c WHERE c_nationkey <> 3
  UNION ALL SELECT CASE WHEN n_nationkey = 3 THEN 'n3' ELSE coalesce((SELECT min(id) FROM c WHERE c_nationkey = n_nationkey), 'n' || n_nationkey) END,
    'node ' || length('n' || n_nationkey) || ':n' || n_nationkey || length(n_name) || ':' || n_name, 1 FROM nation)
SELECT component, sum(node)::BIGINT AS n_nodes, sum(1 - node)::BIGINT AS n_edges, {_half(1)}::VARCHAR || '-' || {_half(16)}::VARCHAR AS signature FROM e GROUP BY 1
""")
def graph_signatures(spark, sf):
    return graphs.signatures(*_graph(spark, sf, "c_custkey % 100", "true"))


@query("""
WITH c AS (SELECT *, length('c' || c_custkey) || ':c' || c_custkey AS k, length('n' || c_nationkey) || ':n' || c_nationkey AS n FROM customer)
SELECT 'node' AS kind, k AS key, CASE WHEN c_custkey % 70 = 0 THEN 'removed' WHEN c_custkey % 90 = 1 THEN 'added' ELSE 'changed' END AS change FROM c
WHERE (c_custkey % 70 = 0) <> (c_custkey % 90 = 1) OR c_custkey % 70 <> 0 AND c_custkey % 50 = 0
UNION ALL SELECT 'edge', k || '7:livesIn' || n, CASE WHEN c_custkey % 70 = 0 THEN 'removed' ELSE 'added' END FROM c WHERE (c_custkey % 70 = 0) <> (c_custkey % 90 = 1) AND c_nationkey <> 3
""")
def graph_diff(spark, sf):
    old = _graph(spark, sf, "c_custkey % 100", "c_custkey % 90 <> 1")
    return graphs.diff(old, _graph(spark, sf, "c_custkey % 100 + IF(c_custkey % 50 = 0, 1, 0)", "c_custkey % 70 <> 0"))
