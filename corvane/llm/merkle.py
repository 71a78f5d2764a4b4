"""A manifest of a dataset as a tree of hashes, with a proof for each row.

Rows are leaves. Leaves are put in order by a range partitioning, so no source is
sorted in one task, and cut into buckets of 3 ** HEIGHT neighbours, so that each
bucket is a whole subtree. Executors hash the levels of their buckets in DuckDB
(ordered string_agg, then sha256), several buckets at a time as Arrow tables.
Spark carries the roots of the buckets on as the leaves of the next round until a
source has one root, and joins the proofs above a bucket to its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, written

FAN = 3
#: Levels of a bucket: 3 ** 8 = 6,561 leaves.
HEIGHT = 8
#: Rows that a task hands to DuckDB at a time, besides the end of the last bucket.
BLOCK_ROWS = 40_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<l:string,r:string>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Hex digest of the values, each as its size in bytes, a colon and itself, or a hyphen if null."""
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def _source_key(source: Column) -> Column:
    """A text that sorts as the source does, null first."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string")))


def ranked(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0) in ``order`` among the rows of ``key``, and ``total``, their number.

    Rows are dealt by ranges of (key, order), so a key that holds most rows is cut as well. Only the counts of (key, range) meet.
    """
    sorted_rows = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = written(sorted_rows.withColumn("place", F.monotonically_increasing_id()), "ordered").withColumn("range", F.shiftright("place", 33))
    counts = placed.groupBy(key, "range").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(key).agg(F.sum("n").alias("total"), F.collect_list(F.struct("range", "first", "n")).alias("ranges"))
    ranges = F.array_sort("ranges")
    # One entry for each range of a key, so the list is as long as the partitioning at most.
    before = lambda r: F.aggregate(F.filter(ranges, lambda x: x["range"] < r["range"]), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    offsets = totals.select(key, "total", F.explode(F.transform(ranges, lambda r: F.struct(r["range"].alias("range"), r["first"].alias("first"), before(r).alias("before")))).alias("o"))
    offsets = offsets.select(key, "total", "o.range", "o.first", "o.before")
    return placed.join(offsets, [key, "range"]).withColumn("pos", F.col("place") - F.col("first") + F.col("before")).drop("range", "first", "before", "place")


def _height(total: Column, most: int) -> Column:
    """Levels until ``total`` nodes are one, ``most`` at most."""
    levels = F.lit(0)
    for k in range(most):
        levels = levels + F.when(total > FAN**k, 1).otherwise(0)
    return levels


LEVEL = """
CREATE OR REPLACE TABLE n{up} AS
SELECT g, pos // 3 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM n{k} JOIN (SELECT g FROM groups WHERE levels > {k}) USING (g) GROUP BY g, pos // 3
"""
ROOTS = "SELECT g, h FROM groups JOIN n{k} USING (g) WHERE levels = {k}"
SIBLINGS = """
CREATE OR REPLACE TABLE s{k} AS
SELECT g, pos, coalesce(string_agg(h, '' ORDER BY pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
       coalesce(string_agg(h, '' ORDER BY pos) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
FROM n{k} JOIN (SELECT g FROM groups WHERE levels > {k}) USING (g) WINDOW w AS (PARTITION BY g, pos // 3 ORDER BY pos)
"""
FOLD = """
CREATE OR REPLACE TABLE f{up} AS
SELECT f.i, f.g, f.pos // 3 AS pos, CASE WHEN s.g IS NULL THEN steps ELSE list_append(steps, {{'l': l, 'r': r}}) END AS steps,
       CASE WHEN s.g IS NULL THEN folded ELSE sha256(l || folded || r) END AS folded
FROM f{k} f LEFT JOIN s{k} s ON s.g = f.g AND s.pos = f.pos
"""


def _levels(con, nodes: pa.Table, height: int) -> None:
    """Tables n0, n1, ... of the nodes of each level; ``nodes`` has g, pos (in the bucket), levels and h."""
    con.register("block", nodes)
    con.execute("CREATE OR REPLACE TABLE n0 AS SELECT g, pos, h FROM block")
    con.execute("CREATE OR REPLACE TABLE groups AS SELECT DISTINCT g, levels FROM block")
    for k in range(height):
        con.execute(LEVEL.format(k=k, up=k + 1))


def _roots(con, block: pa.Table, height: int) -> pa.Table:
    _levels(con, block, height)
    found = con.sql(" UNION ALL ".join(ROOTS.format(k=k) for k in range(height + 1))).to_arrow_table()
    heads = con.sql("SELECT g, any_value(key) AS key, any_value(bucket) AS bucket, any_value(total) AS total FROM block GROUP BY g").to_arrow_table()
    con.register("found", found)
    con.register("heads", heads)
    return con.sql("SELECT key, bucket, total, h FROM heads JOIN found USING (g)").to_arrow_table()


def _proofs(con, block: pa.Table, height: int) -> pa.Table:
    """The block's rows with the steps from each to its bucket's root, and what ``tampered`` folds to there."""
    _levels(con, block, height)
    con.execute("CREATE OR REPLACE TABLE f0 AS SELECT i, g, pos, []::STRUCT(l VARCHAR, r VARCHAR)[] AS steps, coalesce(tampered, h) AS folded FROM block")
    for k in range(height):
        con.execute(SIBLINGS.format(k=k))
        con.execute(FOLD.format(k=k, up=k + 1))
    return con.sql(f"SELECT key, bucket, id, h, steps, folded FROM block JOIN (SELECT i, steps, folded FROM f{height}) USING (i)").to_arrow_table()


def _blocks(nodes: DataFrame, work: Callable, schema: str, height: int) -> DataFrame:
    """Apply ``work`` to whole buckets of ``nodes`` (key, pos, total, id, h, tampered), many at a time."""
    size = FAN**height
    dealt = nodes.select(
        "key",
        F.expr(f"pos div {size}").alias("bucket"),
        (F.col("pos") % size).alias("pos"),
        "total",
        _height(F.col("total"), height).cast("long").alias("levels"),
        "id",
        "h",
        "tampered",
    )
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "700MB"})

        def finish(table: pa.Table) -> Iterator[pa.RecordBatch]:
            con.register("rows", table)
            block = con.sql("SELECT *, dense_rank() OVER (ORDER BY key, bucket) AS g, row_number() OVER () AS i FROM rows").to_arrow_table()
            for batch in work(con, block, height).select(names).cast(wanted).to_batches(max_chunksize=5000):
                yield batch

        waiting: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if rows and rows + batch.num_rows > BLOCK_ROWS:
                # Buckets come in order: cut where the last one begins, and keep its rows.
                table = pa.Table.from_batches([*waiting, batch])
                last = (table.column("key")[-1].as_py(), table.column("bucket")[-1].as_py())
                cut = table.num_rows
                while cut and (table.column("key")[cut - 1].as_py(), table.column("bucket")[cut - 1].as_py()) == last:
                    cut -= 1
                if cut:
                    yield from finish(table.slice(0, cut))
                table = table.slice(cut)
                waiting, rows = table.to_batches(), table.num_rows
            else:
                waiting.append(batch)
                rows += batch.num_rows
        if rows:
            yield from finish(pa.Table.from_batches(waiting))
        con.close()

    step = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
    kinds = {"bucket": pa.int64(), "total": pa.int64(), "id": pa.int64(), "steps": step}
    wanted = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
    return dealt.repartition("key", "bucket").sortWithinPartitions("key", "bucket").mapInArrow(run, schema)


def _above(spark: SparkSession, nodes: DataFrame, height: int) -> DataFrame:
    """For each bucket of ``nodes``: key, bucket, above (the steps from its root to the key's) and top (the key's root).

    Every round leaves one node of 3 ** height, so few rounds follow each other.
    """
    roots = written(_blocks(nodes, _roots, "key string, bucket long, total long, h string", height), "roots")
    upper = roots.withColumn("total", F.expr(f"(total + {FAN**height - 1}) div {FAN**height}"))
    if upper.filter("total > 1").isEmpty():
        return upper.select("key", "bucket", F.array().cast(STEPS).alias("above"), F.col("h").alias("top"))
    # A key that is done waits with its one node: no level is left, so it has no steps.
    following = upper.select("key", F.col("bucket").alias("pos"), "total", F.col("bucket").alias("id"), "h", F.lit(None).cast("string").alias("tampered"))
    return written(proofs(spark, following, height).select("key", F.col("id").alias("bucket"), F.col("steps").alias("above"), "top"), "above")


def proofs(spark: SparkSession, nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """key, id, h, steps (siblings left and right, level by level to the key's root), folded and top of every node.

    ``nodes`` has key, pos, total, id, h and tampered; ``folded`` is what ``tampered``, or h where that is null, gives with these steps.
    """
    above = _above(spark, nodes, height)
    inside = _blocks(nodes, _proofs, f"key string, bucket long, id long, h string, steps {STEPS}, folded string", height)
    both = inside.join(above, ["key", "bucket"])
    return both.select("key", "id", "h", F.concat("steps", "above").alias("steps"), _fold(F.col("above"), F.col("folded")).alias("folded"), "top")


def _fold(steps: Column, start: Column) -> Column:
    return F.aggregate(steps, start, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    * Each field that is null counts as a hyphen; rows of a null source are a source of their own, the first one.
    * Rows with a null doc_id come first in their source and are not tampered with. Rows that repeat a doc_id are
      leaves of their own, in the order of their digests; rows that repeat all fields have the same leaf at neighbouring places.
    * Rows whose crc32 of the doc_id is even are tampered with: the line feeds of their texts are deleted. A text without any stays as it is, and verifies.
    * An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    own = [F.col(f) for f in FIELDS]
    changed = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    without = leaf(*own[:-1], F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit("")))
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        _source_key(F.col("source")).alias("key"),
        F.unhex(leaf(*own)).alias("h"),
        F.when(changed & F.col("text").contains("\n"), F.unhex(without)).alias("tampered"),
    )
    leaves = written(leaves, "leaves")
    nodes = ranked(leaves, "key", "id", "h").withColumns({"h": F.lower(F.hex("h")), "tampered": F.lower(F.hex("tampered"))})
    nodes = written(nodes, "nodes")
    forget(leaves)
    above = written(_above(spark, nodes, height), "sources")
    subroots = written(above.groupBy("key").agg(F.first("top").alias("h")).withColumn("all", F.lit("")), "subroots")
    places = ranked(subroots, "all", "key").withColumnRenamed("key", "source").select(F.col("all").alias("key"), "pos", "total", F.col("pos").alias("id"), "h", F.lit(None).cast("string").alias("tampered"), "source")
    places = written(places, "places")
    top = proofs(spark, places, height).select("id", F.col("steps").alias("outer"), F.col("top").alias("root"))
    outer = places.select("id", F.col("source").alias("key")).join(top, "id").drop("id")
    outer = written(above.join(outer, "key").select("key", "bucket", F.col("top").alias("subroot"), F.concat("above", "outer").alias("above"), "root"), "outer")
    inside = _blocks(nodes, _proofs, f"key string, bucket long, id long, h string, steps {STEPS}, folded string", height)
    both = inside.join(outer, ["key", "bucket"])
    path = F.array_join(F.transform(F.concat("steps", "above"), lambda s: F.concat(s["l"], s["r"])), "")
    out = both.select(F.col("id").alias("doc_id"), F.col("h").alias("leaf"), "subroot", "root", F.sha2(path, 256).alias("proof_sha256"), _fold(F.col("above"), F.col("folded")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
