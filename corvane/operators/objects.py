"""Objects, links and observations over mapped tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def object_id(project: str, kind: str, key: str) -> Column:
    return F.concat_ws(":", F.lit(project), F.lit(kind), F.col(key).cast("string"))


def instances(df: DataFrame, project: str, kind: str, key: str, properties: Mapping[str, str], title: str | None = None) -> DataFrame:
    """id, type, source_id, display_name and the properties under their names. Rows without a key are no objects."""
    oid = object_id(project, kind, key)
    shown = F.coalesce(F.col(title).cast("string"), oid) if title else oid
    return df.filter(F.col(key).isNotNull()).select(
        oid.alias("id"), F.lit(kind).alias("type"), F.col(key).cast("string").alias("source_id"), shown.alias("display_name"), *[F.col(c).alias(p) for p, c in properties.items()]
    )


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has: key, n."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def links(df: DataFrame, project: str, kind: str, key: str, relation: str, column: str, target: str) -> DataFrame:
    """object_id, relation, parent_id of one relation."""
    return df.filter(F.col(key).isNotNull() & F.col(column).isNotNull()).select(object_id(project, kind, key).alias("object_id"), F.lit(relation).alias("relation"), object_id(project, target, column).alias("parent_id"))


def dangling(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose reference has no row in ``parent``; null references are no references."""
    known = parent.select(F.col(key).alias(column)).filter(F.col(column).isNotNull()).distinct()
    return child.filter(F.col(column).isNotNull()).join(known, column, "left_anti")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; a local session without one gets a folder that goes when Python ends."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.TemporaryDirectory(prefix="corvane-")
        atexit.register(own.cleanup)
        known = f"file://{own.name}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` from reliable storage in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def closure(edges: DataFrame, roots: DataFrame, most: int = 64) -> DataFrame:
    """node and depth of all that ``roots`` (node) reach over ``edges`` (parent, child). Cycles end, since a node is taken once."""
    seen = roots.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, most + 1):
        step = edges.join(frontier.select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node")).distinct()
        frontier = cut_lineage(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = cut_lineage(seen.unionByName(frontier))
    raise ValueError(f"deeper than {most}")


def resolve_aliases(aliases: DataFrame, most: int = 40) -> DataFrame:
    """key and target at the end of each chain of ``aliases`` (key, target), by pointer jumping; keys that never end (cycles) point to themselves."""
    now = aliases.select("key", "target")
    for _ in range(most):
        ahead = now.select(F.col("key").alias("target"), F.col("target").alias("ahead"))
        jumped = now.join(ahead, "target", "left").select("key", F.coalesce("ahead", "target").alias("target"), F.col("ahead").isNotNull().alias("moved"))
        jumped = cut_lineage(jumped)
        now = jumped.select("key", "target")
        if jumped.filter("moved").isEmpty():
            return now
        if jumped.filter("moved AND key <> target").isEmpty():
            break
    ends = now.join(aliases.select(F.col("key").alias("target")), "target", "left_semi")
    return now.join(ends.select("key", F.lit(True).alias("loops")), "key", "left").select("key", F.when(F.col("loops"), F.col("key")).otherwise(F.col("target")).alias("target"))


def as_of(observations: DataFrame, key: str, ts: str, value: str, at: str | Column) -> DataFrame:
    """Latest observation up to ``at`` per key: key, ts, value, n_ties. One shuffle; ties on the time are counted, not picked silently."""
    limit = F.lit(at).cast("timestamp_ntz") if isinstance(at, str) else at
    newest = Window.partitionBy(key).orderBy(F.col(ts).desc())
    ranked = observations.filter(F.col(ts) <= limit).withColumn("_rank", F.rank().over(newest)).filter("_rank = 1")
    return ranked.groupBy(key).agg(F.max(ts).alias(ts), F.max(value).alias(value), F.count(F.lit(1)).alias("n_ties"))


def freshness(latest: DataFrame, ts: str, at: str, max_age: int, group: str, tolerance: int) -> DataFrame:
    """Per group: members, the oldest age and the spread of times in seconds, and whether both are within limits."""
    age = F.unix_timestamp(F.lit(at).cast("timestamp")) - F.unix_timestamp(F.col(ts).cast("timestamp"))
    out = latest.withColumn("_age", age).groupBy(group).agg(F.count(F.lit(1)).alias("n_members"), F.max("_age").alias("oldest_age"), (F.max("_age") - F.min("_age")).alias("spread"))
    return out.withColumn("verdict", F.when(F.col("oldest_age") > max_age, "stale").when(F.col("spread") > tolerance, "misaligned").otherwise("ok"))


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """Sum of value times weight over the sum of weights; null, with the count of bad rows, if a value or weight is out of bounds."""
    good = F.coalesce(F.col(value).between(low, high) & (F.col(weight) > 0) & (F.col(weight) < float("inf")), F.lit(False))
    out = df.groupBy(*by).agg(F.sum(F.col(value) * F.col(weight)).alias("_vw"), F.sum(weight).alias("_w"), F.count_if(~good).alias("n_bad"), F.count(F.lit(1)).alias("n"))
    return out.select(*by, "n", "n_bad", F.when(F.col("n_bad") == 0, F.col("_vw") / F.col("_w")).alias("mean"))


def observed(observations: DataFrame, key: str, ts: Column, value: str, known: DataFrame, known_key: str) -> DataFrame:
    """``observations`` with ``problem``: null, or why one can't be used (unknown object, bad time, bad value); none is dropped here."""
    side = known.select(F.col(known_key).alias(key), F.lit(True).alias("_known")).distinct()
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    problem = F.when(F.col("_known").isNull(), "unknown object").when(ts.isNull(), "bad time").when(~finite, "bad value")
    return observations.join(side, key, "left").withColumn("problem", problem).drop("_known")


def connected(links_: DataFrame, a: str, b: str, most: int = 64) -> DataFrame:
    """node and component (its smallest node) over undirected links; rounds of smallest neighbours and pointer jumping."""
    ends = links_.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    both = cut_lineage(ends.unionByName(ends.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    now = both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("component"))
    for _ in range(most):
        of = now.select(F.col("node").alias("y"), F.col("component").alias("low"))
        near = both.join(of, "y").groupBy("x").agg(F.min("low").alias("low"))
        step = now.join(near, F.col("node") == F.col("x"), "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("low", "component")).alias("mid"))
        jump = now.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        after = cut_lineage(step.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("component")))
        now = after.select("node", "component")
        if after.filter("old <> component").isEmpty():
            return now
    raise ValueError(f"not settled after {most} rounds")
