"""Writes: replaced partitions, key-value upserts, snapshots and idempotent requests. Reading is the default; these are asked for by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Partitions that ``df`` has rows of are replaced whole, others stay; writing again gives the same."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upserted(store: DataFrame, changes: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The store after SET and DEL in order of ``seq``: changes (key, value, seq, op); the last change of a key wins."""
    now = store.select(key, "value", F.lit(-1).cast("long").alias(seq), F.lit("SET").alias("op"))
    last = now.unionByName(changes.select(key, "value", F.col(seq).cast("long"), "op")).groupBy(key).agg(F.max_by(F.struct("value", "op"), seq).alias("_last"))
    return last.filter("_last.op <> 'DEL'").select(key, F.col("_last.value").alias("value"))


def counted(store: DataFrame, changes: DataFrame, key: str = "key") -> DataFrame:
    """INCR and DECR: sums of changes (key, by) on top of the store's numbers."""
    now = store.select(key, F.col("value").cast("long").alias("by"))
    return now.unionByName(changes.select(key, F.col("by").cast("long"))).groupBy(key).agg(F.sum("by").alias("value"))


def set_if_absent(store: DataFrame, changes: DataFrame, key: str = "key") -> DataFrame:
    """SETNX: only keys that the store lacks are added, each by its first change."""
    fresh = changes.join(store.select(key), key, "left_anti").groupBy(key).agg(F.min_by("value", "seq").alias("value"))
    return store.select(key, "value").unionByName(fresh)


def answered(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Requests (key, digest) against answered ones: replay, conflict (same key, other content) or new."""
    joined = requests.join(done.select("key", F.col("digest").alias("_d"), "response"), "key", "left")
    return joined.select("key", "digest", F.when(F.col("_d").isNull(), "new").when(F.col("_d") == F.col("digest"), "replay").otherwise("conflict").alias("outcome"), F.when(F.col("_d") == F.col("digest"), F.col("response")).alias("response"))


def fetched(spark: SparkSession, urls: list[str], client: Callable[[str], str], path: str) -> DataFrame:
    """url and the value at a dotted path of each JSON answer. The client is given, so nothing here opens a connection."""
    rows = [(u, client(u)) for u in urls]
    return spark.createDataFrame(rows, "url string, body string").select("url", F.get_json_object("body", "$." + path).alias("value"))


def renamed_ids(df: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """Ids of an imported package in ``columns`` rewritten by ``ids`` (old, new); others stay."""
    for c in columns:
        df = df.join(ids.select(F.col("old").alias(c), F.col("new").alias("_new")), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return df


def unsafe_entries(entries: DataFrame, most_bytes: int = 512 << 20, most_ratio: int = 100) -> DataFrame:
    """Archive entries (name, size, packed) that expansion refuses: paths that leave the folder, and bombs."""
    name = F.replace("name", F.lit("\\"), F.lit("/"))
    why = F.when(name.startswith("/") | name.rlike(r"(^|/)\.\.(/|$)") | name.rlike("^[A-Za-z]:"), "unsafe path").when(F.col("size") > most_bytes, "too large").when(F.col("size") > most_ratio * F.greatest("packed", F.lit(1)), "ratio")
    return entries.select("name", why.alias("why")).filter("why IS NOT NULL")
