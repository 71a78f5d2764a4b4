"""Candidates for definitions: evidence, names, decisions and delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evidence_status(candidates: DataFrame, facts: DataFrame, key: str, evidence: str) -> DataFrame:
    """key, known and unknown references, and status: supported, weak (only facts of low quality) or missing.

    ``evidence`` is an array of fact ids; ``facts`` has id and quality.
    """
    each = candidates.select(key, F.explode_outer(evidence).alias("id"))
    joined = each.join(facts.select("id", "quality"), "id", "left")
    out = joined.groupBy(key).agg(
        F.count("quality").alias("known"), F.count_if(F.col("id").isNotNull() & F.col("quality").isNull()).alias("unknown"), F.count_if(F.col("quality") != "low").alias("_good")
    )
    return out.select(key, "known", "unknown", F.when(F.col("_good") > 0, "supported").when(F.col("known") > 0, "weak").otherwise("missing").alias("status"))


def namespaced(new: DataFrame, taken: DataFrame, prefix: str) -> DataFrame:
    """``new`` (key, owner_key) with keys that are taken prefixed, and references to them rewritten."""
    clash = new.join(taken.select("key"), "key", "left_semi").select(F.col("key").alias("_old"), F.concat(F.lit(prefix), F.col("key")).alias("_new"))
    out = new.join(clash, F.col("key") == F.col("_old"), "left").withColumn("key", F.coalesce("_new", "key")).drop("_old", "_new")
    return out.join(clash, F.col("owner_key") == F.col("_old"), "left").withColumn("owner_key", F.coalesce("_new", "owner_key")).drop("_old", "_new")


def context(facts: DataFrame, subject: str, order: str, primary: Column, most: int = 8) -> DataFrame:
    """Up to ``most`` facts of a subject beside its primary ones."""
    w = Window.partitionBy(subject).orderBy(order)
    return facts.filter(~primary).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def decided(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The last decision per candidate, after undone ones are taken out of the log (operation, undoes: a seq)."""
    undone = log.filter(F.col("undoes").isNotNull()).select(F.col("undoes").alias(seq)).distinct()
    live = log.filter(F.col("undoes").isNull()).join(undone, seq, "left_anti")
    return live.groupBy(key).agg(F.max_by("operation", seq).alias("operation"))


def deliverable(candidates: DataFrame) -> DataFrame:
    """Included ones that are reviewed, or have support and no conflict."""
    return candidates.filter((F.col("decision") == "include") & (F.col("reviewed") | (~F.col("conflict") & (F.col("status") == "supported"))))


def resolved(references: DataFrame, by_key: DataFrame, by_id: DataFrame, aliases: DataFrame) -> DataFrame:
    """reference and target, looked up as a key, then an id, then an alias; null if nothing knows it."""
    side = lambda df, name: df.select(F.col("name").alias("reference"), F.col("target").alias(name))
    out = references.join(side(by_key, "_k"), "reference", "left").join(side(by_id, "_i"), "reference", "left").join(side(aliases, "_a"), "reference", "left")
    return out.select("reference", F.coalesce("_k", "_i", "_a").alias("target"))


def revived(new: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """New candidates whose key an earlier run excluded: they wait."""
    return new.join(excluded.select(key).distinct().withColumn("_x", F.lit(True)), key, "left").withColumn("decision", F.when(F.col("_x"), "defer").otherwise(F.col("decision"))).drop("_x")
