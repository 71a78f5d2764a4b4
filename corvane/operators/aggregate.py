"""Members of instances and sums over relations, with a verdict instead of silently skipped gaps."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.predicates import Condition, conjunction


def members(df: DataFrame, rules: Mapping[str, Iterable[Condition]]) -> DataFrame:
    """Rows of ``df`` with the ``instance`` whose rule they meet.

    One scan serves all rules: a row gets the array of instances it meets and is
    exploded, so the table is read once however many rules there are.
    """
    met = [F.when(conjunction(df, rule), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("instance", F.explode(F.filter(F.array(*met), lambda x: x.isNotNull())))


def ownership_conflicts(matched: DataFrame, key: str) -> DataFrame:
    """Members that several instances of a one-to-many relation own: key and n_owners."""
    return matched.groupBy(key).agg(F.countDistinct("instance").alias("n_owners")).filter("n_owners > 1")


def deduplicated(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key: the value, its number of rows, and ``conflict`` if rows differ. Nulls are equal to each other."""
    return df.groupBy(*keys).agg(
        F.min(value).alias(value),
        F.count(F.lit(1)).alias("n_rows"),
        ((F.min(value) != F.max(value)) | ((F.count(value) > 0) & (F.count(value) < F.count(F.lit(1))))).alias("conflict"),
    ).withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def sum_with_verdict(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """total, n_members, n_missing and verdict per group.

    A group with a null value is ``incomplete`` and has no total; a plain sum would skip the gap.
    """
    out = df.groupBy(*by).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n_members"), F.count_if(F.col(value).isNull()).alias("n_missing"))
    return out.withColumn("verdict", F.when(F.col("n_missing") > 0, "incomplete").otherwise("ok")).withColumn("total", F.when(F.col("n_missing") == 0, F.col("total")))


def relation_sum(instances: DataFrame, key: str, member_rows: DataFrame, owner: str, value: str) -> DataFrame:
    """The verdict for every instance, also for those without a member (``empty``).

    Members are summed before the join, so only one row per instance is shuffled to it.
    """
    summed = sum_with_verdict(member_rows, [owner], value).withColumnRenamed(owner, key)
    joined = instances.join(summed, key, "left")
    return joined.select(
        *instances.columns,
        F.col("total"),
        F.coalesce("n_members", F.lit(0)).cast("long").alias("n_members"),
        F.coalesce("n_missing", F.lit(0)).cast("long").alias("n_missing"),
        F.coalesce("verdict", F.lit("empty")).alias("verdict"),
    )


def within_limit(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """``df``, or an error when it has more rows than a rule may match: never a partial sum."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} members")
    return df


def marginals(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each column alone, in one pass: dimension, value, n."""
    parts = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(parts)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def null_if_unknown(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """A total that is null if any part is unknown, next to what is known and how many are not."""
    return df.groupBy(*by).agg(
        F.when(F.count_if(F.col(value).isNull()) == 0, F.sum(value)).alias("total"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias("known_total"),
        F.count_if(F.col(value).isNull()).alias("n_unknown"),
    )


def calibrated(df: DataFrame, by: list[str], value: str, least: int = 20, factor: float = 1.25) -> DataFrame:
    """The 90th percentile times ``factor``, or the maximum times it under ``least`` samples: by, n, budget."""
    n = F.count(value)
    return df.groupBy(*by).agg(n.alias("n"), (F.when(n < least, F.max(value)).otherwise(F.percentile(value, F.lit(0.9))) * factor).alias("budget"))


def union_members(parts: Iterable[DataFrame], key: str) -> DataFrame:
    """Members of several rules, once per key."""
    return reduce(DataFrame.unionByName, parts).dropDuplicates([key])


def calibrated_last(df: DataFrame, by: list[str], value: str, order: list[Column], keep: int = 20, factor: float = 1.25) -> DataFrame:
    """``calibrated`` over the last ``keep`` samples of each group: n of all samples, n_kept, budget. ``order`` puts the newest first."""
    w = Window.partitionBy(*by).orderBy(*order)
    known = df.filter(F.col(value).isNotNull())
    last = known.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= keep)
    rate = last.groupBy(*by).agg(F.count(F.lit(1)).alias("n_kept"), F.max(value).alias("_max"), F.percentile(value, F.lit(0.9)).alias("_p90"))
    n = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return n.join(rate, by).select(*by, "n", "n_kept", (F.when(F.col("n") < keep, F.col("_max")).otherwise(F.col("_p90")) * factor).alias("budget"))


def counters(df: DataFrame, by: list[str], seq: str, value: str) -> DataFrame:
    """n rows, the next number of a sequence (1 where none is known), and a sum that is 0 where nothing is known."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.coalesce(F.max(seq), F.lit(0)) + 1).alias("next_seq"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total")
    )


def json_sum(df: DataFrame, by: list[str], column: str, paths: Mapping[str, str]) -> DataFrame:
    """Sums of numbers within a JSON column, per name and path; what is absent or no number counts as 0."""
    return df.groupBy(*by).agg(*[F.coalesce(F.sum(F.get_json_object(column, path).try_cast("double")), F.lit(0.0)).alias(name) for name, path in paths.items()])


def median_known(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The median of the known values, with how many are known of how many."""
    return df.groupBy(*by).agg(F.median(value).alias("median"), F.count(value).alias("n_known"), F.count(F.lit(1)).alias("n"))
