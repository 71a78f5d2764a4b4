"""Property sources: one value or one time series per object from its tables and key-value store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, value: str, ts: str, tie: str) -> DataFrame:
    """Value of the newest row per key; ``tie`` decides among equal times. An aggregation, so maps combine before the shuffle."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(ts, tie)).alias(value))


def total(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias(value))


def average(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias(value))


def single(df: DataFrame, key: str, value: str) -> DataFrame:
    """The value per key; more than one row of a key is an error when the result is computed."""
    n = F.count(F.lit(1))
    return df.groupBy(key).agg(F.when(n == 1, F.first(value)).otherwise(F.raise_error(F.lit(f"several rows of one {key}"))).alias(value))


def time_series(df: DataFrame, key: str, ts: str, value: str, start: str, end: str, descending: bool = False) -> DataFrame:
    """array<struct<timestamp, value>> of times in [start, end) per key; null values stay."""
    inside = (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))
    point = F.struct(F.col(ts).alias("timestamp"), F.col(value).alias("value"))
    return df.filter(inside).groupBy(key).agg(F.sort_array(F.collect_list(point), asc=not descending).alias("series"))


def one_per_time(df: DataFrame, key: list[str], ts: str, tie: Column | None = None) -> DataFrame:
    """Rows with ``n_at_time``. With ``tie`` only the row that it puts first stays; without it, callers see the duplicates."""
    w = Window.partitionBy(*key, ts)
    counted = df.withColumn("n_at_time", F.count(F.lit(1)).over(w))
    if tie is None:
        return counted
    return counted.withColumn("_place", F.row_number().over(w.orderBy(tie))).filter("_place = 1").drop("_place")


def time_of(c: Column, encoding: str, zone: str = "UTC") -> Column:
    """A timestamp from epochSeconds, epochMillis, or datetime in an IANA zone."""
    if encoding == "epochSeconds":
        return F.timestamp_seconds(c)
    if encoding == "epochMillis":
        return F.timestamp_millis(c)
    if encoding == "datetime":
        return F.to_utc_timestamp(c.cast("timestamp"), zone)
    raise ValueError(f"unknown encoding {encoding!r}")


def key_of(template: str, **tokens: Column) -> Column:
    """A key such as ``device:{id}:soc`` with each token's value; a null value makes the key null."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), tokens[name].cast("string")]
    return F.concat(*out, F.lit(rest))


def converted(c: Column, conversion: str) -> Column:
    """Text to number, integer or text; what doesn't convert is null."""
    if conversion == "text":
        return c
    number = c.try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("long")) if conversion == "integer" else number


def key_value(objects: DataFrame, key: Column, store: DataFrame, conversion: str = "text", field: str | None = None) -> DataFrame:
    """``objects`` with ``value`` from ``store`` (key, value; or key, fields: map): GET, or HGET of ``field``. Absent keys give null; no object is lost."""
    found = F.col("fields")[field] if field else F.col("value")
    side = store.select(F.col("key").alias("_key"), converted(found, conversion).alias("value"))
    return objects.withColumn("_key", key).join(side, "_key", "left").drop("_key")


def present(df: DataFrame, value: str, missing: str = "null") -> DataFrame:
    """``df`` under the policy for absent values: ``null`` leaves them, ``error`` raises when one is computed."""
    if missing not in ("null", "error"):
        raise ValueError(f"unknown policy {missing!r}")
    raised = F.raise_error(F.lit(f"no value for {value}")).cast(df.schema[value].dataType)
    return df if missing == "null" else df.withColumn(value, F.when(F.col(value).isNull(), raised).otherwise(F.col(value)))


#: Read commands over a store of one kind per key, as expressions of its column.
READS = {
    "EXISTS": lambda v: v.isNotNull(), "STRLEN": F.length, "HGETALL": lambda m: m, "HKEYS": lambda m: F.array_sort(F.map_keys(m)),
    "HVALS": F.map_values, "HLEN": F.size, "LLEN": F.size, "SMEMBERS": lambda a: F.array_sort(F.array_distinct(a)), "SCARD": lambda a: F.size(F.array_distinct(a)),
    "ZCARD": F.size, "ZRANGE": lambda z: F.transform(F.array_sort(F.transform(z, lambda x: F.struct(x["score"], x["member"]))), lambda x: x["member"]),
}


def registered(spark, rows: list[tuple[str, str]]) -> DataFrame:
    """Declared instances without a table: id and label."""
    return spark.createDataFrame(rows, "id string, label string")


def related(objects: DataFrame, left: str, source: DataFrame, right: str, value: str, name: str) -> DataFrame:
    """``objects`` with ``value`` of the one row of ``source`` that matches; two matching rows are an error when computed."""
    side = single(source.select(F.col(right).alias(left), F.col(value).alias(name)), left, name)
    return objects.join(side, left, "left")
