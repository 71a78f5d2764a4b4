"""What tables hold: fields with types and keys, as rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "table string, field string, place int, type string, key string"


def catalog(spark: SparkSession, tables: Mapping[str, DataFrame], keys: Mapping[str, str] | None = None) -> DataFrame:
    """One row per field; reading schemas touches no rows. ``keys`` names primary keys."""
    keys = keys or {}
    rows = [(name, f.name, i, f.dataType.simpleString(), "pri" if keys.get(name) == f.name else "") for name, df in tables.items() for i, f in enumerate(df.schema, 1)]
    return spark.createDataFrame(rows, FIELDS)


def fingerprint(config: Mapping) -> str:
    """A digest of a connection's settings, to tell whether a kept catalog is still of it."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(", ", ": "), ensure_ascii=False).encode()).hexdigest()


def profile(df: DataFrame) -> DataFrame:
    """field, rows, nulls and approximate distinct values of each column, in one pass without a row per value."""
    parts = [F.struct(F.lit(c).alias("field"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.approx_count_distinct(c).alias("distinct")) for c in df.columns]
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def health(spark: SparkSession) -> str:
    """'' or what is wrong with the session."""
    try:
        return "" if spark.sql("SELECT 1 AS x").first()["x"] == 1 else "wrong answer"
    except Exception as e:  # noqa: BLE001  whatever it is, the probe reports it
        return f"{type(e).__name__}: {str(e)[:200]}"
