"""Running sums over groups of any size: no group is sorted in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.objects import cut_lineage


def group_key(*columns: str) -> Column:
    """One text for a group; null values make a group of their own."""
    return F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)]))


def placed(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], totals: Mapping[str, Column] | None = None, group: str = "_group") -> DataFrame:
    """``df`` with ``group``, ``_block``, for each of ``sums`` the sum over the rows before in its group, and for each of ``totals`` the sum over the group.

    Rows are dealt to blocks by ranges of (group, order); a block adds up its own rows, and the sums of the blocks before come from
    one row per group and block. Rows that agree in all of ``order`` share a block and have no defined order among themselves.
    """
    totals = totals or {}
    parts = {f"_part{i}": (name, c, name in totals) for i, (name, c) in enumerate([*sums.items(), *totals.items()])}
    dealt = df.select("*", group_key(*by).alias(group), *[c.cast("long").alias(p) for p, (_, c, _) in parts.items()])
    dealt = cut_lineage(dealt.repartitionByRange(group, *order).withColumn("_block", F.spark_partition_id()))
    blocks = dealt.groupBy(group, "_block").agg(*[F.sum(p).alias(p) for p in parts])
    whole = Window.partitionBy(group)
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(p).over(whole if is_total else before).alias(f"{p}c") for p, (_, _, is_total) in parts.items()]
    inside = Window.partitionBy(group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(blocks.select(group, "_block", *carried), [group, "_block"])
    zero = F.lit(0).cast("long")
    values = [F.coalesce(F.col(f"{p}c"), zero) + (zero if is_total else F.coalesce(F.sum(p).over(inside), zero)) for p, (_, _, is_total) in parts.items()]
    return out.select(*df.columns, group, "_block", *[v.alias(name) for v, (name, _, _) in zip(values, parts.values())])
