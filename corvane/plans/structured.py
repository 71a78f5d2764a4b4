"""Structured query rules over all instances at once: each step is a join on what is known so far.

A step names a table, conditions and the fields it takes. A condition's value is
a literal, ``{{inputs.name}}`` or ``{{steps.step.alias}}``. All steps but the last
expect one row per instance, so the whole rule is a chain of joins that Spark
plans as one query; nothing is read by the driver.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.predicates import column, literal
from corvane.plans.rules import RuleError

OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte")
REFERENCE = re.compile(r"\{\{(?:inputs\.(\w+)|steps\.(\w+)\.(\w+))\}\}")


@dataclass(frozen=True)
class Step:
    """``where``: (field, operator, value). ``select``: alias to field."""

    id: str
    table: str
    where: tuple[tuple[str, str, Any], ...]
    select: Mapping[str, str]
    many: bool = False


@dataclass(frozen=True)
class Rule:
    """``value`` and, for a time series, ``timestamp`` are aliases of the last step; without ``timestamp`` the result is one value."""

    steps: tuple[Step, ...]
    inputs: tuple[str, ...]
    value: str
    timestamp: str | None = None

    def faults(self) -> list[str]:
        out, known = [], {}
        if not self.steps:
            return ["a rule has a step"]
        for n, s in enumerate(self.steps):
            if s.id in known:
                out.append(f"{s.id}: repeated step")
            if not s.where or not s.select:
                out.append(f"{s.id}: needs a condition and a field")
            if s.many and n < len(self.steps) - 1:
                out.append(f"{s.id}: only the last step may give many rows")
            for _, op, value in s.where:
                if op not in OPERATORS:
                    out.append(f"{s.id}: unknown operator {op}")
                m = REFERENCE.fullmatch(value) if isinstance(value, str) else None
                if m and (m[1] not in self.inputs if m[1] else m[3] not in known.get(m[2], ())):
                    out.append(f"{s.id}: {value} isn't known there")
                if not m and isinstance(value, str) and "{{" in value:
                    out.append(f"{s.id}: malformed reference {value}")
            known[s.id] = set(s.select)
        last = self.steps[-1]
        if self.value not in last.select:
            out.append("the value is a field of the last step")
        if self.timestamp is None and last.many:
            out.append("one value comes from a step of one row")
        if self.timestamp is not None and (not last.many or self.timestamp not in last.select or self.timestamp == self.value):
            out.append("a time series has two fields of a last step of many rows")
        return out


def _compared(left: Column, op: str, right: Column) -> Column:
    return {"eq": left == right, "ne": left != right, "gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[op]


def _side(s: Step, table: DataFrame) -> tuple[DataFrame, list[Column], bool]:
    """The step's rows under its own names, the conditions on earlier values, and whether one of these is an equality."""
    own, refs, equal = [], [], False
    for n, (name, op, value) in enumerate(s.where):
        m = REFERENCE.fullmatch(value) if isinstance(value, str) else None
        if m:
            refs.append(_compared(F.col(f"_{s.id}_w{n}"), op, F.col(f"_in_{m[1]}" if m[1] else f"_{m[2]}_{m[3]}")))
            equal |= op == "eq"
        else:
            own.append(_compared(column(table, name), op, F.lit(literal(table.schema[name].dataType, value))))
    rows = table.filter(reduce(lambda a, b: a & b, own)) if own else table
    keys = [column(table, name).alias(f"_{s.id}_w{n}") for n, (name, _, _) in enumerate(s.where)]
    return rows.select(*keys, *[column(table, f).alias(f"_{s.id}_{a}") for a, f in s.select.items()], F.lit(True).alias("_hit")), refs, equal


def run(instances: DataFrame, key: str, rule: Rule, tables: Mapping[str, DataFrame], inputs: Mapping[str, str]) -> DataFrame:
    """key, status and value, or series: array<struct<timestamp, value>> by ascending time, per instance.

    * A step of one row that finds none or several makes the status ``missing`` or ``multiple``, and the result is null.
    * A series without rows is empty, and null values stay. Ranges are half-open if the rule writes gte and lt.
    * ``key`` is unique in ``instances``; ``inputs`` maps the rule's inputs to its columns.
    """
    if bad := rule.faults() + [f"no column for input {i}" for i in rule.inputs if i not in inputs]:
        raise RuleError("; ".join(bad))
    now = instances.select(F.col(key), *[F.col(c).alias(f"_in_{i}") for i, c in inputs.items()]).withColumn("status", F.lit("ok"))
    for s in rule.steps:
        rows, refs, equal = _side(s, tables[s.table])
        if refs and not equal:
            raise RuleError(f"{s.id}: a step that refers to earlier values needs an equality among them")
        # Without a reference the step is the same for all instances: two rows at most tell whether it has one.
        joined = now.join(rows, reduce(lambda a, b: a & b, refs), "left") if refs else now.join(F.broadcast(rows if s.many else rows.limit(2)), F.lit(True), "left")
        kept = [F.first(c).alias(c) for c in now.columns if c != key]
        if s.many:
            at, value = F.col(f"_{s.id}_{rule.timestamp}"), F.col(f"_{s.id}_{rule.value}")
            point = F.when(F.col("_hit"), F.struct(at.alias("timestamp"), value.alias("value")))
            out = joined.groupBy(key).agg(F.first("status").alias("status"), F.sort_array(F.collect_list(point)).alias("series"))
            return out.withColumn("series", F.when(F.col("status") == "ok", F.col("series")))
        found = [F.first(f"_{s.id}_{a}").alias(f"_{s.id}_{a}") for a in s.select]
        now = joined.groupBy(key).agg(F.count("_hit").alias("_n"), *kept, *found)
        status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("_n") == 0, "missing").when(F.col("_n") > 1, "multiple").otherwise("ok")
        now = now.withColumn("status", status).drop("_n")
    return now.select(key, "status", F.when(F.col("status") == "ok", F.col(f"_{rule.steps[-1].id}_{rule.value}")).alias("value"))
