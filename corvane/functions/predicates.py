"""Conditions of a membership rule as one Column: a conjunction over whitelisted fields."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("eq", "ne", "in", "isnull", "notnull", "gt", "gte", "lt", "lte", "contains")
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: Any = None


def literal(kind: T.DataType, value: Any) -> Any:
    """A literal of the column's type; Spark's own coercion would also take '1' for 1.5."""
    if isinstance(kind, INTEGERS):
        number = float(value)
        if number != int(number):
            raise ValueError(f"{value!r} is not an integer")
        return int(number)
    if isinstance(kind, T.NumericType):
        return float(value)
    if isinstance(kind, T.BooleanType):
        if not isinstance(value, bool):
            raise ValueError(f"{value!r} is not a boolean")
        return value
    return value if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else str(value)


def column(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        raise ValueError(f"unknown field {name!r}")
    return F.col(f"`{name}`")


def compiled(df: DataFrame, c: Condition) -> Column:
    if c.op not in OPERATORS:
        raise ValueError(f"unknown operator {c.op!r}")
    col, kind = column(df, c.field), df.schema[c.field].dataType
    if c.op in ("isnull", "notnull"):
        if c.value is not None:
            raise ValueError(f"{c.op} takes no value")
        return col.isNull() if c.op == "isnull" else col.isNotNull()
    if c.op == "in":
        if not c.value:
            raise ValueError("in needs a list that isn't empty")
        return col.isin([literal(kind, v) for v in c.value])
    if c.op == "contains":
        return F.lower(col.cast("string")).contains(str(c.value).lower())
    v = F.lit(literal(kind, c.value))
    return {"eq": col == v, "ne": col != v, "gt": col > v, "gte": col >= v, "lt": col < v, "lte": col <= v}[c.op]


def conjunction(df: DataFrame, conditions: Iterable[Condition], scope: str = "filtered") -> Column:
    """All conditions together; ``scope`` all takes none, filtered needs at least one."""
    parts = [compiled(df, c) for c in conditions]
    if scope == "all":
        return F.lit(True)
    if not parts:
        raise ValueError("a filtered scope needs a condition")
    return reduce(lambda a, b: a & b, parts)


def explored(df: DataFrame, text: str = "", field: str | None = None, op: str = "present", value: str = "") -> Column:
    """The filter of an object list: ``text`` anywhere in the row, whatever its case, and one test of a property.

    Tests: missing, present, contains, eq (as text), gte, lte (numbers only). A null or empty property only meets ``missing``.
    """
    row = F.lower(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    found = row.contains(text.strip().lower()) if text.strip() else F.lit(True)
    if field is None:
        return found
    shown = column(df, field).cast("string")
    missing = shown.isNull() | (shown == "")
    if op in ("missing", "present"):
        return found & (missing if op == "missing" else ~missing)
    if op in ("contains", "eq"):
        return found & ~missing & (F.lower(shown).contains(value.lower()) if op == "contains" else shown == value)
    if op not in ("gte", "lte"):
        raise ValueError(f"unknown operator {op!r}")
    try:
        limit = float(value)
    except ValueError:
        return F.lit(False)
    number = column(df, field)
    if not isinstance(df.schema[field].dataType, T.NumericType):
        return F.lit(False)
    return found & ~missing & (number >= limit if op == "gte" else number <= limit)
