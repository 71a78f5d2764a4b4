"""The ontology's, flows' and formulas' types, and how they meet Spark's."""

from __future__ import annotations

import datetime
import decimal
from typing import Any

from pyspark.sql import types as T

#: Base types of the ontology. Decimals are kept exact in storage and are doubles in formulas.
ONTOLOGY = {
    "string": T.StringType(), "double": T.DoubleType(), "decimal": T.DecimalType(38, 18), "integer": T.LongType(), "boolean": T.BooleanType(),
    "date": T.DateType(), "dateTime": T.TimestampType(),
}
FLOW_TO_PROPERTY = {"number": {"double", "decimal", "integer"}, "text": {"string"}, "boolean": {"boolean"}, "datetime": {"dateTime"}}
FLOW_TO_FORMULA = {"number": "number", "text": "string", "boolean": "boolean"}


def series_of(value: str) -> T.ArrayType:
    """A time series: points of a time and a scalar value."""
    return T.ArrayType(T.StructType([T.StructField("timestamp", T.TimestampType()), T.StructField("value", ONTOLOGY[value])]))


def fits(source: Any, target: Any) -> bool:
    """Whether a flow value of type ``source`` may go where ``target`` is asked for.

    Types are names, {"list": element} or {"object": {field: type}}; an object may have more fields than asked for.
    """
    if isinstance(source, dict) and isinstance(target, dict):
        if "list" in source and "list" in target:
            return fits(source["list"], target["list"])
        if "object" in source and "object" in target:
            return all(f in source["object"] and fits(source["object"][f], t) for f, t in target["object"].items())
        return False
    return source == target


def nested(kind: Any) -> int:
    """Levels of objects; lists don't count."""
    if isinstance(kind, dict):
        if "list" in kind:
            return nested(kind["list"])
        return 1 + max(map(nested, kind["object"].values()), default=0)
    return 0


def json_value(v: Any, depth: int = 0) -> Any:
    """A value as JSON takes it: decimals as numbers, times as text, bytes as text, and text beyond eight levels."""
    if depth > 8:
        return str(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, (datetime.date, datetime.time)):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).decode("utf-8", "replace")
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return {str(k): json_value(x, depth + 1) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [json_value(x, depth + 1) for x in v]
    return v
