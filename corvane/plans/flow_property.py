"""A flow's output as a property of all objects at once.

The flow is not run object by object. Its input node ``instance`` is one table with a row per object: the object's key in ``instance``
and one column per input of the flow. Each node that the output needs hands the key on, so the whole graph is one plan.
"""

from __future__ import annotations

import datetime
import numbers
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.plans import flow

KEY = "instance"

#: How the kinds of values are held, what a column of them may be, and what a constant of them is.
HELD = {"text": "string", "number": "double", "boolean": "boolean", "datetime": "timestamp"}
COLUMNS = {"text": (T.StringType,), "number": (T.NumericType,), "boolean": (T.BooleanType,), "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType)}
CONSTANTS = {"text": str, "number": numbers.Real, "boolean": bool, "datetime": datetime.datetime}


@dataclass(frozen=True)
class Output:
    """``kind`` is the kind of ``column``, or for a list the kinds of its elements' fields."""

    node: str
    kind: str | Mapping[str, str]
    column: str = "value"


@dataclass(frozen=True)
class Flow:
    nodes: list[flow.Node]
    inputs: Mapping[str, str]
    outputs: Mapping[str, Output]


@dataclass(frozen=True)
class Binding:
    """``inputs``: from a flow's input to ("property", name), ("constant", value) or ("instanceId",). The fields make a list a series."""

    output: str
    inputs: Mapping[str, tuple] = field(default_factory=dict)
    value_field: str = ""
    time_field: str = ""


class FlowPropertyError(ValueError):
    pass


def _constant_fits(kind: str, value: Any) -> bool:
    return isinstance(value, CONSTANTS[kind]) and (kind == "boolean" or not isinstance(value, bool))


def faults(f: Flow, b: Binding, name: str, kind: str, properties: Mapping[str, str], series: bool = False) -> list[str]:
    """Why the property ``name`` of ``kind`` can't take its value from the flow; ``properties`` are the kinds of the object's single-valued properties."""
    out = flow.check([*f.nodes, *[flow.Node(i, "function") for i in sorted({i for n in f.nodes for i in n.inputs} - {n.id for n in f.nodes})]])
    chosen = f.outputs.get(b.output)
    if chosen is None:
        out.append(f"no output {b.output}")
    elif chosen.node not in {n.id for n in f.nodes}:
        out.append(f"output {b.output}: no node {chosen.node}")
    elif isinstance(chosen.kind, str):
        out += ["a single value is no series"] if series else [f"output is {chosen.kind}, property is {kind}"] if chosen.kind != kind else []
    elif not series:
        out.append("a list is no single value")
    else:
        for what, given, wanted in (("value field", b.value_field, "number"), ("time field", b.time_field, "datetime")):
            if given not in chosen.kind:
                out.append(f"no {what} {given}".rstrip())
            elif chosen.kind[given] != wanted:
                out.append(f"{what} {given} is no {wanted}")
    for i, wanted in f.inputs.items():
        match b.inputs.get(i):
            case None:
                out.append(f"input {i} is not bound")
            case ("property", p) if p == name:
                out.append(f"input {i}: the property needs itself")
            case ("property", p) if p not in properties:
                out.append(f"input {i}: no single-valued property {p}")
            case ("property", p) if properties[p] != wanted:
                out.append(f"input {i}: {p} is {properties[p]}, not {wanted}")
            case ("constant", value) if not _constant_fits(wanted, value):
                out.append(f"input {i}: the constant is no {wanted}")
            case ("instanceId",) if wanted != "text":
                out.append(f"input {i}: an instance id is a text")
            case ("property" | "constant", _) | ("instanceId",):
                pass
            case _:
                out.append(f"input {i}: unknown binding")
    return out + [f"no input {i}" for i in b.inputs if i not in f.inputs]


def _asked(instances: DataFrame, key: str, f: Flow, b: Binding) -> DataFrame:
    def column(i: str, kind: str):
        how, *what = b.inputs[i]
        value = F.col(what[0]) if how == "property" else F.lit(what[0]) if how == "constant" else F.col(key)
        return value.cast(HELD[kind]).alias(i)

    return instances.filter(F.col(key).isNotNull()).select(F.col(key).alias(KEY), *[column(i, kind) for i, kind in f.inputs.items()]).dropDuplicates([KEY])


def _needed(nodes: list[flow.Node], last: str) -> set[str]:
    by_id, out, todo = {n.id: n for n in nodes}, set(), [last]
    while todo:
        name = todo.pop()
        if name not in out and name in by_id:
            out.add(name)
            todo += by_id[name].inputs
    return out


def _result(spark: SparkSession, f: Flow, b: Binding, asked: DataFrame, tables: Mapping[str, DataFrame], params: Mapping[str, Any] | None) -> DataFrame:
    """The rows of the output's node; an error says which node lost the key or failed."""
    chosen = f.outputs[b.output]
    done = flow.run(spark, f.nodes, dict(params or {}), {**tables, KEY: asked}, only=_needed(f.nodes, chosen.node))
    for n in f.nodes:
        if n.id in done and done[n.id].status == "failed":
            raise FlowPropertyError(f"{n.id}: {done[n.id].message}")
    from_instances = {KEY}
    for name in (name for name in done if name not in tables):
        node = next((n for n in f.nodes if n.id == name), None)
        if node and from_instances & set(node.inputs):
            from_instances.add(name)
            if KEY not in done[name].data.columns:
                raise FlowPropertyError(f"{name}: the column {KEY} is not handed on")
    if chosen.node not in from_instances:
        raise FlowPropertyError(f"{chosen.node}: reads no instance")
    out = done[chosen.node].data
    for column, kind in {chosen.column: chosen.kind}.items() if isinstance(chosen.kind, str) else chosen.kind.items():
        if column not in out.columns:
            raise FlowPropertyError(f"{chosen.node}: no column {column}")
        if not isinstance(out.schema[column].dataType, COLUMNS[kind]):
            raise FlowPropertyError(f"{chosen.node}: {column} is {out.schema[column].dataType.simpleString()}, no {kind}")
    return out


def scalar(spark: SparkSession, f: Flow, b: Binding, instances: DataFrame, key: str, tables: Mapping[str, DataFrame], params: Mapping[str, Any] | None = None) -> DataFrame:
    """instance, status, value: ``ok`` for one row of the output, ``missing`` for none, ``multiple`` for several (without a value).

    Objects without a key are none; repeated keys are one object with the inputs of one of its rows.
    """
    asked = _asked(instances, key, f, b)
    out = _result(spark, f, b, asked, tables, params)
    chosen = f.outputs[b.output]
    got = out.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"), F.first(F.col(chosen.column).cast(HELD[chosen.kind])).alias("_value"))
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") == 1, "ok").otherwise("multiple")
    return asked.select(KEY).join(got, KEY, "left").select(KEY, status.alias("status"), F.when(F.col("_n") == 1, F.col("_value")).alias("value"))


def series(spark: SparkSession, f: Flow, b: Binding, instances: DataFrame, key: str, tables: Mapping[str, DataFrame], params: Mapping[str, Any] | None = None) -> DataFrame:
    """instance, time, value: the elements of a list output. Elements without a time are no points; objects without points have no row."""
    asked = _asked(instances, key, f, b)
    out = _result(spark, f, b, asked, tables, params)
    points = out.select(KEY, F.col(b.time_field).cast("timestamp").alias("time"), F.col(b.value_field).cast("double").alias("value"))
    return points.filter(F.col("time").isNotNull()).join(asked.select(KEY), KEY, "left_semi")
