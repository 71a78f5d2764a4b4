"""Value flows: a graph of SQL, formula, key-value and function nodes over DataFrames.

A node's output is a lazy DataFrame; nothing runs until a result is asked for, so
Spark plans a chain of nodes as one query.
"""

from __future__ import annotations

import graphlib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import calc, sqltemplate
from corvane.sources import properties

KINDS = ("sql", "calc", "kv", "function")


@dataclass
class Node:
    """``inputs``: names of nodes it reads. ``spec``: what its kind asks for."""

    id: str
    kind: str
    inputs: list[str] = field(default_factory=list)
    spec: dict[str, Any] = field(default_factory=dict)


@dataclass
class Outcome:
    status: str
    data: DataFrame | None = None
    message: str = ""


def check(nodes: list[Node]) -> list[str]:
    """What is wrong with a graph: repeated ids, unknown kinds and inputs, circles."""
    ids = [n.id for n in nodes]
    out = [f"repeated id {i}" for i in sorted({i for i in ids if ids.count(i) > 1})]
    out += [f"{n.id}: unknown kind {n.kind}" for n in nodes if n.kind not in KINDS]
    out += [f"{n.id}: unknown input {i}" for n in nodes for i in n.inputs if i not in ids]
    try:
        list(graphlib.TopologicalSorter({n.id: n.inputs for n in nodes}).static_order())
    except graphlib.CycleError as e:
        out.append("circle: " + " > ".join(e.args[1]))
    return out


def _sql(spark: SparkSession, n: Node, data: dict[str, DataFrame], params: dict[str, Any]) -> DataFrame:
    sql, args = sqltemplate.render(n.spec["template"], params)
    df = spark.sql(sqltemplate.read_only(sql), args=args, **data)
    return df.limit(n.spec["max_rows"]) if n.spec.get("max_rows") else df


def _calc(spark: SparkSession, n: Node, data: dict[str, DataFrame], params: dict[str, Any]) -> DataFrame:
    df = data[n.inputs[0]]
    for name, formula in n.spec["outputs"].items():
        df = df.withColumn(name, calc.collect(formula, {i: i for i in calc.inputs(formula)})["value"])
    return df


def _kv(spark: SparkSession, n: Node, data: dict[str, DataFrame], params: dict[str, Any]) -> DataFrame:
    df = data[n.inputs[0]]
    key = properties.key_of(n.spec["key"], **{c: F.col(c) for c in df.columns})
    return properties.key_value(df, key, data[n.inputs[1]], n.spec.get("conversion", "text")).withColumnRenamed("value", n.spec.get("as", "value"))


def _function(spark: SparkSession, n: Node, data: dict[str, DataFrame], params: dict[str, Any]) -> DataFrame:
    return n.spec["call"](*[data[i] for i in n.inputs])


RUN: dict[str, Callable[..., DataFrame]] = {"sql": _sql, "calc": _calc, "kv": _kv, "function": _function}


def run(spark: SparkSession, nodes: list[Node], params: dict[str, Any] | None = None, given: dict[str, DataFrame] | None = None, only: set[str] | None = None) -> dict[str, Outcome]:
    """Outcome per node. A failed node makes those that need it ``skipped``; others still run.

    ``given`` stands in for nodes' results; ``only`` runs a part of the graph.
    """
    given = given or {}
    bad = [m for m in check([n for n in nodes] + [Node(g, "function") for g in given if g not in {n.id for n in nodes}])]
    if bad:
        raise ValueError("; ".join(bad))
    by_id = {n.id: n for n in nodes}
    out = {g: Outcome("given", df) for g, df in given.items()}
    for name in graphlib.TopologicalSorter({n.id: n.inputs for n in nodes}).static_order():
        if name in out or name not in by_id or (only and name not in only):
            continue
        n = by_id[name]
        if any(i not in out or out[i].data is None for i in n.inputs):
            out[name] = Outcome("skipped", message="an input has no result")
            continue
        try:
            df = RUN[n.kind](spark, n, {i: out[i].data for i in n.inputs}, params or {})
            df.schema  # noqa: B018  names and types are settled here, so a bad node fails by itself
            out[name] = Outcome("ok", df)
        except Exception as e:  # noqa: BLE001  the rest of the graph goes on, and the outcome says what failed
            out[name] = Outcome("failed", message=f"{type(e).__name__}: {str(e).splitlines()[0]}")
    return out
