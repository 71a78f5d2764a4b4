"""Computed properties: inline SQL per instance, formulas that build on each other, contracts, and shapes of results."""

from __future__ import annotations

import graphlib
import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import calc
from corvane.functions.sqltemplate import one_query

INSTANCE = re.compile(r"'(?:[^'\\]|''|\\.)*'|(?<![:\w]):instanceId\b")


def sql_property(instances: DataFrame, key: str, name: str, sql: str, tables: Mapping[str, DataFrame], **params: Any) -> DataFrame:
    """``instances`` with ``name`` from one SELECT that may ask for ``:instanceId`` and other parameters.

    The SELECT becomes a scalar subquery correlated by the key, which Catalyst turns into one join
    for all instances. Several rows of one instance are an error when computed; none is null.
    """
    if not re.match(r"\s*select\b", sql, re.I):
        raise ValueError("inline SQL is one SELECT")
    asked = INSTANCE.sub(lambda m: m[0] if m[0].startswith("'") else f"_o.`{key}`", one_query(sql))
    used = {k: v for k, v in params.items() if re.search(rf"(?<![:\w]):{k}\b", asked)}
    return instances.sparkSession.sql(f"SELECT _o.*, (\n{asked}\n) AS `{name}` FROM {{_instances}} _o", args=used, _instances=instances, **tables)


def order_of(needs: Mapping[str, list[str]]) -> list[str]:
    """Properties so that each follows what it needs; a circle is an error that names its members."""
    try:
        return [p for p in graphlib.TopologicalSorter({p: sorted(needs[p]) for p in sorted(needs)}).static_order() if p in needs]
    except graphlib.CycleError as e:
        raise ValueError("circle: " + " > ".join(e.args[1])) from None


def calculated(df: DataFrame, formulas: Mapping[str, str]) -> DataFrame:
    """``df`` with a column per formula, and ``errors``: the names whose formula failed in a row. Formulas may use each other's results."""
    needs = {name: calc.inputs(f) for name, f in formulas.items()}
    if unknown := sorted({i for n in needs.values() for i in n} - set(formulas) - set(df.columns)):
        raise ValueError(f"unknown inputs {unknown}")
    failed = []
    for name in order_of(needs):
        df = df.withColumn(f"_{name}", calc.collect(formulas[name], {i: i for i in needs[name]}))
        df = df.withColumn(name, F.col(f"_{name}.value"))
        failed.append(F.when(F.col(f"_{name}.error").isNotNull(), F.lit(name)))
    return df.withColumn("errors", F.array_sort(F.filter(F.array(*failed), lambda x: x.isNotNull()))).drop(*[f"_{n}" for n in formulas])


@dataclass(frozen=True)
class Contract:
    """What a calculation takes and gives; an implementation is a set of formulas for its outputs."""

    inputs: tuple[str, ...]
    outputs: tuple[str, ...]


def implemented(df: DataFrame, parts: Mapping[str, tuple[Contract, Mapping[str, str]]]) -> DataFrame:
    """``df`` with the outputs of several implementations, each of which may take the outputs of others."""
    merged: dict[str, str] = {}
    for name, (contract, formulas) in parts.items():
        if absent := sorted(set(contract.outputs) - set(formulas)):
            raise ValueError(f"{name} has no {absent}")
        if stray := sorted({i for f in formulas.values() for i in calc.inputs(f)} - set(contract.inputs) - set(formulas)):
            raise ValueError(f"{name} takes {stray} beside its contract")
        if twice := sorted(set(formulas) & set(merged)):
            raise ValueError(f"{twice} come from two implementations")
        merged |= formulas
    kept = [o for contract, _ in parts.values() for o in contract.outputs]
    return calculated(df, merged).select(*df.columns, *kept, "errors")


def declared(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """Only the declared columns, and the others' names; a declared one that is absent is an error."""
    if absent := [n for n in names if n not in df.columns]:
        raise ValueError(f"declared outputs {absent} are absent")
    return df.select(*names), [c for c in df.columns if c not in names]


def shaped(df: DataFrame, kind: str, order: list[Column]) -> DataFrame:
    """``list``: all rows. ``object``: the first row. Any other kind: ``value``, the first row's first column. No row gives a row of nulls."""
    if kind == "list":
        return df
    one = df.orderBy(*order).limit(1)
    if kind == "object":
        return one.groupBy().agg(*[F.first(c).alias(c) for c in df.columns])
    return one.groupBy().agg(F.first(df.columns[0]).alias("value"))


def field_path(root: str, declaration: Mapping[str, Any], ids: list[str]) -> Column:
    """The nested field that stable ids name. ``declaration``: {"type": "object", "fields": [{"id", "name", "type"}]}."""
    out = F.col(root)
    for i in ids:
        field = next((f for f in declaration.get("fields", ()) if f["id"] == i), None) if declaration.get("type") == "object" else None
        if field is None:
            raise ValueError(f"no field {i!r} in {root}")
        out, declaration = out.getField(field["name"]), field.get("type", {})
    return out
