import dataclasses
import datetime

import pytest

from corvane.plans.flow import Node
from corvane.plans.flow_property import Binding, Flow, FlowPropertyError, Output, faults, scalar, series

ROWS = "SELECT i.instance, s.at, s.v * i.factor AS v FROM {instance} i JOIN {store} s ON s.k = i.code"
FLOW = Flow(
    [Node("rows", "sql", ["instance", "store"], {"template": ROWS}), Node("broken", "sql", ["rows"], {"template": "SELECT nothing FROM {rows}"}), Node("lost", "sql", ["rows"], {"template": "SELECT sum(v) AS value FROM {rows}"})],
    {"code": "text", "factor": "number"},
    {"one": Output("rows", "number", "v"), "list": Output("rows", {"v": "number", "at": "datetime"}), "broken": Output("broken", "number"), "lost": Output("lost", "number"), "wrong": Output("rows", "text", "v")},
)
BOUND = {"code": ("instanceId",), "factor": ("property", "weight")}
KINDS = {"weight": "number", "title": "text"}


@pytest.fixture(scope="module")
def tables(spark):
    at = datetime.datetime(2024, 1, 1)
    store = spark.createDataFrame([("1", at, 2.0), ("2", at, 3.0), ("2", at, 4.0), ("4", None, 5.0), (None, at, 6.0)], "k string, at timestamp, v double")
    objects = spark.createDataFrame([(1, 10.0), (2, 1.0), (3, 1.0), (4, 1.0), (4, 1.0), (None, 1.0)], "id long, weight double")
    return objects, {"store": store}


def test_one_row_none_and_several(spark, tables):
    got = {r.instance: (r.status, r.value) for r in scalar(spark, FLOW, Binding("one", BOUND), tables[0], "id", tables[1]).collect()}
    assert got == {1: ("ok", 20.0), 2: ("multiple", None), 3: ("missing", None), 4: ("ok", 5.0)}
    assert scalar(spark, FLOW, Binding("one", BOUND), tables[0].limit(0), "id", tables[1]).count() == 0


def test_a_list_becomes_points(spark, tables):
    got = series(spark, FLOW, Binding("list", BOUND, "v", "at"), tables[0], "id", tables[1]).collect()
    assert sorted((r.instance, r.value) for r in got) == [(1, 20.0), (2, 3.0), (2, 4.0)]


@pytest.mark.parametrize("output, said", [("broken", "broken: "), ("lost", "lost: the column instance is not handed on"), ("wrong", "rows: v is double, no text")])
def test_nodes_that_fail_say_so(spark, tables, output, said):
    with pytest.raises(FlowPropertyError, match=said):
        scalar(spark, FLOW, Binding(output, BOUND), tables[0], "id", tables[1])


def test_a_failure_beside_the_output_does_not_matter(spark, tables):
    assert scalar(spark, FLOW, Binding("one", BOUND | {"factor": ("constant", 1)}), tables[0], "id", tables[1]).filter("status = 'ok'").count() == 2


CASES = [
    (Binding("one", BOUND), "number", False, []),
    (Binding("list", BOUND, "v", "at"), "number", True, []),
    (Binding("none", BOUND), "number", False, ["no output none"]),
    (Binding("one", BOUND), "text", False, ["output is number, property is text"]),
    (Binding("one", BOUND), "number", True, ["a single value is no series"]),
    (Binding("list", BOUND), "number", False, ["a list is no single value"]),
    (Binding("list", BOUND, "at", "gone"), "number", True, ["value field at is no number", "no time field gone"]),
    (Binding("one", {"code": ("instanceId",)}), "number", False, ["input factor is not bound"]),
    (Binding("one", BOUND | {"more": ("instanceId",)}), "number", False, ["no input more"]),
    (Binding("one", BOUND | {"factor": ("property", "p")}), "number", False, ["input factor: the property needs itself"]),
    (Binding("one", BOUND | {"factor": ("property", "gone")}), "number", False, ["input factor: no single-valued property gone"]),
    (Binding("one", BOUND | {"factor": ("property", "title")}), "number", False, ["input factor: title is text, not number"]),
    (Binding("one", BOUND | {"factor": ("constant", True)}), "number", False, ["input factor: the constant is no number"]),
    (Binding("one", BOUND | {"factor": ("instanceId",)}), "number", False, ["input factor: an instance id is a text"]),
    (Binding("one", BOUND | {"factor": ("guess", 1)}), "number", False, ["input factor: unknown binding"]),
]


@pytest.mark.parametrize("binding, kind, is_series, said", CASES)
def test_faults(binding, kind, is_series, said):
    assert faults(FLOW, binding, "p", kind, KINDS, is_series) == said


def test_faults_of_the_graph():
    ring = dataclasses.replace(FLOW, nodes=[Node("rows", "sql", ["lost"]), Node("lost", "sql", ["rows"])])
    assert any(m.startswith("circle") for m in faults(ring, Binding("one", BOUND), "p", "number", KINDS))
