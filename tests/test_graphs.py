import pytest

from corvane.operators import graphs

NODES = [("a", "1"), ("b", "2"), ("c", None), ("d", ""), ("lone", "x"), (None, "no id")]
EDGES = [("a", "r", "b"), ("b", "r", "c"), ("d", "r", "ghost"), ("d", "r", "ghost"), ("a", "r", None)]


def graph(spark, nodes, edges, parts=1):
    return spark.createDataFrame(nodes, "id string, body string").repartition(parts), spark.createDataFrame(edges, "source string, relation string, target string").repartition(parts)


def signed(g):
    return {r.component: (r.n_nodes, r.n_edges, r.signature) for r in graphs.signatures(*g).collect()}


def test_signatures_do_not_depend_on_order_and_tell_components(spark):
    got = signed(graph(spark, NODES, EDGES))
    assert {k: v[:2] for k, v in got.items()} == {"a": (3, 2), "d": (1, 2), "lone": (1, 0)}
    assert signed(graph(spark, NODES[::-1], EDGES[::-1], 5)) == got
    changed = signed(graph(spark, [(i, "" if i == "c" else b) for i, b in NODES], EDGES))
    assert changed["a"] != got["a"] and changed["d"] == got["d"] and changed["lone"] == got["lone"]
    assert signed(graph(spark, NODES, EDGES[:3] + EDGES[4:]))["d"] != got["d"]
    assert signed(graph(spark, [], [])) == {}


@pytest.mark.parametrize("buckets", [1, 3, 65_536])
def test_diff(spark, monkeypatch, buckets):
    monkeypatch.setattr(graphs, "BUCKETS", buckets)
    old = graph(spark, NODES, EDGES)
    new = graph(spark, [("b", "2"), ("a", "9"), ("c", ""), ("d", ""), ("new", None)], [("a", "r", "b"), ("b", "s", "c"), ("d", "r", "ghost")], 3)
    got = {(r.kind, r.key, r.change) for r in graphs.diff(old, new).collect()}
    assert got == {
        ("node", "1:a", "changed"), ("node", "1:c", "changed"), ("node", "4:lone", "removed"), ("node", "3:new", "added"),
        ("edge", "1:b1:r1:c", "removed"), ("edge", "1:b1:s1:c", "added"), ("edge", "1:d1:r5:ghost", "changed"),
    }
    assert graphs.diff(old, graph(spark, NODES[::-1], EDGES[::-1], 4)).isEmpty()
    assert {r.change for r in graphs.diff(graph(spark, [], []), old).collect()} == {"added"}
