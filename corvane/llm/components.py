"""Connected components by contraction in tasks and Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, tidied, written

#: Links that a task takes at a time.
LINKS = 1 << 17


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, and the smallest node that each reaches by them."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while True:
        low = np.minimum(root[u], root[v])
        after = root.copy()
        for x in (root[u], root[v], u, v):
            np.minimum.at(after, x, low)
        while (after != after[after]).any():
            after = after[after]
        if (after == root).all():
            return node, node[root]
        root = after


def components(edges: DataFrame, links: int = LINKS) -> DataFrame:
    """node, comp (the smallest node it reaches) for each node of ``edges`` (a, b: long).

    Each task contracts its share of the links, ``links`` at a time, to the smallest nodes it can reach. A node that
    shares reach under several such roots links them; these links are contracted likewise until none is left. A node
    of many links has one row per share, so no join key grows hot, and the driver sees counts.
    """
    nodes = written(edges.filter("a <> b").select("a", "b"), "edges")
    shares = max(1, -(-nodes.count() // links))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            node, root = contracted(table.column("a").to_numpy(), table.column("b").to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= links:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    stars = written(nodes.coalesce(shares).mapInArrow(run, "node long, root long"), "stars")
    labels = written(stars.groupBy("node").agg(F.min("root").alias("comp")), "labels")
    between = stars.join(labels, "node").filter("root <> comp").select(F.col("root").alias("a"), F.col("comp").alias("b")).distinct()
    if between.limit(1).count():
        roots = components(between, links).select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        after = written(labels.join(roots, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "labels")
        for done in (labels, roots):
            forget(done)
        labels = after
    for done in (nodes, stars):
        forget(done)
    return labels
