"""Signatures of graphs that don't depend on any order, and what differs between two versions.

A graph is two tables: nodes (id, body) and edges (source, relation, target). ``body`` is a text with all that counts as a node's content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import objects

#: A diff first compares sums over so many buckets of keys: the only rows that it broadcasts.
BUCKETS = 65_536


def _sized(c: str) -> Column:
    """A value with its length before it, so that no two rows of values read alike; null is ``-``."""
    text = F.col(c).cast("string")
    return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (node, edge), key, at (the node, or the edge's source), digest of key and body. A node without id and an edge without an end are none."""
    n = nodes.filter("id IS NOT NULL").select(F.lit("node").alias("kind"), _sized("id").alias("key"), F.col("id").cast("string").alias("at"), F.md5(F.concat(F.lit("node "), _sized("id"), _sized("body"))).alias("digest"))
    key = F.concat(_sized("source"), _sized("relation"), _sized("target"))
    e = edges.filter("source IS NOT NULL AND target IS NOT NULL").select(F.lit("edge").alias("kind"), key.alias("key"), F.col("source").cast("string").alias("at"), F.md5(F.concat(F.lit("edge "), key)).alias("digest"))
    return n.unionByName(e)


def _halves() -> list[Column]:
    """Two sums of 60 bits each of all digests: sums don't depend on the order, and equal rows count as often as they are there."""
    part = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("decimal(38,0)")
    return [F.sum(part(1)).alias("a"), F.sum(part(16)).alias("b")]


def signatures(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """component (its smallest id), n_nodes, n_edges, signature per connected component; an end of an edge that is no node still joins components.

    Elements are added up per node before they meet their component, so neither a hub nor a large component is a hot key.
    """
    per_node = elements(nodes, edges).groupBy("at").agg(F.count_if(F.col("kind") == "node").alias("nodes"), F.count_if(F.col("kind") == "edge").alias("edges"), *_halves())
    ends = edges.filter("source IS NOT NULL AND target IS NOT NULL").select(F.col("source").cast("string").alias("x"), F.col("target").cast("string").alias("y")).distinct()
    of_node = objects.connected(ends, "x", "y").select(F.col("node").alias("at"), "component")
    met = per_node.join(of_node, "at", "left").withColumn("component", F.coalesce("component", "at"))
    sums = met.groupBy("component").agg(F.sum("nodes").alias("n_nodes"), F.sum("edges").alias("n_edges"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return sums.select("component", "n_nodes", "n_edges", F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")).alias("signature"))


def _bucketed(e: DataFrame) -> DataFrame:
    return e.withColumn("bucket", F.pmod(F.xxhash64("kind", "key"), F.lit(BUCKETS)).cast("int"))


def diff(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> DataFrame:
    """kind, key, change (added, removed, changed): what the new graph (nodes, edges) has otherwise than the old one.

    Both sides are added up by bucket of the key. Only rows of buckets whose sums differ are shuffled and compared. An element that is there
    several times counts with all its rows; one with other counts or bodies is ``changed``.
    """
    a, b = (_bucketed(elements(*side)) for side in (old, new))
    sides = [x.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *_halves()) for x in (a, b)]
    same = sides[0].join(sides[1], ["bucket", "n", "a", "b"], "left_semi").select("bucket")
    differ = F.broadcast(sides[0].unionByName(sides[1]).select("bucket").distinct().join(same, "bucket", "left_anti"))

    def rest(x: DataFrame, name: str) -> DataFrame:
        sums = x.join(differ, "bucket", "left_semi").groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), *_halves())
        return sums.select("kind", "key", F.struct("n", "a", "b").alias(name))

    both = rest(a, "_old").join(rest(b, "_new"), ["kind", "key"], "full_outer").filter("NOT _old <=> _new")
    return both.select("kind", "key", F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed").alias("change"))
