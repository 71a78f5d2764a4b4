"""An ontology's graph as tables: groups of nodes, and JSON-LD text of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Node types of the JSON-LD form by group; a vocabulary of one's own is a parameter of ``decoded`` and ``encoded``.
STANDARD = {"objectTypes": "owl:Class", "linkTypes": "owl:ObjectProperty", "properties": "owl:DatatypeProperty"}
NODE = "struct<`@id`:string,`@type`:string,name:string,domain:string,range:string>"


def decoded(documents: DataFrame, column: str = "value", vocabulary: dict[str, str] = STANDARD) -> DataFrame:
    """group, id, name, domain, range of the nodes of JSON-LD documents. Unknown node types are kept with a null group."""
    names = F.create_map(*[F.lit(x) for g, t in vocabulary.items() for x in (t, g)])
    nodes = documents.select(F.explode(F.from_json(F.get_json_object(column, "$.@graph"), f"array<{NODE}>")).alias("n"))
    return nodes.select(names[F.col("n.@type")].alias("group"), F.col("n.@id").alias("id"), F.col("n.name").alias("name"), F.col("n.domain").alias("domain"), F.col("n.range").alias("range"))


def encoded(nodes: DataFrame, by: str, vocabulary: dict[str, str] = STANDARD) -> DataFrame:
    """by and value: one JSON-LD document per ``by``, nodes in order of their ids."""
    types = F.create_map(*[F.lit(x) for kv in vocabulary.items() for x in kv])
    node = F.struct(F.col("id").alias("@id"), types[F.col("group")].alias("@type"), "name", "domain", "range")
    return nodes.groupBy(by).agg(F.to_json(F.struct(F.array_sort(F.collect_list(node)).alias("@graph"))).alias("value"))


def edges(nodes: DataFrame) -> DataFrame:
    """kind, source, target of the graph: links from domain to range, properties to their object type."""
    links = nodes.filter(F.col("group") == "linkTypes").select(F.lit("link").alias("kind"), F.col("domain").alias("source"), F.col("range").alias("target"))
    owned = nodes.filter(F.col("group") == "properties").select(F.lit("property").alias("kind"), F.col("id").alias("source"), F.col("domain").alias("target"))
    return links.unionByName(owned)


def users(edges_: DataFrame, target: str) -> DataFrame:
    """Who refers to ``target``: what a deletion would break."""
    return edges_.filter(F.col("target") == target).select("kind", "source")


def cardinality_faults(links: DataFrame, source: str, target: str, kind: str) -> DataFrame:
    """Ends that have more partners than a link of ``kind`` allows: side, value, n."""
    parts = []
    if kind in ("one-to-one", "many-to-one"):
        parts.append(links.groupBy(F.lit("source").alias("side"), F.col(source).cast("string").alias("value")).agg(F.countDistinct(target).alias("n")))
    if kind in ("one-to-one", "one-to-many"):
        parts.append(links.groupBy(F.lit("target").alias("side"), F.col(target).cast("string").alias("value")).agg(F.countDistinct(source).alias("n")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.filter("n > 1")
