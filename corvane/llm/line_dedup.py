"""Line dedup with overlapping windows of three lines, in DataFrame functions only.

Each three consecutive lines of a text are hashed. The first occurrence of a
window, by doc_id and then by line, stays; a later one covers its three lines.
The lines that any later window covers are removed; overlapping windows merge,
since a covered line goes once.

Only hashes, ids and line numbers are shuffled. Windows are counted first,
inside tasks as far as possible, and only those that repeat are joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES = 3


def _lined(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("row_key"), text.alias("body"), F.split(text, "\n", -1).alias("lines"))


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, row_key, line (from 0) and two hashes of each window's lines, line lengths included."""
    lined = _lined(docs).filter(F.size("lines") >= size)
    own = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x, F.octet_length(x)).alias("b")))
    hashed = lined.select("doc_id", "row_key", own.alias("h"))
    at = F.explode(F.sequence(F.lit(0), F.size("h") - size))
    placed = hashed.select("doc_id", "row_key", "h", at.alias("line"))
    each = lambda name: [F.col("h")[F.col("line") + k][name] for k in range(size)]
    return placed.select("doc_id", "row_key", "line", F.xxhash64(*each("a")).alias("a"), F.xxhash64(*each("b")).alias("b"))


def removed_lines(docs: DataFrame, size: int = LINES) -> DataFrame:
    """One row per document that loses lines: doc_id, row_key, gone (sorted line numbers from 0)."""
    windows = _windows(docs, size)
    first = windows.groupBy("a", "b").agg(F.min(F.struct("doc_id", "row_key", "line")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = windows.join(first, ["a", "b"]).filter(~F.struct("doc_id", "row_key", "line").eqNullSafe(F.col("first")))
    covered = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("line"), F.col("line") + size - 1)))))
    return later.groupBy("doc_id", "row_key").agg(covered.alias("gone"))


def without_repeated_lines(docs: DataFrame, size: int = LINES) -> DataFrame:
    """One row per document: doc_id, kept_text, n_lines, n_removed.

    * Lines end at line feeds; a null text is one empty line, as is an empty one. Texts under three lines stay whole.
    * Lines are compared as they are, empty ones too, so a run of empty lines counts as a window like any other.
    * Repeated rows (same id and text) are one occurrence: they lose the same lines.
    * Rows with a null doc_id come first in order. An empty table gives an empty result; other columns are ignored.
    """
    gone = removed_lines(docs, size).select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key"), "gone")
    whole = _lined(docs).select("doc_id", "row_key", "body")
    lines = F.split("body", "\n", -1)
    kept = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull())
    return whole.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("row_key") == F.col("gone_key")), "left").select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )


def report(docs: DataFrame, size: int = LINES) -> DataFrame:
    """``without_repeated_lines`` with a digest in place of the text: doc_id, n_lines, n_removed, kept_sha256."""
    return without_repeated_lines(docs, size).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
