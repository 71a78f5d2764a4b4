"""Exact duplicates by skew-safe combining.

Equal texts are combined three times, and each time whole texts are compared,
not only digests: inside each task (Spark's partial aggregation), then per
(digest, salt), then per digest over the winners of the salts. The salt is the
task's number, so one text that fills a third of the table sends at most one
row per task into each salted group and at most ``salts`` rows into the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written
from .hashing import maybe

SALTS = 16


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body"))


def _digest(bits: int) -> F.Column:
    return F.unhex(F.sha2("body", 256)) if bits >= 256 else F.unhex(F.sha2("body", 256)).substr(1, max(1, bits // 8))


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest_bits: int = 256) -> DataFrame:
    """One row per distinct text: digest, size and second digest of the text, keep_id, group_size.

    ``digest_bits`` below 256 makes digests collide; tests use it to show that texts decide.
    """
    rows = _rows(docs, id_col, text_col).select("doc_id", "body", _digest(digest_bits).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = rows.groupBy("digest", "salt", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy("digest", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return whole.select("digest", F.octet_length("body").alias("size"), F.xxhash64("body").alias("second"), "keep_id", "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest_bits: int = 256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    * Null text counts as the empty text; empty texts form one group.
    * Of equal texts the row with the largest doc_id stays. Rows that repeat both
      id and text are one document: all of them say ``kept``; ``deduplicated``
      leaves one.
    * A null doc_id never wins against a number; a group of null ids only has a
      null keep_id and keeps its rows.
    * Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    best = winners(docs, id_col, text_col, salts, digest_bits)
    rows = _rows(docs, id_col, text_col).select(
        "doc_id",
        _digest(digest_bits).alias("digest"),
        F.octet_length("body").alias("size"),
        F.xxhash64("body").alias("second"),
        *([F.sha2("body", 256).alias("sha")] if digest_bits < 256 else []),
    )
    sha = F.col("sha") if digest_bits < 256 else F.lower(F.hex("digest"))
    return rows.join(best, ["digest", "size", "second"], "left").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), sha.alias("text_sha256")
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; rows repeating id and text leave one.

    A text whose 64-bit hash no other row has stays without a shuffle: hashes are counted first, and those that repeat
    set a bitmap. The other rows are combined by whole texts; the join deals them by (digest, id), so copies of one
    text go to many tasks.
    """
    own_hash = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    repeated = written(docs.groupBy(own_hash.alias("row_key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("row_key"), "repeated")
    may_repeat = maybe(repeated)(own_hash)
    forget(repeated)
    return docs.filter(~may_repeat).union(_one_of_each(docs.filter(may_repeat), id_col, text_col, salts))


def _one_of_each(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    digest, key, place = "_digest_of_text", "_id_of_text", "_place_of_row"
    null_id = F.lit(-(2**63))
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    best = winners(docs, id_col, text_col, salts).select(F.col("digest").alias(digest), F.coalesce("keep_id", null_id).alias(key))
    marked = docs.withColumns({digest: F.unhex(F.sha2(body, 256)), key: F.coalesce(F.col(id_col).cast("long"), null_id)})
    stay = marked.join(best, [digest, key], "left_semi")
    plain = [F.col(f"`{f.name}`") for f in docs.schema if f.name != text_col and f.dataType.typeName() in ("string", "long", "integer", "double")]
    first = Window.partitionBy(digest, key).orderBy(*plain)
    return stay.withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).select(*[f"`{c}`" for c in docs.columns])
