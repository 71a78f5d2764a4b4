"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

1. Count the benchmark's terms over the whole corpus.
2. In each window of a benchmark item, take the two rarest terms as its anchors.
3. Store the anchors' postings: term, document, position, and the words around it.
4. Shift each posting by the anchor's place in the item. Equal shifts of one
   document and item lie on a diagonal; postings of a window's two rarest terms
   that meet on a diagonal are a candidate, and neighbouring diagonals are
   proximity matches.
5. From a candidate, compare the words around it with the item's to both sides.
   Runs as long as a window are exact phrases.

Terms of few occurrences decide what is looked at, so rows follow the number of
matches, not the size of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WINDOW, SLOP = 10, 5
#: Terms, and anchors of the benchmark, and documents with hits, up to which their table is broadcast; beyond it Spark shuffles.
MOST_BROADCAST = 500_000
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of 0-9, a-z and all that isn't ASCII, after lower-casing A-Z only."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, SEPARATORS, -1), "")


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MOST_BROADCAST else df


def anchors(docs_words: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, item_key, term, at (offset in the item), least (words of a window), item_words, for the rarest two terms of each window."""
    terms = items.select(F.explode("words").alias("term")).distinct()
    n_terms = terms.count()
    counts = docs_words.select(F.explode("words").alias("term")).join(_small(terms, n_terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    placed = items.select("item_id", "item_key", "least", F.size("words").alias("m"), F.posexplode("words").alias("at", "term"))
    rated = placed.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    offsets = F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("least") + 1), F.least(F.col("at"), F.col("m") - F.col("least")))
    in_window = rated.withColumn("first", F.explode(offsets))
    rare = Window.partitionBy("item_key", "first").orderBy("n", "term", "at")
    ranked = in_window.withColumn("rank", F.row_number().over(rare)).withColumn("absent", F.min("n").over(rare.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == 0)
    chosen = ranked.filter("rank <= 2 AND NOT absent")
    windows = lambda r: F.sort_array(F.collect_list(F.when(F.col("rank") == r, F.col("first"))))
    return chosen.groupBy("item_id", "item_key", "term", "at", "least").agg(windows(1).alias("rarest"), windows(2).alias("second"))


def postings(docs_words: DataFrame, terms: DataFrame, n_terms: int, reach: int) -> DataFrame:
    """The positional index of ``terms``: term, doc_id, row_key, pos, and around: the words from ``reach`` before to ``reach`` after."""
    spread = docs_words.select("doc_id", "row_key", "words", F.posexplode("words").alias("pos", "term"))
    near = F.slice("words", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(reach)) + reach + 1)
    return spread.join(_small(terms, n_terms), "term").select("term", "doc_id", "row_key", "pos", near.alias("around"))


def _run(x: Column, item_words: Column, reach: int, step: int) -> Column:
    """How many words in a row agree from the posting ``x`` outwards, at most ``reach``."""
    mine = F.least(x["pos"], F.lit(reach))

    def agrees(k: Column) -> Column:
        there = F.get(item_words, x["at"] + k * step)
        return there.isNotNull() & F.get(x["around"], mine + k * step).eqNullSafe(there)

    stop = F.array_position(F.transform(F.sequence(F.lit(1), F.lit(reach)), agrees), False)
    return F.when(stop == 0, reach).otherwise(stop - 1).cast("int")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, hits_only: bool = False) -> DataFrame:
    """One row per document: doc_id, row_key, n_words, hits (merged spans of hit words), item_ids (exact), near_item_ids (proximity only).

    An item of fewer words than a window is one window; an item without words matches nothing.
    ``hits_only`` gives found_id and found_key of the documents with exact hits, once each, and counts no words.
    """
    text_key = lambda: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    docs_words = docs.select(F.col("doc_id").cast("long"), text_key().alias("row_key"), words(F.col("text")).alias("words"))
    items = (
        benchmark.select(F.col("item_id"), words(F.col("text")).alias("words"))
        .filter(F.size("words") > 0)
        .withColumns({"item_key": F.xxhash64("item_id", "words"), "least": F.least(F.size("words"), F.lit(window))})
        .dropDuplicates(["item_key"])
    )
    items = written(items, "items")
    chosen = written(anchors(docs_words, items, window), "item-anchors")
    n = chosen.count()
    index = written(postings(docs_words, chosen.select("term").distinct(), n, window - 1), "postings")
    shifted = index.join(_small(chosen, n), "term").withColumn("shift", F.col("pos") - F.col("at"))
    item = ["doc_id", "row_key", "item_key", "item_id", "least"]
    lists = shifted.groupBy(*item, "shift").agg(F.collect_list(F.struct("at", "pos", "around", "rarest", "second")).alias("meets"))
    # The lists of a window's rarest and second term intersect on the diagonal; a window of one word has one list.
    of = lambda name: F.flatten(F.transform("meets", lambda x: x[name]))
    meeting = lists.withColumn("both", F.when(F.col("least") == 1, of("rarest")).otherwise(F.array_intersect(of("rarest"), of("second"))))
    candidates = F.filter("meets", lambda x: F.arrays_overlap(F.concat(x["rarest"], x["second"]), F.col("both")))
    compared = meeting.join(_small(items.select("item_key", F.col("words").alias("item_words")), n), "item_key")
    runs = F.transform(
        candidates,
        lambda x: F.struct(
            (x["pos"] - _run(x, F.col("item_words"), window - 1, -1)).alias("from"), (x["pos"] + _run(x, F.col("item_words"), window - 1, 1) + 1).alias("to")
        ),
    )
    exact = F.filter(runs, lambda x: x["to"] - x["from"] >= F.col("least"))
    n_terms = F.size(F.array_distinct(F.transform("meets", lambda x: x["at"])))
    lines = compared.select(*item, "shift", exact.alias("runs"), n_terms.alias("terms"))
    order = Window.partitionBy(*item).orderBy("shift")
    close = (F.col("shift") - F.lag("shift").over(order) <= slop) | (F.lead("shift").over(order) - F.col("shift") <= slop)
    lines = lines.withColumn("near", F.coalesce(close, F.lit(False)) | (F.col("terms") >= 2))
    per_item = lines.groupBy(*item).agg(F.flatten(F.collect_list("runs")).alias("runs"), F.max("near").alias("near"))
    per_doc = per_item.groupBy("doc_id", "row_key").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"),
        F.array_distinct(F.collect_list(F.when(F.size("runs") > 0, F.col("item_id").cast("string")))).alias("item_ids"),
        F.array_distinct(F.collect_list(F.when((F.size("runs") == 0) & F.col("near"), F.col("item_id").cast("string")))).alias("near_item_ids"),
    )
    merged = F.aggregate(
        "runs",
        F.array().cast("array<struct<from:int,to:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["to"] >= x["from"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["from"].alias("from"), F.greatest(F.element_at(acc, -1)["to"], x["to"]).alias("to")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    found = per_doc.select(F.col("doc_id").alias("found_id"), F.col("row_key").alias("found_key"), merged.alias("hits"), "item_ids", "near_item_ids")
    if hits_only:
        return found.filter(F.size("hits") > 0).select("found_id", "found_key").distinct()
    empty = F.array().cast("array<string>")
    return (
        docs_words.select("doc_id", "row_key", F.size("words").cast("long").alias("n_words"))
        .join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("row_key") == F.col("found_key")), "left")
        .select(
            "doc_id", "row_key", "n_words",
            F.coalesce("hits", F.array().cast("array<struct<from:int,to:int>>")).alias("hits"),
            F.array_sort(F.coalesce("item_ids", empty)).alias("item_ids"),
            F.array_sort(F.coalesce("near_item_ids", empty)).alias("near_item_ids"),
        )
    )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items.

    * Null texts have no words; null item ids match under the name null and are not counted.
    * Repeated rows give the same row each; documents that share an id but not a text are kept apart.
    * Items of equal id and words count once; items of equal words under two ids count as two.
    * An empty corpus or benchmark gives rows without hits, or no rows; other columns are ignored.
    """
    found = matches(docs, benchmark, window, slop)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + (x["to"] - x["from"]).cast("long"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("near_item_ids").cast("long").alias("n_near_items"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with their own columns; texts are shuffled only if more than MOST_BROADCAST of them do."""
    hit = written(matches(docs, benchmark, window, hits_only=True).select(F.col("found_id").alias("_hit_id"), F.col("found_key").alias("_hit_key")), "hits")
    hit = _small(hit, hit.count())
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(hit, docs["doc_id"].cast("long").eqNullSafe(F.col("_hit_id")) & (key == F.col("_hit_key")), "left_anti")
