"""Long repeated passages by compaction of the windows' de Bruijn graph.

A window of 50 words is an edge from its first 49 words to its last 49. Each
window has a minimizer: its run of 12 words with the least hash. Consecutive
windows of a document with the same minimizer are a path in that graph. A
minimizer under which all documents have one and the same path is nonbranching:
the path is compacted to one row, and a Spark join gives each of its windows to
the path's first document at once. Under the other minimizers paths branch, and
there the windows are joined edge by edge. Windows that follow one another both
in a document and in its source join to long spans, and the words at the
source's coordinates are compared with the span's before anything is removed.

Equal windows have equal minimizers, so windows under a minimizer that only one
document has cannot repeat and never leave their task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written
from .hashing import Rolling, bitmap, has_bit, maybe, maybe_among, sliding_min, word_hashes

WINDOW, SEED = 50, 12
#: A key with one in so many of all rows is frequent.
HEAVY = 1000
PATH = "row_key long, doc_id long, start int, windows int, anchor long, content long"
EDGE = "row_key long, doc_id long, start int, edge long"


class Paths:
    """The paths of a few documents, whose word hashes stand one after another.

    A path is a run of windows whose least run of ``seed`` words is the same.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, doc_id: np.ndarray, row_key: np.ndarray, window: int, seed: int):
        self.words, self.window = words, window
        least = sliding_min(Rolling(words, twist=1).all(seed), window - seed + 1)
        begin = np.cumsum(sizes) - sizes
        windows = np.maximum(sizes - window + 1, 0)
        doc = np.repeat(np.arange(len(sizes)), windows)
        at = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        value = least[at]
        first = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]) if len(at) else np.zeros(0, dtype=np.int64)
        self.begin = at[first]
        self.count = np.diff(np.r_[first, len(at)])
        self.anchor = value[first]
        doc = doc[first]
        self.doc_id, self.row_key, self.start = doc_id[doc], row_key[doc], self.begin - begin[doc]

    def only(self, use: np.ndarray) -> Paths:
        for name in ("begin", "count", "anchor", "doc_id", "row_key", "start"):
            setattr(self, name, getattr(self, name)[use])
        return self


def _by_paths(docs: DataFrame, make: Callable[[Paths], dict[str, np.ndarray]], schema: str, window: int, seed: int) -> DataFrame:
    """The columns that ``make`` gives for the paths of a few documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                flat, sizes = word_hashes([body.encode("utf-8", "replace") for body in part.column("body").to_pylist()])
                if sizes.max() < window:
                    continue
                columns = make(Paths(flat, sizes, part.column("doc_id").to_numpy(), part.column("row_key").to_numpy(), window, seed))
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for v in columns.values()], names=list(columns))

    return _rows(docs).filter("doc_id IS NOT NULL").mapInArrow(run, schema)


def _rows(docs: DataFrame) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(body).alias("row_key"), body.alias("body"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row per span of repeated windows: row_key, doc_id, start, length (words), source_key, source_id, source_start.

    The source is the smallest doc_id that has the windows, and its words there have been compared.
    """
    spark = docs.sparkSession

    def anchors(p: Paths) -> dict:
        return {"anchor": p.anchor, "doc_id": p.doc_id}

    seen = _by_paths(docs, anchors, "anchor long, doc_id long", window, seed)
    shared = seen.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    shared = written(shared.select("anchor"), "shared")
    shared_bits = spark.sparkContext.broadcast(bitmap(shared, F.col("anchor")))
    forget(shared)

    def paths(p: Paths) -> dict:
        p.only(has_bit(shared_bits.value, p.anchor))
        content = Rolling(p.words, twist=2)(p.begin, p.count + window - 1)
        return {"row_key": p.row_key, "doc_id": p.doc_id, "start": p.start.astype(np.int32), "windows": p.count.astype(np.int32), "anchor": p.anchor, "content": content}

    all_paths = written(_by_paths(docs, paths, PATH, window, seed), "paths")
    by_anchor = all_paths.groupBy("anchor").agg(
        F.min(F.struct("doc_id", "start", "row_key")).alias("source"), F.max("doc_id").alias("hi"), F.min("content").alias("a"), F.max("content").alias("b"), F.count(F.lit(1)).alias("n")
    )
    by_anchor = written(by_anchor.filter("source.doc_id < hi"), "anchors")
    whole = (
        _with_source(all_paths, by_anchor.filter("a = b"), "anchor")
        .filter("doc_id > source.doc_id")
        .select("row_key", "doc_id", "start", "windows", F.col("source.row_key").alias("source_key"), F.col("source.doc_id").alias("source_id"), F.col("source.start").alias("source_start"))
    )
    branching_bits = spark.sparkContext.broadcast(bitmap(by_anchor.filter("a <> b"), F.col("anchor")))

    def edges(p: Paths) -> dict:
        p.only(has_bit(branching_bits.value, p.anchor))
        within = np.arange(p.count.sum()) - np.repeat(np.cumsum(p.count) - p.count, p.count)
        edge = Rolling(p.words, twist=2)(np.repeat(p.begin, p.count) + within, window)
        return {"row_key": np.repeat(p.row_key, p.count), "doc_id": np.repeat(p.doc_id, p.count), "start": (np.repeat(p.start, p.count) + within).astype(np.int32), "edge": edge}

    branching = written(_with_source(all_paths, by_anchor.filter("a <> b"), "anchor").select("row_key").distinct(), "branching")
    opened = written(_by_paths(maybe_among(docs, branching), edges, EDGE, window, seed), "edges")
    forget(branching)
    first = opened.groupBy("edge").agg(F.min(F.struct("doc_id", "start", "row_key")).alias("source"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    first = written(first.filter("source.doc_id < hi"), "firsts")
    single = (
        _with_source(opened, first, "edge")
        .filter("doc_id > source.doc_id")
        .select("row_key", "doc_id", "start", F.lit(1).alias("windows"), F.col("source.row_key").alias("source_key"), F.col("source.doc_id").alias("source_id"), F.col("source.start").alias("source_start"))
    )
    found = written(_compacted(whole.unionByName(single), window), "spans")
    for done in (all_paths, by_anchor, opened, first):
        forget(done)
    return _verified(docs, found)


def _with_source(rows: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """``rows`` with the source of their key, of which ``sources`` (key, source, n) has one row each.

    A key with one in HEAVY of all rows or more is joined by a broadcast of at most HEAVY sources, so no task gets all its rows.
    """
    total = sources.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(sources.filter(F.col("n") * HEAVY >= total).select(key, "source"))
    light = sources.filter(F.col("n") * HEAVY < total).select(key, "source")
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key))


def _compacted(runs: DataFrame, window: int) -> DataFrame:
    """Runs that go on both in the document and in its source become one span."""
    line = ["row_key", "doc_id", "source_key", "source_id", F.col("start") - F.col("source_start")]
    order = Window.partitionBy(*line).orderBy("start")
    reach = F.max(F.col("start") + F.col("windows")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("fresh", F.when(F.col("start") <= reach, 0).otherwise(1))
    marked = marked.withColumn("island", F.sum("fresh").over(order))
    return (
        marked.groupBy(*line, "island")
        .agg(F.min("start").alias("start"), F.min("source_start").alias("source_start"), F.max(F.col("start") + F.col("windows")).alias("stop"))
        .select("row_key", "doc_id", "start", (F.col("stop") - F.col("start") + window - 1).alias("length"), "source_key", "source_id", "source_start")
    )


def _with_texts(docs: DataFrame, per_doc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their row of ``per_doc`` (by doc_id, row_key), and the documents that surely have none.

    A bitmap of fixed size keeps texts of documents without a row out of the shuffle.
    """
    rows = _rows(docs).withColumn("maybe", maybe(per_doc)("row_key"))
    return rows.filter("maybe").join(per_doc, ["doc_id", "row_key"], "left"), rows.filter("NOT maybe")


def _verified(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans whose words equal those at the source's coordinates, by a 160-bit digest of the words themselves."""
    asked = spans.select("doc_id", "row_key", "start", "length").unionByName(
        spans.select(F.col("source_id").alias("doc_id"), F.col("source_key").alias("row_key"), F.col("source_start").alias("start"), "length")
    )
    per_doc = asked.distinct().groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("start", "length")).alias("asked"))
    texts, _ = _with_texts(docs, written(per_doc, "asked"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, key, body, want in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_key", "body", "asked"))):
                words = body.encode("utf-8", "replace").split()
                for w in want:
                    digest = hashlib.blake2b(b" ".join(words[w["start"] : w["start"] + w["length"]]), digest_size=20).digest()
                    for column, v in zip(out, (doc_id, key, w["start"], w["length"], digest)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["doc_id", "row_key", "start", "length", "digest"])

    found = texts.filter("asked IS NOT NULL").select("doc_id", "row_key", "body", "asked").mapInArrow(digests, "doc_id long, row_key long, start int, length int, digest binary")
    found = written(found.dropDuplicates(["doc_id", "row_key", "start", "length"]), "digests")
    source = found.select(F.col("doc_id").alias("source_id"), F.col("row_key").alias("source_key"), F.col("start").alias("source_start"), "length", F.col("digest").alias("source_digest"))
    return (
        spans.join(found, ["doc_id", "row_key", "start", "length"])
        .join(source, ["source_id", "source_key", "source_start", "length"])
        .filter("digest = source_digest")
        .select("row_key", "doc_id", "start", "length", "source_key", "source_id", "source_start")
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, texts: bool = True) -> DataFrame:
    """One row per document: doc_id, kept_text (words joined by one space; not without ``texts``), n_words, n_removed, kept_sha256.

    A word goes if a window over it also starts in a document with a smaller doc_id.

    * Words are runs of anything but ASCII white space. Null text has none; shorter texts have no window and stay whole.
    * Windows that repeat inside one document, or in rows with the same doc_id, stay.
    * Rows with a null doc_id stay whole and are no source. Repeated rows give the same row each.
    * An empty table gives an empty result; other columns are ignored.
    """
    spans = repeated_windows(docs, window, seed)
    per_doc = written(spans.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "length")).alias("gone")), "gone")
    some, rest = _with_texts(docs, per_doc)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            gone = batch.column("gone").to_pylist() if "gone" in batch.schema.names else [None] * len(bodies)
            kept, n, removed, digests = [], [], [], []
            for body, spans_of in zip(bodies, gone):
                words = body.encode("utf-8", "replace").split()
                n.append(len(words))
                if spans_of:
                    stay = np.ones(len(words), dtype=bool)
                    for s in spans_of:
                        stay[s["start"] : s["start"] + s["length"]] = False
                    words = [words[i] for i in np.flatnonzero(stay)]
                text = b" ".join(words)
                digests.append(hashlib.sha256(text).hexdigest())
                removed.append(n[-1] - len(words))
                if texts:
                    kept.append(text.decode("utf-8"))
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * texts, names=names + ["kept_text"] * texts)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return some.select("doc_id", "body", "gone").mapInArrow(cut, schema).unionByName(rest.select("doc_id", "body").mapInArrow(cut, schema))
