"""Facts from source material: scope, duplicates, alignment, grouping and evaluation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.batches import packed  # noqa: F401  packing is one of the steps on facts
from corvane.operators.running import placed

#: Free facts of a group are looked at in chunks of so many.
CHUNK = 4096


def fact_id(*parts: str) -> Column:
    """``bf-`` and 24 hex digits of a digest over the parts."""
    return F.concat(F.lit("bf-"), F.substring(F.sha1(F.concat_ws("|", *[F.col(p).cast("string") for p in parts])), 1, 24))


def any_of(text: Column, terms: list[str]) -> Column:
    """One alternation for all terms, whole terms without regard to case."""
    return text.rlike("(?i)(?:" + "|".join(re.escape(t) for t in terms) + ")") if terms else F.lit(False)


def hits(text: Column, terms: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(text), F.lower(t)))


def duplicates(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """key, first_key of the same text by ``order``, is_duplicate. Only digests are shuffled; groups are found by an aggregation."""
    marked = df.select(F.col(key), F.col(order).alias("_order"), F.sha1(F.coalesce(F.col(text), F.lit(""))).alias("digest"))
    first = marked.groupBy("digest").agg(F.min_by(key, "_order").alias("first_key"))
    return marked.join(first, "digest").select(key, "first_key", (F.col(key) != F.col("first_key")).alias("is_duplicate"))


def select_scope(df: DataFrame, key: str, text: str, group: str, include: list[str], exclude: list[str], neighbours: int = 5) -> DataFrame:
    """key and scope: relevant, related, excluded.

    An include hit is relevant, or related if its text came before; an exclude hit is excluded; the first
    ``neighbours`` other facts of a group with a relevant one are related, the rest ``other``. Neighbours are
    shared out per group by key order, which doesn't depend on the order in which rows are read.
    """
    seen = duplicates(df, key, text, key)
    flagged = df.select(F.col(key), F.col(group), any_of(F.col(text), include).alias("_in"), any_of(F.col(text), exclude).alias("_out"))
    flagged = flagged.join(seen.select(key, "is_duplicate"), key)
    own = flagged.withColumn("scope", F.when(F.col("_in"), F.when(F.col("is_duplicate"), "related").otherwise("relevant")).when(F.col("_out"), "excluded"))
    free = F.col("scope").isNull()
    both = placed(own, [group], [key], {"_place": free.cast("int")}, {"_n": (~free & (F.col("scope") == "relevant")).cast("int")})
    shared = F.when(F.col(group).isNotNull() & (F.col("_place") < F.col("_n") * neighbours), "related").otherwise("other")
    return both.select(key, F.coalesce("scope", shared).alias("scope"))


def neighbours(df: DataFrame, key: str, links: list[str], hit: Column, free: Column, nearest: int = 5) -> DataFrame:
    """Keys of the free rows that are among the ``nearest`` free ones before or after some hit, by key, in a group of one of ``links``.

    ``links`` are alternatives, such as module or file; a null one links with nothing. Keys are distinct. Of a group's free rows the
    one at place f is near a hit that has p free ones before it if f - nearest < p <= f + nearest. Hits before the free row at f + nearest,
    less those before the one at f - nearest, are these: two places to look at, so neither pairs nor a sorted group are made.
    """
    found = None
    for link in links:
        marked = df.filter(F.col(link).isNotNull() & (hit | free)).select(F.col(key), F.col(link), hit.cast("int").alias("_hit"), (free & ~hit).cast("int").alias("_free"))
        at = placed(marked, [link], [key], {"_f": F.col("_free"), "_h": F.col("_hit")}, {"_hits": F.col("_hit")}).filter("_free = 1")
        # Each chunk also sees as many rows of the chunks beside it as a look reaches.
        inside = F.col("_f") % CHUNK
        chunk = F.expr(f"_f div {CHUNK}")
        beside = F.array(chunk, F.when(inside < nearest, chunk - 1), F.when(inside >= CHUNK - nearest, chunk + 1))
        seen = at.select("*", F.explode(beside).alias("_chunk")).filter("_chunk IS NOT NULL")
        w = Window.partitionBy("_group", "_chunk").orderBy("_f")
        near = F.coalesce(F.lead("_h", nearest).over(w), F.col("_hits")) - F.coalesce(F.lag("_h", nearest).over(w), F.lit(0))
        own = seen.withColumn("_near", near).filter((F.col("_chunk") == chunk) & (F.col("_near") > 0)).select(key)
        found = own if found is None else found.unionByName(own)
    return found.distinct()


def normal_name(c: Column) -> Column:
    """Camel case to snake case, lower-cased, runs of other characters as one underscore."""
    snake = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(F.regexp_replace(snake, r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", ""))


def aligned(df: DataFrame, name: str, kind: str, key: str, value: str) -> DataFrame:
    """Candidates with the same normal name and kind as one: evidence (keys in order), n, lowest and highest value, conflict."""
    grouped = df.groupBy(normal_name(F.col(name)).alias("name"), F.col(kind).alias("kind"))
    return grouped.agg(
        F.array_sort(F.collect_set(key)).alias("evidence"), F.count(F.lit(1)).alias("n"), F.min(value).alias("lowest"), F.max(value).alias("highest"),
        (F.min(value) < F.max(value)).alias("conflict"),
    )


def adjacent_groups(df: DataFrame, by: str, order: str, kind: Column) -> DataFrame:
    """Runs of rows of one kind that follow one another: by, run, kind, n, first, last."""
    w = Window.partitionBy(by).orderBy(order)
    marked = df.select(by, order, kind.alias("kind")).withColumn("_new", F.when(F.lag("kind").over(w).eqNullSafe(F.col("kind")), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("_new").over(w))
    return runs.groupBy(by, "run").agg(F.first("kind").alias("kind"), F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def owners(properties: DataFrame, objects: DataFrame, by: str, position: str) -> DataFrame:
    """Each property's object: the nearest before it in its material, else the first after it. One window over both, no range join."""
    both = properties.select(by, position, F.lit(1).alias("_p"), F.lit(None).cast("string").alias("object")).unionByName(objects.select(by, position, F.lit(0).alias("_p"), F.col("object")))
    w = Window.partitionBy(by).orderBy(position, "_p")
    before = F.last("object", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # Where nothing is before, the first after it is the material's first: one value a material.
    first = F.first("object", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return both.withColumn("owner", F.coalesce(before, first)).filter("_p = 1").select(by, position, "owner")


def matched_golden(golden: DataFrame, found: DataFrame, identity: list[str]) -> DataFrame:
    """The k-th golden record of an identity meets the k-th found one: identity, k, outcome (hit, missed, extra)."""
    def numbered(df: DataFrame, mark: str) -> DataFrame:
        w = Window.partitionBy(*identity).orderBy(F.lit(1))
        return df.select(*identity).withColumn("k", F.row_number().over(w)).withColumn(mark, F.lit(True))

    both = numbered(golden, "_g").join(numbered(found, "_f"), [*identity, "k"], "full_outer")
    return both.select(*identity, "k", F.when(F.col("_g") & F.col("_f"), "hit").when(F.col("_g"), "missed").otherwise("extra").alias("outcome"))


def precision_recall(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, precision and recall; a ratio without a base is null."""
    counts = df.agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"))
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    return counts.select("tp", "fp", "fn", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"))


def batch_diff(old: DataFrame, new: DataFrame, key: str, signature: str) -> DataFrame:
    """Candidates of two runs: key and change (added, removed, changed, kept, excluded); keys that the old run excluded stay excluded."""
    a = old.select(key, F.col(signature).alias("_old"), F.col("excluded").alias("_excluded"))
    both = a.join(new.select(key, F.col(signature).alias("_new")), key, "full_outer")
    change = (
        F.when(F.coalesce("_excluded", F.lit(False)), "excluded").when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") != F.col("_new"), "changed").otherwise("kept")
    )
    return both.select(key, change.alias("change"))
