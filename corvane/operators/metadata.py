"""Versions, references, search, paging and snapshots as joins and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(columns: list[str]) -> Column:
    """A digest of columns in which null and the empty text differ."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def version_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and change (added, removed, changed, kept). Both sides send a digest of their columns, not the columns."""
    a = old.select(key, content_hash(columns).alias("_old"))
    b = new.select(key, content_hash(columns).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed").otherwise("kept")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def broken_references(slots: list[tuple[str, DataFrame, str, str]], known: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """slot, owner, target, of all references without a target.

    ``slots``: name, rows, owner column, reference column; the target kind is the name's last part.
    """
    parts = []
    for name, df, owner, column in slots:
        target, key = known[name.rpartition(".")[2]]
        keys = target.select(F.col(key).cast("string").alias("target")).distinct()
        refs = df.filter(F.col(column).isNotNull()).select(F.lit(name).alias("slot"), F.col(owner).cast("string").alias("owner"), F.col(column).cast("string").alias("target"))
        parts.append(refs.join(keys, "target", "left_anti").select("slot", "owner", "target"))
    return reduce(DataFrame.unionByName, parts)


def numbered(broken: DataFrame) -> DataFrame:
    """``occurrence`` tells repeated references of one slot to one target apart, from 0, by owner."""
    return broken.withColumn("occurrence", F.row_number().over(Window.partitionBy("slot", "target").orderBy("owner")) - 1)


def newly_broken(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.join(before.select("slot", "owner", "target"), ["slot", "owner", "target"], "left_anti")


def impact(changes: DataFrame, bindings: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Bindings that changes touch by any of the key pairs (change column, binding column), once per change and binding: change_id, binding_id."""
    parts = [changes.join(bindings, changes[a] == bindings[b]).select("change_id", "binding_id") for a, b in on]
    return reduce(DataFrame.unionByName, parts).distinct()


def next_version(df: DataFrame, by: str, version: str) -> DataFrame:
    """The greatest major.minor.patch per asset with the patch raised; text order would put 1.9 over 1.10."""
    part = F.split(version, r"\.")
    top = df.groupBy(by).agg(F.max(F.struct(part[0].cast("int").alias("a"), part[1].cast("int").alias("b"), part[2].cast("int").alias("c"))).alias("v"))
    return top.select(by, F.concat_ws(".", F.col("v.a").cast("string"), F.col("v.b").cast("string"), (F.col("v.c") + 1).cast("string")).alias("next_version"))


def heads(snapshots: DataFrame, by: str, seq: str) -> DataFrame:
    """The latest snapshot per asset, whole, by an aggregation that maps combine."""
    rest = [c for c in snapshots.columns if c != by]
    return snapshots.groupBy(by).agg(F.max_by(F.struct(*rest), seq).alias("_row")).select(by, "_row.*")


def appended(snapshots: DataFrame, new: DataFrame, by: str, seq: str) -> DataFrame:
    """Snapshots of ``new`` (with ``expected``: the head that the writer saw) that may be added: compare-and-set for one writer at a time."""
    now = snapshots.groupBy(by).agg(F.max(seq).alias("_head"))
    return new.join(now, by, "left").filter(F.col("expected").eqNullSafe(F.col("_head"))).drop("_head", "expected")


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """Rows after a key in key order; each task keeps ``size`` rows and the filter reaches the scan."""
    return df.filter(F.col(key) > F.lit(after)).orderBy(key).limit(size)


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """A page with ``has_more``, found by looking one row ahead."""
    ahead = df.orderBy(*order).offset(offset).limit(size + 1)
    numbered_rows = ahead.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    return numbered_rows.withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > size).filter(F.col("_n") <= size).drop("_n")


def search(df: DataFrame, column: str, text: str) -> DataFrame:
    """Case-folded contains; % and _ are ordinary characters."""
    return df.filter(F.lower(column).contains(text.lower()))


def folder_counts(df: DataFrame, path: Column, size: Column) -> DataFrame:
    """Totals by the part before the first slash; '' without one: folder, n, bytes."""
    folder = F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit(""))
    return df.select(folder.alias("folder"), size.alias("_size")).groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("bytes"))


def coverage(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Counts of a key in both lists where they differ: key, n_expected, n_got, problem (missing, extra, duplicate)."""
    both = expected.select(F.col(key), F.lit(1).alias("e"), F.lit(0).alias("g")).unionByName(got.select(F.col(key), F.lit(0).alias("e"), F.lit(1).alias("g")))
    out = both.groupBy(key).agg(F.sum("e").alias("n_expected"), F.sum("g").alias("n_got")).filter("n_expected <> n_got")
    return out.withColumn("problem", F.when(F.col("n_got") == 0, "missing").when(F.col("n_expected") == 0, "extra").when(F.col("n_got") > F.col("n_expected"), "duplicate").otherwise("missing"))


def inherited(properties: DataFrame, shared: DataFrame, fields: list[str]) -> DataFrame:
    """Properties with all ``fields`` of their shared property, where they have one; own values of these are dropped."""
    side = shared.select(F.col("id").alias("shared_id"), F.struct(*fields).alias("_shared"))
    joined = properties.join(side, "shared_id", "left")
    return joined.select(*[F.when(F.col("_shared").isNotNull(), F.col("_shared")[f]).otherwise(F.col(f)).alias(f) if f in fields else F.col(f) for f in properties.columns])


def suffixed(df: DataFrame, name: str, order: Column, most: int = 80) -> DataFrame:
    """``df`` with ``final``: the name for its first row, then the name with (2), (3) and so on; stems are cut so that ``most`` characters hold.

    A numbered name that another row has by itself is passed over: such rows keep their own name and the next number is taken.
    Case doesn't tell names apart.
    """
    clean = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("unnamed"))
    key = F.lower("_clean")
    numbered_ = df.withColumn("_clean", clean).withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    taken = numbered_.filter("_k = 1").withColumn("_base", F.regexp_replace(key, r" \(\d+\)$", "")).withColumn("_own", F.regexp_extract(key, r" \((\d+)\)$", 1).try_cast("int"))
    taken = taken.filter("_own > 1").groupBy("_base").agg(F.array_sort(F.collect_set("_own")).alias("_taken"))
    joined = numbered_.withColumn("_base", key).join(taken, "_base", "left")
    # The k-th free number: each taken one that isn't above pushes it on by one.
    number = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_k"), lambda n, x: F.when(x <= n, n + 1).otherwise(n))
    suffix = F.concat(F.lit(" ("), number.cast("string"), F.lit(")"))
    final = F.when(F.col("_k") == 1, F.left("_clean", F.lit(most))).otherwise(F.concat(F.left("_clean", F.lit(most) - F.length(suffix)), suffix))
    return joined.withColumn("final", final).select(*df.columns, "final")


def preview(df: DataFrame, order: list[Column], most: int = 20) -> DataFrame:
    """The first rows with ``truncated``: whether there are more. One row beyond the limit tells, so nothing is counted."""
    some = df.orderBy(*order).limit(most + 1)
    w = Window.orderBy(*order)
    placed = some.withColumn("_place", F.row_number().over(w)).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > most)
    return placed.filter(F.col("_place") <= most).drop("_place")


def moved(objects_: DataFrame, key: str, parent: str, moves: DataFrame, known: DataFrame, target: str) -> DataFrame:
    """What moves (key, ``target``) would do, without a write: before, after and status (ok, unknown object, unknown target, unchanged)."""
    now = objects_.select(F.col(key), F.col(parent).alias("before"), F.lit(True).alias("_object"))
    there = known.select(F.col(target), F.lit(True).alias("_target"))
    joined = moves.join(now, key, "left").join(there, target, "left")
    status = F.when(F.col("_object").isNull(), "unknown object").when(F.col("_target").isNull(), "unknown target").when(F.col("before") == F.col(target), "unchanged").otherwise("ok")
    return joined.select(key, "before", F.col(target).alias("after"), status.alias("status"))
