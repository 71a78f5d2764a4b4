"""Batches of facts: greedy packing, splitting of what is too large, and the proof that nothing was lost.

Sizes are whole numbers; a row without a size, or with one below one, counts as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.objects import cut_lineage
from corvane.operators.running import group_key, placed

#: A group is cut into cells of so many times the size of a batch.
CELL = 16
#: Rows of a group meet the parts of the group in chunks of so many rows.
CHUNK = 4096


def _size(size: str) -> Column:
    return F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(1)).cast("long")


def packed(df: DataFrame, by: str, order: str, size: str, most: int) -> DataFrame:
    """by, order, size, batch: greedy packing by ``order`` (ties by size); a batch starts anew where the next row would not fit, so a row over ``most`` is alone.

    Which rows start a batch depends on the batch before, but only through the place where that one started. So a group is cut into
    cells of ``CELL`` times ``most``. For each row that may be the first to start a batch in a cell (it lies within ``most`` of the cell's
    edge, or is the cell's first), a fold over the cell finds where the first batch after the cell starts. Pointer doubling over
    these jumps finds the ones taken from the group's first row on, in as many rounds as the logarithm of the cells.
    """
    width = CELL * most
    rows = placed(df.select(by, order, size), [by], [order, size], {"_at": _size(size)})
    rows = cut_lineage(rows.withColumn("_end", F.col("_at") + _size(size)).withColumn("_cell", F.expr(f"_at div {width}")))

    # A cell also sees the rows within a batch's size after it.
    near = F.when((F.col("_cell") > 0) & (F.col("_at") - F.col("_cell") * width <= most), F.col("_cell") - 1)
    seen = rows.select("_group", "_at", "_end", F.explode(F.array("_cell", near)).alias("_cell")).filter("_cell IS NOT NULL")
    cells = cut_lineage(seen.groupBy("_group", "_cell").agg(F.array_sort(F.collect_list(F.struct(F.col("_at").alias("at"), F.col("_end").alias("end")))).alias("_rows")))

    over = f"r.at > s.start AND r.end > s.start + {most}"
    edge = f"(_cell + 1) * {width}"
    leave = f"""aggregate(_rows, named_struct('start', e.at, 'steps', 1L, 'exit', CAST(NULL AS BIGINT)), (s, r) -> CASE WHEN s.exit IS NOT NULL OR NOT ({over}) THEN s
      WHEN r.at >= {edge} THEN named_struct('start', s.start, 'steps', s.steps, 'exit', r.at) ELSE named_struct('start', r.at, 'steps', s.steps + 1L, 'exit', CAST(NULL AS BIGINT)) END)"""
    first = cells.select("_group", "_cell", "_rows", F.explode(F.expr(f"filter(filter(_rows, r -> r.at < {edge}), (r, i) -> i = 0 OR r.at <= _cell * {width} + {most})")).alias("e"))
    jumps = first.select("_group", F.col("e.at").alias("at"), "_rows", F.expr(leave).alias("j"))
    # Nothing of the cell or after it starts the next batch: it starts behind the last row seen, be it a row over ``most`` or the group's end.
    jumps = cut_lineage(jumps.select("_group", "at", F.coalesce("j.exit", F.element_at("_rows", -1)["end"]).alias("exit"), "j.steps"))

    taken = jumps.filter("at = 0").select("_group", "at", F.lit(0).cast("long").alias("base"))
    hop = jumps
    while True:
        ahead = taken.join(hop, ["_group", "at"]).select("_group", F.col("exit").alias("at"), (F.col("base") + F.col("steps")).alias("base"))
        taken = cut_lineage(taken.unionByName(ahead).repartition("_group", "at"))
        again = hop.select("_group", F.col("at").alias("exit"), F.col("exit").alias("_exit"), F.col("steps").alias("_steps"))
        hop = cut_lineage(hop.join(again, ["_group", "exit"]).select("_group", "at", F.col("_exit").alias("exit"), (F.col("steps") + F.col("_steps")).alias("steps")))
        if hop.isEmpty():
            break

    starts = f"""aggregate(_rows, named_struct('start', at, 'all', array(at)),
      (s, r) -> IF(r.at < {edge} AND {over}, named_struct('start', r.at, 'all', concat(s.all, array(r.at))), s), s -> s.all)"""
    entered = taken.join(jumps.select("_group", "at"), ["_group", "at"]).withColumn("_cell", F.expr(f"at div {width}"))
    cover = cut_lineage(entered.join(cells, ["_group", "_cell"]).select("_group", "_cell", "base", F.expr(starts).alias("_starts")))
    # The rest of a group may end in a cell where no batch starts.
    after = cover.select("_group", (F.col("_cell") + 1).alias("_cell"), (F.col("base") + F.size("_starts")).alias("base"), F.array().cast("array<bigint>").alias("_starts"))
    cover = cover.unionByName(after.join(cover, ["_group", "_cell"], "left_anti"))
    batch = F.col("base") + F.expr("size(filter(_starts, s -> s <= _at))") - 1
    return rows.join(cover, ["_group", "_cell"]).select(by, order, size, batch.cast("long").alias("batch"))


def split(df: DataFrame, by: str, unit: str, order: str, size: str, most: int, most_rows: int = 64, deepest: int = 8) -> DataFrame:
    """by, unit, order, size, path, status: groups halved until each part fits, all parts that are too large at once.

    A part of several units (units go by their first row) is halved between units, one of a single unit between rows; the left half
    takes the odd one. ``path`` names the halves, as ``root/L/R``. ``status`` is ``fits``, ``too large`` for a single row over
    ``most``, or ``too deep`` where ``deepest`` halvings were not enough. Ties of ``order`` go by size, ties of units by their name.

    A part is a range of rows, so its size comes from the running sums at its two ends: a round reads one row per part, not the rows.
    """
    one = F.lit(1)
    rows = df.select(by, unit, order, size).withColumn("_by", group_key(by))
    rows = cut_lineage(placed(rows, [by, unit], [order, size], {"_i": one, "_a": _size(size)}, group="_unit"))
    units = rows.groupBy("_by", "_unit").agg(F.min(order).alias("_first"), F.count(one).alias("_n"), F.sum(_size(size)).alias("_s"))
    units = placed(units, ["_by"], ["_first", "_unit"], {"_u": one, "_row": F.col("_n"), "_size": F.col("_s")}, {"_units": one, "_rows": F.col("_n"), "_sizes": F.col("_s")})
    units = cut_lineage(units.drop("_block"))
    # Rows meet their unit by (unit, block), so a large unit is no hot key.
    blocks = rows.select("_unit", "_block").distinct().join(units.select("_unit", "_row", "_size"), "_unit")
    rows = rows.join(blocks, ["_unit", "_block"]).select("_by", by, unit, order, size, (F.col("_row") + F.col("_i")).alias("_row"), (F.col("_size") + F.col("_a")).alias("_size"))
    rows = cut_lineage(rows)

    zero = F.lit(0).cast("long")
    ends = [zero.alias("u0"), F.col("_units").alias("u1"), zero.alias("r0"), F.col("_rows").alias("r1"), zero.alias("s0"), F.col("_sizes").alias("s1")]
    parts = units.filter("_u = 0").select("_by", F.lit("root").alias("path"), *ends)
    too_large = (F.col("s1") - F.col("s0") > most) | (F.col("r1") - F.col("r0") > most_rows)
    done = None
    for _ in range(deepest):
        parts = cut_lineage(parts.repartition("_by", "path"))
        halved = too_large & (F.col("r1") - F.col("r0") > 1)
        kept, large = parts.filter(~halved), parts.filter(halved)
        done = kept if done is None else done.unionByName(kept)
        if large.isEmpty():
            parts = large
            break
        by_unit = large.filter("u1 - u0 > 1").withColumn("_u", F.expr("u0 + (u1 - u0 + 1) div 2")).join(units.select("_by", "_u", "_row", "_size"), ["_by", "_u"])
        by_row = large.filter("u1 - u0 = 1").withColumn("_row", F.expr("r0 + (r1 - r0 + 1) div 2")).join(rows.select("_by", "_row", "_size"), ["_by", "_row"])
        by_unit = by_unit.selectExpr("*", "_u AS _left", "_u AS _right")
        by_row = by_row.selectExpr("*", "u1 AS _left", "u0 AS _right")
        columns = ["_by", "path", "u0", "u1", "r0", "r1", "s0", "s1", "_left", "_right", "_row", "_size"]
        both = by_unit.select(*columns).unionByName(by_row.select(*columns))
        left = both.selectExpr("_by", "path || '/L' AS path", "u0", "_left AS u1", "r0", "_row AS r1", "s0", "_size AS s1")
        right = both.selectExpr("_by", "path || '/R' AS path", "_right AS u0", "u1", "_row AS r0", "r1", "_size AS s0", "s1")
        parts = left.unionByName(right)
    parts = parts if done is None else done.unionByName(parts)
    status = F.when(~too_large, "fits").when(F.col("r1") - F.col("r0") == 1, "too large").otherwise("too deep")
    parts = parts.select("_by", "path", "r0", "r1", status.alias("status"), F.explode(F.expr(f"sequence(r0 div {CHUNK}, (r1 - 1) div {CHUNK})")).alias("_chunk"))
    met = rows.withColumn("_chunk", F.expr(f"_row div {CHUNK}")).join(parts, ["_by", "_chunk"]).filter("_row >= r0 AND _row < r1")
    return met.select(by, unit, order, size, "path", "status")


def conserved(parents: DataFrame, parts: DataFrame, by: str, key: str) -> DataFrame:
    """by, n_parents, n_parts, n_lost, n_doubled, n_foreign, conserved: do the parts hold each parent exactly as often as it was there?

    Rows are counted as a multiset of (by, key), nulls included; what moved to another group is lost there and foreign here.
    """
    sides = parents.select(by, key, F.lit(1).alias("_p"), F.lit(0).alias("_c")).unionByName(parts.select(by, key, F.lit(0).alias("_p"), F.lit(1).alias("_c")))
    counts = sides.groupBy(by, key).agg(F.sum("_p").alias("_p"), F.sum("_c").alias("_c"))
    more = F.greatest(F.col("_c") - F.col("_p"), F.lit(0))
    out = counts.groupBy(by).agg(
        F.sum("_p").alias("n_parents"), F.sum("_c").alias("n_parts"), F.sum(F.greatest(F.col("_p") - F.col("_c"), F.lit(0))).alias("n_lost"),
        F.sum(F.when(F.col("_p") > 0, more).otherwise(0)).alias("n_doubled"), F.sum(F.when(F.col("_p") == 0, more).otherwise(0)).alias("n_foreign"),
    )
    return out.withColumn("conserved", F.expr("n_lost = 0 AND n_doubled = 0 AND n_foreign = 0"))
