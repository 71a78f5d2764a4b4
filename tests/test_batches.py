import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import batches, facts, running



@pytest.fixture(autouse=True)
def many_blocks(spark):
    """Small groups too are cut into several blocks."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


SCHEMA = "plan string, pos long, size long"


def greedy(rows, most):
    out, batch, used = [], {}, {}
    for plan, pos, size in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or 0)):
        n = max(size or 0, 1)
        if plan not in used:
            batch[plan], used[plan] = 0, 0
        elif used[plan] + n > most:
            batch[plan], used[plan] = batch[plan] + 1, 0
        used[plan] += n
        out.append((str(plan), pos, str(size), batch[plan]))
    return sorted(out)


@pytest.mark.parametrize("most", [1, 7, 50])
def test_packing_matches_a_loop(spark, most, monkeypatch):
    monkeypatch.setattr(batches, "CELL", 2)
    r = random.Random(most)
    sizes = [None, 0, -3, 1, 1, 2, 3, 5, 8, 13, most, most + 1, 9 * most]
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.choice(sizes)) for i in range(600)] + [("single", 1, 5), ("alone", 1, 1000), ("tie", 1, 3), ("tie", 1, 2), ("tie", 1, 6)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((str(x.plan), x.pos, str(x["size"]), x.batch) for x in batches.packed(df, "plan", "pos", "size", most).collect())
    assert got == greedy(rows, most)
    assert batches.packed(df.limit(0), "plan", "pos", "size", most).count() == 0


def test_rows_of_one_size_over_many_cells(spark):
    df = spark.range(5000).selectExpr("'p' AS plan", "id AS pos", "1L AS size")
    got = batches.packed(df, "plan", "pos", "size", 3)
    assert got.filter("batch <> pos div 3").count() == 0 and got.count() == 5000


def test_running_sums_cross_blocks(spark):
    df = spark.range(1000).selectExpr("id", "IF(id % 10 = 0, 'cold', IF(id % 7 = 0, NULL, 'hot')) AS g").repartition(7)
    got = running.placed(df, ["g"], ["id"], {"n": F.lit(1), "s": F.col("id")}, {"all": F.lit(1)})
    seen, blocks = {}, {}
    for x in sorted(got.collect(), key=lambda x: x.id):
        n, s, _ = seen.get(x.g, (0, 0, 0))
        assert (x.n, x.s) == (n, s)
        seen[x.g] = (n + 1, s + x.id, x["all"])
        blocks.setdefault(x.g, set()).add(x._block)
    assert all(n == whole for n, _, whole in seen.values()) and len(blocks["hot"]) > 1


def halves(rows, most, most_rows, deepest):
    def size(part):
        return sum(max(r[3] or 0, 1) for u in part for r in u)

    def walk(part, path, depth):
        n = sum(map(len, part))
        if size(part) <= most and n <= most_rows:
            return [(r, path, "fits") for u in part for r in u]
        if n == 1 or depth >= deepest:
            return [(r, path, "too large" if n == 1 else "too deep") for u in part for r in u]
        if len(part) > 1:
            at = (len(part) + 1) // 2
            left, right = part[:at], part[at:]
        else:
            at = (n + 1) // 2
            left, right = [part[0][:at]], [part[0][at:]]
        return walk(left, path + "/L", depth + 1) + walk(right, path + "/R", depth + 1)

    out = []
    for g in {r[0] for r in rows}:
        units = {}
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[2]):
            units.setdefault(r[1], []).append(r)
        out += walk(list(units.values()), "root", 0)
    return sorted((str(r[0]), str(r[1]), r[2], str(r[3]), path, status) for r, path, status in out)


PARTS = "source string, unit string, pos long, size long"


@pytest.mark.parametrize("deepest", [1, 4, 12])
def test_split_matches_recursion(spark, deepest, monkeypatch):
    monkeypatch.setattr(batches, "CHUNK", 16)
    r = random.Random(deepest)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice(["u", "u", "v", "w", None]), i, r.choice([None, 0, 1, 2, 40, 200])) for i in range(300)] + [("fits", "u", 1, 2), ("large", "u", 1, 500)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, PARTS).repartition(5)
    parts = batches.split(df, "source", "unit", "pos", "size", 100, 8, deepest).cache()
    got = sorted((str(x.source), str(x.unit), x.pos, str(x["size"]), x.path, x.status) for x in parts.collect())
    assert got == halves(rows, 100, 8, deepest)
    assert {x[-1] for x in got} >= {"fits", "too large"} and (deepest > 4 or "too deep" in {x[-1] for x in got})
    assert batches.conserved(df, parts, "source", "pos").filter("NOT conserved").isEmpty()
    assert batches.split(df.limit(0), "source", "unit", "pos", "size", 100).count() == 0


def test_loss_doubling_and_strangers_are_found(spark):
    parents = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 3), ("b", None), (None, 4)], "g string, k long")
    parts = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 3), ("b", 4), ("b", None), (None, 4)], "g string, k long")
    got = {x.g: tuple(x)[1:] for x in batches.conserved(parents, parts, "g", "k").collect()}
    assert got == {"a": (3, 3, 1, 1, 0, False), "b": (2, 3, 0, 0, 1, False), None: (1, 1, 0, 0, 0, True)}


@pytest.mark.parametrize("nearest", [1, 3])
def test_neighbours_match_a_loop(spark, nearest, monkeypatch):
    monkeypatch.setattr(facts, "CHUNK", 4)
    r = random.Random(nearest)
    rows = [(i, r.choice(["m", "m", "n", None]), r.choice(["f", "g", "h", None]), r.choice(["hit", "free", "free", "free", "out", "out"])) for i in range(300)]
    rows += [(1000, "lone", None, "hit"), (1001, None, "idle", "free"), (1002, "lonely", "f2", "free")]
    want = set()
    for key, *links, state in rows:
        for c in (0, 1):
            if state == "hit" and links[c] is not None:
                free = [x[0] for x in rows if x[3] == "free" and x[1 + c] == links[c]]
                want |= set(sorted(f for f in free if f < key)[-nearest:]) | set(sorted(f for f in free if f > key)[:nearest])
    df = spark.createDataFrame(rows, "id long, module string, file string, state string").repartition(5)
    got = facts.neighbours(df, "id", ["module", "file"], F.col("state") == "hit", F.col("state") == "free", nearest)
    assert sorted(x.id for x in got.collect()) == sorted(want)
    assert facts.neighbours(df.limit(0), "id", ["module"], F.lit(True), F.lit(False)).count() == 0
