import hashlib
import random
import re

import pytest

from corvane.llm import decontam, line_dedup
from test_ngram_join import shuffled

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def leaks(rows, items, window):
    wanted = {}
    for item, text in items:
        ws = words(text)
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1) if ws else ():
            wanted.setdefault(tuple(ws[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in rows:
        ws, hit, found = words(text), set(), set()
        for n in {len(w) for w in wanted}:
            for i in range(len(ws) - n + 1):
                if (ids := wanted.get(tuple(ws[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= ids
        out.append((doc, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(2))
def test_leaks_match_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "the", "É", "x1", "Of", "zz"]) if rng.random() < 0.6 else f"w{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 8, 20])))) for i in range(12)] + [(90, None), (91, "?!"), (3, "a b c"), (3, "a b c")]
    rows = []
    for d in range(60):
        ws = [word() for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            own = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(own) + 1)
            ws[rng.randrange(len(ws) + 1) : 0] = own[a : a + rng.randrange(1, 25)]
        rows.append((d, rng.choice([" ", ", ", "-\n"]).join(ws)))
    rows += [(100, None), (101, ""), (102, "a " * 3000), rows[0], (5, "a different text"), (None, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' AS words", "1 AS pos")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.report(docs, bench, window=4).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == leaks(rows, items, 4)
    kept = decontam.clean(docs, bench, window=4)
    assert kept.columns == docs.columns and kept.count() == sum(not x[-1] for x in leaks(rows, items, 4))


def test_near_matches_are_told_apart(spark):
    bench = spark.createDataFrame([(7, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta so gamma then delta epsilon now zeta"), (3, "nothing here")], "doc_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near_items) for r in decontam.report(docs, bench).collect()}
    assert got == {1: (1, 0), 2: (0, 1), 3: (0, 0)}


def test_texts_are_not_shuffled_to_drop_the_hit_ones(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(i, "so alpha beta gamma too" if i % 100 == 5 else f"text {i}") for i in range(2000)], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = decontam.clean(docs, bench)
        assert out.count() == 1980 and shuffled(spark, out) < 300
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r.contaminated for r in decontam.report(some, none).collect()] == [False]
    assert decontam.report(some.limit(0), none).count() == 0
    assert line_dedup.report(some.limit(0)).count() == 0


def brute_lines(rows):
    seen, out = {}, []
    keys = sorted({(d is not None, d or 0, t or "") for d, t in rows})
    order = {}
    for has, d, t in keys:
        order.setdefault((has, d), []).append(t)
    gone = {}
    for has, d, t in keys:
        ls = t.split("\n")
        gone[has, d, t] = set()
        for i in range(len(ls) - 2):
            w = tuple(ls[i : i + 3])
            if w in seen:
                gone[has, d, t] |= {i, i + 1, i + 2}
            seen.setdefault(w, (d, i))
    for d, t in rows:
        ls = (t or "").split("\n")
        g = gone[d is not None, d or 0, t or ""]
        kept = "\n".join(x for i, x in enumerate(ls) if i not in g)
        out.append((d, len(ls), len(g), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(d, "\n".join(rng.choice(["a", "b", "", "c d"]) for _ in range(rng.randrange(9)))) for d in range(80)] + [(200, None), (201, "x\ny"), (None, "a\nb\nq\nr"), (202, "l\n" * 3000)]
    rows += rows[:2]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "3 AS line")
    assert sorted((tuple(r) for r in line_dedup.report(df).collect()), key=str) == brute_lines(rows)
