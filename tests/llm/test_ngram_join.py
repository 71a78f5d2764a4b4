import random

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import ngram_join, queries
from corvane.llm.common import table
from corvane.llm.components import components


def shingles(text, k=5):
    ws = (text or "").encode().lower().split()
    return frozenset(tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))) if ws else frozenset()


def brute(rows):
    sets = [(doc, shingles(t)) for doc, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    seen = set()
    for group in where.values():
        for x, i in enumerate(group):
            for j in group[x + 1 :]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    a, b = sets[i][1], sets[j][1]
                    if 100 * len(a & b) >= 75 * len(a | b):
                        parent[root(i)] = root(j)
    least = {}
    for i, (doc, s) in enumerate(sets):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(s), least.get(root(i))) for i, (doc, s) in enumerate(sets))


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_components_of_a_table_match_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert got(queries.op8_ngram_join(spark, sf)) == brute(rows)


@pytest.mark.parametrize("seed", range(2))
def test_families_chains_and_common_passages(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijk") + str(rng.randrange(300))
    passage = [word() for _ in range(20)]
    rows, doc = [], 0
    for _ in range(6):
        base = [word() for _ in range(rng.randrange(30, 120))]
        for _ in range(rng.choice([1, 3, 60])):
            ws = list(base)
            for _ in range(rng.randrange(5)):
                ws[rng.randrange(len(ws))] = word()
            if rng.random() < 0.1:
                base = ws
            if rng.random() < 0.3:
                ws = passage + ws
            rows.append((doc := doc + rng.randrange(1, 3), " ".join(ws).upper() if rng.random() < 0.2 else " ".join(ws)))
    rows += [(doc + 1, " ".join(passage + [word() for _ in range(9)])) for doc in range(doc, doc + 80)]
    rows += [(5000, None), (5001, ""), (5002, " \t"), (5003, "one two"), (5004, "ONE  two"), (5005, "É a b c d e"), (5006, "é a b c d e")] + rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_join.classes(df, least_t=4)) == brute(rows)


def test_empty_table(spark):
    assert ngram_join.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    out = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_components_that_many_tasks_share(spark):
    rng = random.Random(5)
    edges = [(0, i) for i in range(1, 90)] + [(1000 + i, 1001 + i) for i in range(80)] + [(2000 + rng.randrange(60), 2000 + rng.randrange(60)) for _ in range(50)]
    want = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long").coalesce(1)).collect()}
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7), links=9).collect()}
    assert got == want and want[1080] == 1000 and want[89] == 0


def test_one_id_with_two_texts(spark):
    """Text V is led by document 2, and W by document 5: the V of document 5 goes, its W stays."""
    from corvane.llm.ngram_join import first_of_class

    v, w = "v1 v2 v3 v4 v5 v6 v7 v8", "w1 w2 w3 w4 w5 w6 w7 w8"
    df = spark.createDataFrame([(2, v), (5, w), (5, v)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in first_of_class(df).collect()) == [(2, v), (5, w)]


def test_sketches_of_many_pairs_differ_as_those_of_one():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64)) for n in (1, 30, 40, 40, 70, 9000)]
    sketches = ngram_join._sketches(sets)
    assert max(map(len, sketches)) == ngram_join.MOST_SKETCH // 8
    x, y = (c.ravel() for c in np.meshgrid(np.arange(1, 6), np.arange(1, 6)))
    many = ngram_join.Sketches(pa.array(sketches, pa.binary()).slice(1)).differ(x - 1, y - 1)
    assert many.tolist() == [ngram_join._difference(sketches[i], sketches[j]) for i, j in zip(x, y)]


def test_a_task_gives_a_forest_of_a_large_group(spark):
    """300 near copies that nothing has linked yet: 44,850 pairs pass, 299 connect them; of unlike sets that share a shingle none is given."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, 100).astype(np.uint64)
    near = [np.unique(np.r_[base[1:], np.uint64(i)]) for i in range(300)]
    unlike = [np.unique(rng.integers(0, 1 << 60, 100).astype(np.uint64)) for _ in range(300)]
    for sets, pairs, least in ((near, 44850, 299), (unlike, 0, 0)):
        rows = [(7, 1, i, 100, 0, i, s) for i, s in enumerate(ngram_join._sketches(sets))]
        df = spark.createDataFrame(rows, "key long, salts long, id long, n long, place long, comp long, sketch binary")
        assert ngram_join._apart(df, forest=False).count() == pairs
        forest = ngram_join._apart(df, forest=True).collect()
        assert len(forest) == least and len(ngram_join.contracted(*np.array([(r.a, r.b) for r in forest] or [(0, 0)]).T)[0]) == max(1, least + bool(least))


def shuffled(spark, df):
    """Rows that the shuffles of ``df`` write, by Spark's own metrics."""
    df.write.format("noop").mode("overwrite").save()
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().apply(store.executionsList().size() - 1).executionId()
    names = store.execution(last).get().metrics()
    ids = [names.apply(i).accumulatorId() for i in range(names.size()) if names.apply(i).name() == "shuffle records written"]
    values = store.executionMetrics(last)
    return sum(int(values.apply(i).replace(",", "")) for i in set(ids) if values.contains(i))


def test_rows_of_keys_with_several_components(spark):
    rng = random.Random(6)
    rows = [(key, 1 + 2 * (key % 50 == 0), i, 9, 0, key * 100 + (i % 2 if key % 3 else 0)) for key in range(400) for i in rng.sample(range(60), 3)]
    comps = {}
    for key, _, _, _, _, comp in rows:
        comps.setdefault(key, set()).add(comp)
    df = spark.createDataFrame(rows, "key long, salts long, id long, n long, place long, comp long")
    mixed = ngram_join._mixed(df)
    assert sorted((r.key, r.id) for r in mixed.collect()) == sorted((r[0], r[2]) for r in rows if len(comps[r[0]]) > 1)
    assert len(rows) <= shuffled(spark, mixed) < 2 * len(rows)


def test_only_texts_in_question_are_shuffled(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)], "doc_id long, text string")
    where = docs.filter("doc_id % 100 = 7").selectExpr("doc_id + 5 AS node", "doc_id AS rep_id", "xxhash64(text) AS rep_key")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = ngram_join._texts(docs, where)
        assert sorted((r.node, r.body) for r in texts.collect()) == [(i + 5, f"text {i}") for i in range(7, 3000, 100)]
        assert 60 <= shuffled(spark, texts) < 300
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
