import math
import random
from collections import Counter

import pyarrow as pa
import pytest

from corvane.llm import queries, toxicity
from corvane.llm.common import table


def all_maximal(scores):
    """Maximal-scoring segments by their definition: take the best, then go on left and right of it."""
    best = (0.0, None)
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best[0] + 1e-12:
                best = (total, (i, j + 1))
    if best[1] is None:
        return []
    a, b = best[1]
    shift = lambda xs, k: [(x + k, y + k, s) for x, y, s in xs]
    return all_maximal(scores[:a]) + [(a, b, best[0])] + shift(all_maximal(scores[b:]), b)


@pytest.mark.parametrize("seed", range(30))
def test_segments_are_the_maximal_ones(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 40)
    gains = {i: rng.uniform(0.2, 4.0) for i in range(n) if rng.random() < 0.4}
    scores = [gains.get(i, -1.0) for i in range(n)]
    got = toxicity.segments(sorted(gains), [gains[i] for i in sorted(gains)], 1.0)
    want = all_maximal(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


@pytest.mark.parametrize("seed", range(10))
def test_scan_finds_repeated_words_wherever_they_stand(seed):
    rng = random.Random(seed)
    model = toxicity.Model({"vile": 2.3717, "foul": 1.4143})
    words = [rng.choice(["vile", "foul", *"abcd"]) for _ in range(60)]
    n, found = model.scan(" ".join(words))
    want = all_maximal([model.gains.get(w, -toxicity.PENALTY) for w in words])
    assert n == 60 and [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in want]
    assert [s for *_, s in found] == pytest.approx([s for *_, s in want])


def test_a_passage_that_repeats_is_found_twice():
    _, found = toxicity.Model({"vile": 2.5, "foul": 1.5}).scan("vile foul vile " + "fine " * 30 + "vile foul vile")
    assert found == [(0, 3, 6.5), (33, 36, 6.5)]


def made(rng, n):
    clean = [f"w{i}" for i in range(200)]
    bad = ["vile", "foul", "nastyish"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_counts_leave_in_parts_within_a_batch():
    """One batch of many words: a task holds a bounded number of features, and the parts sum up to the whole."""
    rng = random.Random(3)
    body = [" ".join(f"w{rng.randrange(5000)}" for _ in range(20)) for _ in range(1000)] + [""]
    toxic = [i % 3 == 0 for i in range(1001)]
    batch = pa.RecordBatch.from_arrays([pa.array(body), pa.array(toxic).cast(pa.int32())], names=["body", "toxic"])
    parts = list(toxicity.counted(iter([batch]), held=500))
    assert len(parts) > 2 and max(p.num_rows for p in parts) <= 500 + 4 * 20
    got, want = Counter(), Counter()
    for p in parts:
        for x in p.to_pylist():
            got[x["feature"], x["toxic"]] += x["n"]
    for b, t in zip(body, toxic):
        want.update({(f, int(t)) for w in set(toxicity.tokens(b)) for f in toxicity.features(w)})
    assert got == want


def test_held_out_accuracy(spark):
    rows, labels = made(random.Random(1), 600)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(3, 0), (None, 1), (99999, 1), (4, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.report(docs, known).collect()}
    truth = dict(labels)
    held = [d for d, r in got.items() if r.held_out]
    assert len(held) > 100 and sum(got[d].predicted == truth[d] for d in held) / len(held) > 0.98
    kept = {r.doc_id for r in toxicity.without_toxic(docs, known).collect()}
    assert kept == {d for d, r in got.items() if not r.predicted}


def test_odd_rows_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "x " * 5000), (3, "x " * 5000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.report(docs, none).collect()
    assert len(out) == 5 and all(0 <= r.score < 0.3 and r.predicted == 0 for r in out)
    assert toxicity.report(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("toxic_of_ten", [4, 5, 8])
def test_many_toxic_labels(spark, toxic_of_ten):
    """However many of the labels are toxic, words that only toxic texts use are found."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        toxic = i % 10 < toxic_of_ten
        words = [f"w{rng.randrange(200)}" for _ in range(rng.randrange(5, 40))]
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "foul", "nastyish"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    got = toxicity.report(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).filter("held_out").collect()
    assert len(got) > 80 and all(r.predicted == labels[r.doc_id][1] for r in got)


@pytest.mark.parametrize("clean, toxic", [(31500, 3500), (17500, 17500), (140000, 20000)])
@pytest.mark.parametrize("from_", [2.5, 4.0, 6.0])
def test_the_curve_is_where_its_gradient_is_nought(clean, toxic, from_):
    """Evidence of toxic texts in a narrow range, and of a twentieth of the clean ones below it."""
    bins = [(0.0, clean, 0)] + [(i / 20, clean // 800, 0) for i in range(1, 40)] + [(from_ + i / 20, 0, toxic // 20) for i in range(20)]
    a, b = toxicity._curve(bins)
    p = [1 / (1 + math.exp(-a - b * x)) for x, _, _ in bins]
    off = [t - (c + t) * q for (_, c, t), q in zip(bins, p)]
    assert abs(sum(off)) < 1e-3 and abs(sum(o * x for o, (x, _, _) in zip(off, bins)) - 0.1 * b) < 1e-3
    assert all((q >= 0.3) == (x >= from_) for q, (x, _, _) in zip(p, bins))


def test_labels_that_nothing_tells_apart(spark):
    docs = spark.createDataFrame([(i, f"same words in row {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    with pytest.warns(RuntimeWarning, match="no feature"):
        assert toxicity.report(docs, labels).filter("predicted = 1").count() == 0


def test_table(spark, sf):
    out = queries.op2_toxicity(spark, sf)
    assert out.count() == table(spark, sf, "documents").count() and out.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_columns_with_names_of_the_scores_stay(spark, sf):
    from corvane.llm.common import table

    docs = table(spark, sf, "documents").selectExpr("*", "1 AS _score", "'x' AS c0", "2 AS score", "3 AS passages")
    out = toxicity.without_toxic(docs, table(spark, sf, "labels"))
    assert out.columns == docs.columns and out.filter("_score = 1 AND c0 = 'x'").count() == out.count() > 0
