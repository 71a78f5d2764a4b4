import tracemalloc

import numpy as np
import pyarrow as pa

from corvane.llm import components, ngram_join, sp_sample, toxicity
from corvane.llm.common import tidied


def held_mb():
    """Of this process, without mapped files."""
    with open("/proc/self/smaps") as f:
        return sum(int(x.split()[1]) for x in f if x.startswith("Anonymous:")) / 1024


def test_a_task_gives_its_memory_back():
    pinned = []

    def run(batches):
        # Too small to be mapped one by one; the last one keeps the heap from shrinking by itself.
        held = [np.ones(60_000, dtype=np.uint8) for _ in range(4000)]
        pinned.append(np.ones(60_000, dtype=np.uint8))
        yield from batches
        del held

    batch = pa.RecordBatch.from_pydict({"x": [1]})
    before = held_mb()
    assert sum(b.num_rows for b in run([batch])) == 1
    kept = held_mb() - before
    assert sum(b.num_rows for b in tidied(run)([batch])) == 1
    assert held_mb() - before < min(60, kept / 2)


def test_steps_of_the_pipeline_give_memory_back(spark, sf, monkeypatch):
    import corpus_pipeline
    from corvane.llm.common import table
    from pyspark.sql.classic.dataframe import DataFrame

    seen = []
    own = DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *a, **k: (seen.append(f), own(self, f, *a, **k))[1])
    docs = table(spark, sf, "documents").limit(60)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).count()
    assert {m.__name__ for m in (components, ngram_join, sp_sample, toxicity)} <= {f.__module__ for f in seen}
    assert all(hasattr(f, "__wrapped__") for f in seen)


def test_shingles_that_repeat_are_counted_in_place():
    rng = np.random.default_rng(3)
    for n, most in ((0, 1), (1, 1), (2, 1), (2, 1 << 60), (1000, 300), (1 << 20, 1 << 60), (1 << 20, 1 << 18)):
        x = rng.integers(0, most, n).astype(np.uint64)
        keys, counts = np.unique(x, return_counts=True)
        tracemalloc.start()
        got, often = ngram_join.repeated(x)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (got == keys[counts > 1]).all() and (often == counts[counts > 1]).all()
        # Of distinct shingles a few bytes each; the sorted copy and the edges of np.unique were 17 and more.
        assert most < 1 << 60 or peak < 5 * n + 50_000
