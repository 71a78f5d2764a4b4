"""Toxic passages by maximum-scoring segments of token log-odds.

A token scores by the log-odds of its documents being toxic, with a Dirichlet
prior in proportion to the token's overall use. Prefixes of four to six letters
are scored too, and a token takes the most certain of its features; tokens
without a certain one cost a fixed penalty. In one pass over a text, linear in
its tokens, all maximal-scoring segments are found. A segment of score S in a
text of n tokens has the expectation K n exp(-lambda S) among clean texts of
that length; lambda follows from the clean texts' scores and K from their best
segments. The logarithms of all segments with an expectation under one add up,
and a logistic curve maps the sum to a probability.
"""

from __future__ import annotations

import math
import warnings
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced, tidied

#: Labelled rows that a fit uses at most, taken by the hash of doc_id; scoring covers all rows.
FIT_ROWS = 40_000
#: Share of the counts that the Dirichlet prior adds, and the least z-value of a feature.
PRIOR, LEAST_Z = 0.05, 3.0
PENALTY = 1.0
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»“”„‘’…–—¿¡"
RAW_KEPT = 1 << 17
#: Features that a task counts before it sends them.
FEATURES_HELD = 1 << 17


def features(token: str) -> list[str]:
    """The token itself and its prefixes, marked by a star."""
    return [token, *(token[:k] + "*" for k in (4, 5, 6) if len(token) > k)]


def tokens(text: str) -> list[str]:
    return [t for t in (w.strip(MARKS) for w in text.lower().split()) if t]


def segments(at: list[int], gain: list[float], penalty: float = PENALTY) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), where tokens ``at`` gain and each other token costs ``penalty``."""
    left: list[float] = []
    right: list[float] = []
    span: list[tuple[int, int]] = []
    link: list[int] = []
    total, last = 0.0, 0
    for pos, g in zip(at, gain):
        total -= penalty * (pos - last)
        low, start = total, pos
        total += g
        last = pos + 1
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j = link[j]
            if j < 0 or right[j] >= total:
                left.append(low), right.append(total), span.append((start, last)), link.append(j)
                break
            low, start = left[j], span[j][0]
            del left[j:], right[j:], span[j:], link[j:]
    return [(a, b, r - x) for (a, b), x, r in zip(span, left, right)]


@dataclass
class Model:
    """``gains`` of certain features; lambda and K of clean texts; the logistic curve."""

    gains: dict[str, float]
    lam: float = 1.0
    k: float = 1.0
    intercept: float = -2.0
    slope: float = 1.0
    known: dict[str, float] = field(default_factory=dict)

    def gain(self, raw: str) -> float:
        """Of a raw word: its most certain feature's log-odds less the penalty, or 0 if it has none."""
        got = self.known.get(raw)
        if got is None:
            token = raw.strip(MARKS)
            got = next((self.gains[f] for f in features(token) if f in self.gains), 0.0) if token else 0.0
            if len(self.known) > RAW_KEPT:
                self.known.clear()
            self.known[raw] = got
        return got

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        words = text.lower().split()
        gains = np.fromiter(map(self.gain, words), dtype=np.float64, count=len(words))
        at = np.flatnonzero(gains > 0)
        return len(words), segments(at.tolist(), gains[at].tolist()) if len(at) else []

    def expectation(self, n: int, score: float) -> float:
        return self.k * max(1, n) * math.exp(-self.lam * score)

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, list[tuple[int, int, float, float]]]:
        rated = [(a, b, s, self.expectation(n, s)) for a, b, s in found]
        rated = [x for x in rated if x[3] < 1]
        return sum(-math.log(max(x[3], 1e-300)) for x in rated), rated

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-(self.intercept + self.slope * math.log1p(evidence))))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def _training(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """Distinct texts of at most ``fit_rows`` labelled rows that aren't held out: body, toxic."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("body")).join(F.broadcast(known), "doc_id")
    return texts.groupBy("body").agg(F.max("toxic").alias("toxic"))


@tidied
def counted(batches: Iterator[pa.RecordBatch], held: int = FEATURES_HELD) -> Iterator[pa.RecordBatch]:
    """feature, toxic, n (documents that have the feature) of rows (body, toxic): in parts, once more than ``held`` features are counted."""

    def out(seen: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
        for toxic, c in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["feature", "toxic", "n"])

    seen: dict[int, Counter] = defaultdict(Counter)
    for batch in sliced(batches):
        for body, toxic in zip(batch.column("body").to_pylist(), batch.column("toxic").to_pylist()):
            seen[toxic].update({f for t in set(tokens(body)) for f in features(t)})
            if sum(map(len, seen.values())) > held:
                yield from out(seen)
                seen.clear()
    yield from out(seen)


def _gains(training: DataFrame, penalty: float) -> dict[str, float]:
    """Log-odds with a Dirichlet prior over the documents that have a feature, of features that are surely toxic."""
    counts = training.mapInArrow(counted, "feature string, toxic int, n long").groupBy("feature").agg(
        F.sum(F.col("n") * F.col("toxic")).alias("t"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("c")
    )
    all_t, all_c = (x or 0 for x in counts.agg(F.sum("t"), F.sum("c")).first())
    if not all_t or not all_c:
        return {}
    prior = F.lit(PRIOR) * (F.col("t") + F.col("c"))
    p0 = PRIOR * (all_t + all_c)
    t, c = F.col("t") + prior, F.col("c") + prior
    odds = F.log(t / (F.lit(all_t + p0) - t)) - F.log(c / (F.lit(all_c + p0) - c))
    z = odds / F.sqrt(1 / t + 1 / c)
    return {r["feature"]: r["odds"] - penalty for r in counts.select("feature", odds.alias("odds"), z.alias("z")).filter(F.col("z") >= LEAST_Z).filter(F.col("odds") > penalty).collect()}


def _lambda(scores: dict[float, float], penalty: float) -> float:
    """The positive root of sum p exp(lambda s) = 1 over the clean texts' token scores."""
    total = sum(scores.values())
    f = lambda x: sum(p / total * math.exp(min(700.0, x * s)) for s, p in scores.items()) - 1
    low, high = 1e-6, 1e-6
    while f(high) < 0 and high < 50:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def _curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Logistic regression on (value, clean, toxic) counts by Newton's method with a small ridge on the slope.

    A step is halved until the loss falls: it is convex, so this ends at its least value, where full steps may swing for ever.
    """
    x = np.array([[1.0, b[0]] for b in bins])
    clean, toxic = (np.array([b[k] for b in bins], dtype=float) for k in (1, 2))
    n, ridge = clean + toxic, np.diag([0.0, 1e-1])
    loss = lambda w: float((n * np.logaddexp(0, x @ w) - toxic * (x @ w)).sum() + w @ ridge @ w / 2)
    w = np.array([math.log((toxic.sum() + 1) / (clean.sum() + 1)), 0.0])
    for _ in range(100):
        p = np.exp(-np.logaddexp(0, -(x @ w)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(2), x.T @ (toxic - n * p) - ridge @ w)
        while np.abs(step).max() >= 1e-8 and loss(w + step) > loss(w):
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, penalty: float = PENALTY) -> Model:
    """A model from labelled rows that aren't held out; without both labels it predicts the clean side for all.

    So it does, with a RuntimeWarning, if there are both labels but no feature tells them apart.
    """
    training = _training(docs, labels, fit_rows).persist()
    try:
        model = Model(_gains(training, penalty))
        if not model.gains:
            if training.select("toxic").distinct().count() > 1:
                warnings.warn(f"no feature tells toxic from clean texts (z-value of {LEAST_Z}, log-odds over {penalty}): all texts count as clean", RuntimeWarning, stacklevel=2)
            return model
        held = docs.sparkSession.sparkContext.broadcast(model.gains)

        @tidied
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen = Model(held.value), Counter()
            for batch in sliced(batches):
                for body in batch.column("body").to_pylist():
                    seen.update(round(own.gain(w), 1) for w in body.lower().split())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.float64()), pa.array(list(seen.values()), pa.int64())], names=["gain", "n"])

        scores = {r["gain"] or -penalty: float(r["n"]) for r in training.filter("toxic = 0").mapInArrow(clean, "gain double, n long").groupBy("gain").agg(F.sum("n").alias("n")).collect()}
        best = max(model.gains.values())
        scores[best] = scores.get(best, 0.0) + 0.5
        model.lam = _lambda(scores, penalty)
        lam = model.lam

        @tidied
        def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, n_docs, total = Model(held.value), 0, 0.0
            for batch in sliced(batches):
                for body in batch.column("body").to_pylist():
                    n, found = own.scan(body)
                    n_docs += 1
                    total += max(1, n) * math.exp(-lam * max([0.0, *(s for _, _, s in found)]))
            yield pa.RecordBatch.from_arrays([pa.array([n_docs], pa.int64()), pa.array([total], pa.float64())], names=["n", "total"])

        n, total = training.filter("toxic = 0").mapInArrow(extremes, "n long, total double").agg(F.sum("n"), F.sum("total")).first()
        model.k = (n or 1) / (total or 1.0)
        own = docs.sparkSession.sparkContext.broadcast(model)

        @tidied
        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, seen = own.value, Counter()
            for batch in sliced(batches):
                for body, toxic in zip(batch.column("body").to_pylist(), batch.column("toxic").to_pylist()):
                    seen[round(math.log1p(m.evidence(*m.scan(body))[0]) * 20), toxic] += 1
            m.known.clear()
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in seen], pa.int64()), pa.array([t for _, t in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["bin", "toxic", "n"])

        rows = training.mapInArrow(binned, "bin long, toxic int, n long").groupBy("bin").agg(F.sum(F.col("n") * (1 - F.col("toxic"))).alias("c"), F.sum(F.col("n") * F.col("toxic")).alias("t")).collect()
        model.intercept, model.slope = _curve([(r["bin"] / 20, r["c"], r["t"]) for r in rows])
        model.known = {}
        return model
    finally:
        training.unpersist()


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id, score and passages (start and end in words, score, expectation) of every whole text.

    ``keep`` instead returns these columns of ``docs`` with the score as ``_score``.
    Null and empty texts have no passage and the score of a text without evidence; repeated rows score alike.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in sliced(batches):
            score, passages = [], []
            for text in batch.column(text_at).to_pylist():
                evidence, rated = m.evidence(*m.scan(text or ""))
                score.append(m.probability(evidence))
                passages.append([{"start": a, "end": b, "score": s, "expectation": e} for a, b, s, e in rated])
            if keep is not None:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "_score"])
            else:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expectation", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(passages, kind)], names=["doc_id", "score", "passages"])
        # The worker keeps the model until its next task, and idle workers stay.
        m.known.clear()

    if keep is not None:
        text_at = "text"
        rows = docs.select(*keep)
        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_score", T.DoubleType())]))
    text_at = "text"
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, passages array<struct<start:int,end:int,score:double,expectation:double>>")


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_passages.

    A null doc_id counts as not held out. Labels only fit the model; other columns are no inputs.
    """
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` under the threshold, with their own columns, whatever their names."""
    own = docs.columns
    # The score's own column must not meet one of the table's.
    plain = docs.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(own)])
    kept = scored(plain, fit(docs, labels), keep=plain.columns).filter(F.col("_score") < threshold).drop("_score")
    return kept.toDF(*own)
