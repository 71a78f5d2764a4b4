import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from corvane.llm import queries, sp_sample
from corvane.llm.common import table

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return sp_sample.Vocabulary(MODEL)


def sampler_of(vocabulary, k):
    s = sp_sample.Sampler.__new__(sp_sample.Sampler)
    s.v, s.k, s.lattices = vocabulary, k, sp_sample.Lattices(vocabulary)
    return s


def all_paths(vocabulary, word):
    """Every segmentation of a word with its weight, by brute force over the model's pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    known = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}

    def grow(i):
        if i == len(word):
            yield (), 0.0
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in known:
                piece = known[word[i:j]]
                for rest, w in grow(j):
                    yield (piece, *rest), w + vocabulary.log_weight[piece]

    paths = dict(grow(0))
    total = math.log(sum(math.exp(w) for w in paths.values()))
    return {p: w - total for p, w in paths.items()}


def test_lattice_probabilities_match_brute_force(vocabulary):
    s = sampler_of(vocabulary, 400)
    for word in ("the", "hello", "abab"):
        want = all_paths(vocabulary, "▁" + word)
        got = s.sample(np.array([5]), [word])[0]
        assert len(got) == min(400, len(want)) and len({tuple(x["ids"]) for x in got}) == len(got)
        for x in got:
            assert math.isclose(x["log_p"], want[tuple(x["ids"].tolist())], abs_tol=1e-4)
        values = [x["value"] for x in got]
        assert values == sorted(values, reverse=True)
        if len(want) <= 400:
            assert all(x["inclusion"] == 1.0 for x in got)


@pytest.mark.parametrize("text", ["a  b", "a   ", "  ab", "a     b c"])
def test_pieces_of_several_spaces_are_sampled(vocabulary, text):
    want = all_paths(vocabulary, "▁" + text.replace(" ", "▁"))
    got = sampler_of(vocabulary, len(want) + 1).sample(np.array([5]), [text])[0]
    # Where all but 1e-12 of the probability goes one way, the other ways are not told from nothing.
    assert {tuple(x["ids"].tolist()) for x in got} >= {ids for ids, w in want.items() if w > -25}
    assert any(vocabulary.bytes[i].count(b" ") > 1 for x in got for i in x["ids"])
    for x in got:
        assert math.isclose(x["log_p"], want[tuple(x["ids"].tolist())], abs_tol=1e-4)


@pytest.mark.parametrize("size", [300, 70_000])
def test_a_long_word_is_one_lattice(vocabulary, size):
    """Against the sum over all segmentations by a forward pass over the whole word."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    known = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    text = ("thequickbrownfoxandtheotherone" * size)[:size]
    word = "▁" + text
    forward = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        ways = [forward[i] + vocabulary.log_weight[known[word[i:j]]] for i in range(max(0, j - vocabulary.longest), j) if word[i:j] in known]
        forward[j] = max(ways) + math.log(sum(math.exp(w - max(ways)) for w in ways))
    s = sampler_of(vocabulary, 2)
    got = s.sample(np.array([5]), [text])[0]
    assert len(got) == 2 and all(s.decode(x["ids"]) == text for x in got)
    for x in got:
        assert math.isclose(x["log_p"], sum(vocabulary.log_weight[i] for i in x["ids"]) - forward[-1], rel_tol=1e-5, abs_tol=1e-3)


def test_first_and_second_samples_have_the_right_distribution(vocabulary):
    word, n = "ab c", 6000
    s = sampler_of(vocabulary, 2)
    want = {a + b: p + q for a, p in all_paths(vocabulary, "▁ab").items() for b, q in all_paths(vocabulary, "▁c").items()}
    out = s.sample(np.arange(n) * 7919 + 3, [word] * n)
    first = Counter(tuple(r[0]["ids"].tolist()) for r in out)
    second = Counter(tuple(r[1]["ids"].tolist()) for r in out)
    p = {k: math.exp(v) for k, v in want.items()}
    for k, v in p.items():
        assert abs(first[k] / n - v) < 5 * math.sqrt(v * (1 - v) / n) + 1e-3
        both = sum(p[x] * v / (1 - p[x]) for x in p if x != k)
        assert abs(second[k] / n - both) < 5 * math.sqrt(both * (1 - both) / n) + 1e-3
    # Horvitz-Thompson with the inclusion scores gives the whole probability back.
    estimate = np.mean([sum(math.exp(x["log_p"]) / x["inclusion"] for x in r) for r in out])
    assert abs(estimate - 1) < 0.05


def test_samples_depend_on_key_and_text_only(vocabulary):
    texts = ["some words here", "other", "some words here", ""]
    together = sampler_of(vocabulary, 3).sample(np.array([1, 2, 1, 9]), texts)
    alone = [sampler_of(vocabulary, 3).sample(np.array([k]), [t])[0] for k, t in zip([1, 2, 1, 9], texts)]
    ids = lambda rows: [x["ids"].tolist() for x in rows]
    assert [ids(r) for r in together] == [ids(r) for r in alone]
    assert ids(together[0]) == ids(together[2]) and len(together[3]) == 1


def test_round_trip_of_odd_texts_and_a_table(spark, sf):
    texts = [None, "", " ", "a  b\n\tc ", "▁mark ▁", "日本語 😀\x00", "x" * 700, "É" * 3, "￿"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sp_sample.segmentations(df, MODEL, k=3).collect()
    want = Counter((d, hashlib.sha256((t or "").replace("￿", "▁").encode()).hexdigest()) for d, t in rows)
    assert {(r.doc_id, r.decoded_sha256) for r in got} == set(want)
    assert sum(r.sample == 0 for r in got) == len(rows)
    docs = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in table(spark, sf, "documents").collect()}
    out = queries.op6_sp_sample(spark, sf).collect()
    assert {r.doc_id for r in out} == set(docs) and all(docs[r.doc_id] == r.decoded_sha256 for r in out)
    assert sp_sample.segmentations(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_the_query_returns_the_ids(spark, sf, vocabulary):
    s = sampler_of(vocabulary, 2)
    out = queries.op6_sp_sample(spark, sf).collect()
    assert out
    for r in out:
        assert len(r.ids) == r.n_pieces and hashlib.sha256(s.decode(np.array(r.ids)).encode()).hexdigest() == r.decoded_sha256


def test_workers_hold_no_lattices_after_their_tasks(spark):
    """Python workers stay for the next stages, and their memory with them."""
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('word', id, ' other', id * 7) AS text").repartition(4)
    assert sp_sample.segmentations(docs, MODEL, k=2).count() == 800

    def held(batches):
        import pyarrow as pa

        lattices = sp_sample._sampler(MODEL, 2, sp_sample.SHARPNESS).lattices
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(lattices.root)]), pa.array([lattices.edges.nbytes])], names=["words", "bytes"])

    got = spark.range(0, 16, 1, 16).mapInArrow(held, "words long, bytes long").collect()
    assert len(got) == 16 and all(r.words == 0 and r.bytes <= 1 << 16 for r in got)
