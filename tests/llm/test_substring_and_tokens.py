import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import queries, substring_dedup, token_binary
from corvane.llm.common import table


def brute(rows, window):
    first, out = {}, {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        ws = (text or "").encode().split()
        for i in range(len(ws) - window + 1):
            first.setdefault(tuple(ws[i : i + window]), doc)
    for doc, text in rows:
        ws = (text or "").encode().split()
        gone = set()
        for i in range(len(ws) - window + 1):
            if doc is not None and first[tuple(ws[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        out.setdefault((doc, len(ws), len(gone), hashlib.sha256(kept).hexdigest()), []).append(1)
    return {k: len(v) for k, v in out.items()}


def counted(df):
    out = {}
    for r in df.collect():
        k = (r.doc_id, r.n_words, r.n_removed, r.kept_sha256)
        out[k] = out.get(k, 0) + 1
    return out


def test_substring_dedup_matches_brute_force_on_a_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert counted(queries.op9_substring_dedup(spark, sf)) == brute(rows, 50)


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_matches_brute_force_on_tangled_texts(spark, seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(60):
        ws = []
        for _ in range(rng.randrange(5)):
            piece = list(rng.choice(base))[rng.randrange(20) : rng.randrange(30, 60)]
            if rng.random() < 0.3:
                piece[rng.randrange(len(piece))] = f"x{i}"
            ws += piece
        rows.append((rng.randrange(40), " ".join(ws)))
    rows += [(None, rows[0][1]), (7, None), (8, ""), (9, "a " * 300), (10, "a " * 300), (11, "é\xa0b " * 40), (12, "é\xa0b " * 40)] + rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = counted(substring_dedup.without_repeats(df, window=20, seed=6))
    want = brute(rows, 20)
    assert got == want


def test_substring_dedup_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, body string")
    assert substring_dedup.without_repeats(df).count() == 0


def test_numbers_round_trip_at_every_length():
    x = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 5], dtype=np.uint32)
    for n in range(len(x) + 1):
        control, data = token_binary.encode_numbers(x[:n])
        back = token_binary.decode_numbers(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n)
        assert (back == x[:n]).all()


def test_tokens_match_whole_text_encoding(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(file)
    texts = [None, "", "I'm don't 3.14 é \x1c a", "日本語 <|endoftext|> x", "a  b\tc", "\x85x " * 3, "long " * 30000]
    rows = [(i * 3 - 4, x) for i, x in enumerate(texts)] + [(2, "same"), (None, "gone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder, manifest, by_rank = token_binary.write_tokens(df, file, 2, docs_a_file=3)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_binary.read_tokens(spark, folder, manifest, by_rank).collect())
    at, want = 0, []
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], len(r[1] or ""))):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want.append((doc, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((d, n, c) for d, _, n, c in got) == sorted(want)
    for doc, start, n, _ in got:
        assert start == at
        at += n


def test_words_are_learnt_without_their_stops_and_give_whole_texts_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    whole, encoder, rng = Tokenizer.from_file(file), token_binary.WordEncoder(file), random.Random(5)
    alphabet = "aAbeEñÑüßÿéÀ×÷ªµ" * 3 + "x.,;'-&$1٣日ﬁİſ\u0301\u00a0\x1c\x0b\x0c\r\t\n      "
    texts = ["", " ", "Señó. señó, SEÑÓ señÓ\n", "<|endoftext|> b.", "\x01 a", "a\x010 <|", *("".join(rng.choices(alphabet, k=rng.randrange(200))) for _ in range(300))]
    for part in (pa.array(texts), pa.array(["ab", *texts]).slice(1), pa.array(texts[:3]), pa.array(texts[:0], pa.string())):
        ids, counts = encoder.encode(part, 2)
        want = [[*whole.encode(x, add_special_tokens=False).ids, 2] for x in part.to_pylist()]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    few = token_binary.WordEncoder(file)
    few.encode(pa.array(["año. año, año azul. azul, azul"]), 2)
    assert {w for w in few.index if w} == {"año", "azul", ".", ","}


def test_runs_of_numbers_are_coded_alike_one_by_one_and_together():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 4, 7, 0, 300, 2])
    x = (rng.integers(0, 1 << 32, counts.sum()) >> rng.integers(0, 32, counts.sum())).astype("<u4")
    ids, again = token_binary.from_runs(token_binary.runs(x, 4 * counts).slice(1, 5))
    assert again.tolist() == counts[1:6].tolist() and (ids == x[:312]).all()
    control, data = token_binary.encode_runs(x, counts)
    ends = np.cumsum(counts)
    assert list(zip(control.to_pylist(), data.to_pylist())) == [token_binary.encode_numbers(x[e - c : e]) for c, e in zip(counts, ends)]


def test_tokens_of_an_empty_table(spark):
    import public_tokenizers

    df = spark.createDataFrame([], "doc_id long, text string")
    out = token_binary.read_tokens(spark, *token_binary.write_tokens(df, public_tokenizers.path("word_bpe_49k.json")))
    assert out.count() == 0


@pytest.mark.parametrize("heavy", [1, 4, 1000])
def test_frequent_and_other_keys_meet_their_source_once(spark, monkeypatch, heavy):
    monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 40), (2, 10), (3, 2), (4, 1)) for i in range(n)], "k long, i int")
    sources = rows.groupBy("k").agg(F.min("i").alias("source"), F.count("i").alias("n")).filter("k < 4")
    got = substring_dedup._with_source(rows, sources, "k")
    assert sorted((r.k, r.i, r.source) for r in got.collect()) == sorted((r.k, r.i, 0) for r in rows.filter("k < 4").collect())
    assert substring_dedup._with_source(rows, sources.limit(0), "k").count() == 0
