import hashlib

import pytest

import verify
from corvane.llm import chat_format, exact_dedup, queries
from test_ngram_join import shuffled

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yes <|im_end|>"), (1, 1, "assistant", "yes <|im_end|>"), (2, None, None, None), (2, 3, "assistant", "<\\|x<\\\\|<|"),
    (None, 0, "a\nb%0A<|", "t\n"), (3, 0, "assistant", ""), (3, 1, "assistant", "<|im_start|>assistant\nfoo<|im_end|>\n"), (3, 2, "user", "x" * 100_000), (4, 0, "user", "<" * 50),
]


def test_every_conversation_reads_back(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS formatted", "1 AS level")
    out = chat_format.formatted(df)
    got = {r.conv_id: r for r in chat_format.read_back(out).collect()}
    assert len(got) == 5
    for conv, r in got.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in ROWS if c == conv))
        want = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(want.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    by_id = {r.conv_id: r for r in out.collect()}
    assert by_id[4].escape_level == 0 and by_id[1].escape_level == 1
    assert by_id[3].formatted.count("<|im_start|>") == 3 == by_id[3].formatted.count("<|im_end|>")


def test_broken_grammar_is_refused(spark):
    bad = ["x", "<|im_start|>a\nb", "<|im_start|>a<|im_end|>\n", "<|im_start|>a\nb<|im_end|>\nx", "<|im_start|>a\nb<|im_end|>c<|im_end|>\n"]
    df = spark.createDataFrame([(b,) for b in bad], "s string")
    assert df.select(chat_format.parse(df.s).isNull().alias("refused")).filter("refused").count() == len(bad)


def test_empty_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.formatted(df)).count() == 0


DOCS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "A"), (6, "a "), (7, "z" * 100_000), (8, "z" * 100_000), (2, "a"), (None, "b"), (9, "b"), (None, "only"), (None, "only")]


@pytest.mark.parametrize("bits", [256, 8])
def test_copies_are_found_by_whole_texts(spark, bits):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 AS salt", "'x' AS digest").repartition(5)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text_sha256, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df, digest_bits=bits).collect()), key=str)
    want = []
    for d, t in DOCS:
        same = [x for x, y in DOCS if (y or "") == (t or "")]
        keep = max((x for x in same if x is not None), default=None)
        want.append((d is None, d or 0, hashlib.sha256((t or "").encode()).hexdigest(), keep, len(same), d == keep))
    assert got == sorted(want, key=str)


def test_one_row_of_each_text_stays(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'en' AS lang")
    out = exact_dedup.deduplicated(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or -1, len(r.text or "")) for r in out.collect()) == [(-1, 4), (2, 1), (4, 0), (5, 1), (6, 2), (8, 100_000), (9, 1)]
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_texts_without_a_copy_are_not_shuffled(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(2000)] + [(i, f"text {i % 7}") for i in range(2000, 2030)], "doc_id long, text string")
    out = exact_dedup.deduplicated(df)
    assert sorted(r.doc_id for r in out.collect()) == list(range(7, 2000)) + list(range(2023, 2030))
    assert 0 < shuffled(spark, out) < 300


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, sf, name):
    assert verify.compare(spark, verify.connect(sf), name, queries.QUERIES[name], queries.ORACLES[name], sf) == ""
