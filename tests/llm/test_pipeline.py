import corpus_pipeline
from corvane.llm import toxicity
from corvane.llm.common import table
from test_lines_and_benchmark import leaks
from test_ngram_join import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_matches_plain_python(spark, sf):
    docs = table(spark, sf, "documents")
    score = {(r.doc_id): r.score for r in toxicity.scored(docs, toxicity.fit(docs, table(spark, sf, "labels"))).collect()}
    rows = [(r.doc_id, r.text or "") for r in docs.collect() if score[r.doc_id] < corpus_pipeline.TOXIC_FROM]
    last = {}
    for doc, text in rows:
        last[text] = max(doc, last.get(text, doc))
    rows = [(d, t) for d, t in rows if last[t] == d]
    first = {d: c for d, _, c in brute(rows)}
    rows = [(d, t) for d, t in rows if first[d] == d]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    clean = {x[0] for x in leaks(rows, items, 10) if not x[-1]}
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.select("doc_id").collect()} == clean


def test_all_but_the_last_stage_keep_the_columns(spark, sf):
    docs = table(spark, sf, "documents").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == COLUMNS


def test_stages_of_an_empty_table(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
