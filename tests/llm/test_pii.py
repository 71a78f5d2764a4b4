import hashlib
import re

from corvane.llm import pii, queries
from corvane.llm.common import table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}", kind) for m in re.finditer(p, text or "") if good(kind, m.group())]
    out.sort()
    return [sum(x[3] == k for x in out) for k in PATTERNS], ",".join(x[2] for x in out)


def check(df, rows):
    got = sorted((r.doc_id, [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256, r.spans) for r in df.collect())
    want = sorted((doc, *brute(text)) for doc, text in rows)
    assert len(got) == len(want)
    for (doc, counts, sha, spans), (d, n, joined) in zip(got, want):
        assert (doc, counts, sha) == (d, n, hashlib.sha256(joined.encode()).hexdigest())
        assert set(filter(None, joined.split(","))) <= set(spans.split(","))


def test_table(spark, sf):
    check(queries.op7_pii(spark, sf), [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()])


def test_edges(spark):
    texts = [
        None, "", "a@b.c@d.e x@y", "é a@b.com-x@d.e.f, ..@-.-", "1.2.3.4.5 256.1.1.1 0001.2.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111",
        "+1 (677) 555-7033. +12 +1 2 3 4 5 6 7 8 9 0 ) +1234567890123456", "😀 4111111111111111😀 a@b.cd", "9" * 5000 + " " + "1 " * 3000, "a" * 5000 + "@b.c",
        'token = a1b2c3d4e5f6a7b8c9 and key: "99aa88bb77cc66dd55ee" version 1.2.3', "4" * 14 + " " + "0" * 19,
    ]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    check(pii.report(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_empty_table(spark):
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_and_grouped_values_are_candidates(spark):
    texts = [
        "PIN 4711 is set", "password: ab12c", "code 123456 now", "iban DE89 3704 0044 0532 0130 00 here", "iban GB29 NWBK 6016 1331 9268 19, thanks", "tel 030 1234 567.",
        "passport C01X 00T47", "a@b", "in 2020 we", "1 " * 3000,
    ]
    rows = list(enumerate(texts))
    found = pii.candidates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    tokens = lambda i: {r.token for r in found if r.doc_id == i}
    whole = ["4711", "ab12c", "123456", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "030 1234 567", "C01X 00T47", "a@b", "2020", ("1 " * 3000).strip()]
    assert all(token in tokens(i) for i, token in enumerate(whole))
    assert all(texts[r.doc_id][r.start : r.end] == r.token for r in found)


def test_a_grouped_value_is_one_span(spark):
    filler = [(i, f"plain words on page {i} of version {i % 7}.{i % 3}") for i in range(200)]
    texts = ["iban DE89 3704 0044 0532 0130 00 here", "tel: 030 1234 567 or mail"] * 20
    df = spark.createDataFrame(filler + [(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert {got[1000 + i] for i in range(0, 40, 2)} == {"secret:5:32"}
    assert {got[1000 + i] for i in range(1, 40, 2)} == {"number:5:17"}
    assert not any(got[i] for i in range(200))


def test_reliable_labelers_win():
    patterns = [((1, 1, 0), 90), ((-1, -1, 0), 200), ((1, 1, -1), 10), ((-1, -1, 1), 10)]
    _, weights = pii.reliabilities(patterns)
    assert weights[0][1] > 2 > abs(weights[2][1]) and weights[0][-1] < -2
