import base64
import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.llm import merkle, spelling, warc

# Spelling variants


def edits(word, letters):
    cut = {word[:i] + word[i + 1 :] for i in range(len(word))}
    put = {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    changed = {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return (cut | put | changed) - {word}


def test_automaton_finds_what_all_edits_find():
    dice = random.Random(5)
    words = sorted({"".join(dice.choice("abé") for _ in range(dice.randint(1, 7))) for _ in range(700)})
    root, back = spelling.trie(words), spelling.trie(sorted(w[::-1] for w in words))
    for word in [*words, "", "zzz", "ab" * 20]:
        assert spelling.neighbours(word, root, back) == edits(word, "abé") & set(words), word
    assert spelling.neighbours("a", spelling.trie([]), spelling.trie([])) == set()
    assert spelling.neighbours("a", "ab", "ba") == {"ab"}


TEXTS = [
    (1, "Colours colours COLOURS " * 40), (2, "colors colours"), (3, "colors; colorss"), (4, "colorss"), (5, None), (6, ""), (7, "short Été Été ÉTÉÉTÉÉT étéétéét"),
    (8, "étéétéét étéétéét"), (9, "x" * 50_000), (9, "x" * 50_000), (None, "colours colourz colourz"), (10, "aaaaaaa aaaaaab " * 12 + "aaaaaac aaaaaac"),
]


def brute_variants(rows):
    import regex

    n = Counter()
    for doc, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    letters = set("".join(n))
    form, near = {}, {}
    for w in n:
        near[w] = edits(w, letters) & set(n) if len(w) < 1000 else set()
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


@pytest.mark.parametrize("shard_words", [1, 3, 1000])
def test_variants_match_plain_python(spark, shard_words):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "'a' AS word", "1 AS n", "2 AS shard", "'r' AS run")
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in spelling.variants(df.repartition(3), shard_words).collect())
    assert got == brute_variants(TEXTS)
    assert any(form for _, form, *_ in got)


def test_chains_of_forms_reach_their_end(spark):
    forms = spark.createDataFrame([(str(i), str(i + 1)) for i in range(18)] + [("x", "0")], "word string, form string")
    assert {r.root for r in spelling._roots(forms).collect()} == {"18"}


def test_variants_of_an_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row, tampered=False):
    text = row[4].replace("\n", "") if tampered and row[4] is not None else row[4]
    return h(*(field(v) for v in (*row[:4], text)))


def climb(nodes):
    """Root and, for each node, its siblings left and right at each level."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            first = a // 3 * 3
            ways[i].append(("".join(nodes[first:a]), "".join(nodes[a + 1 : first + 3])))
        at = [a // 3 for a in at]
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], ways


def brute_manifest(rows):
    sources = sorted({r[3 - 2] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    sub, inner = [], {}
    for s in sources:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        root, ways = climb([leaf_of(r) for r in mine])
        sub.append(root)
        inner[s] = list(zip(mine, ways))
    top, outer = climb(sub)
    out = []
    for s, subroot, above in zip(sources, sub, outer):
        for row, way in inner[s]:
            steps = [*way, *above]
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            folded = leaf_of(row, changed)
            for left, right in steps:
                folded = h(left, folded, right)
            out.append((str(row[0]), leaf_of(row), subroot, top, h(*(a + b for a, b in steps)), folded, folded == top))
    return sorted(out)


def manifest_rows(n):
    dice = random.Random(n)
    rows = [(i, dice.choice([None, "", "a", "a", "a", "é", "z\n", "="]), dice.choice([None, "en"]), dice.choice([None, i]), dice.choice([None, "", "x\ny", "é\n" * 3, "plain"])) for i in range(n)]
    return rows + [(5, "a", "en", 1, "same\n")] * 3 + [(None, "a", None, None, None)] * 2 + [(7, "a", "en", 1, "w\n" * 50_000)]


@pytest.mark.parametrize("n, height", [(0, 8), (70, 1), (70, 2), (70, 8), (250, 1)])
def test_manifest_matches_plain_python(spark, n, height):
    rows = manifest_rows(n)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "'k' AS key", "1 AS id", "'h' AS h", "2 AS pos")
    got = merkle.manifest(df.repartition(3), height).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == brute_manifest(rows)


def test_manifest_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_ROWS", 7)
    rows = manifest_rows(120)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.manifest(df, 1).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == brute_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark):
    df = spark.createDataFrame([(3, "a", "en", 1, "x")], "doc_id long, source string, lang string, n_chars long, text string")
    (row,) = merkle.manifest(df).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == h() and row.verified
    assert merkle.manifest(df.limit(0)).count() == 0


# WARC archives

SPLIT = "\r\n\r\n"
PAGES = [
    (1, "http://a/", "x"), (2, "http://b/", "x"), (3, None, "x"), (4, "u\r\nv", None), (5, "w", ""), (6, "q", SPLIT * 3), (7, "q", f"a{SPLIT}WARC/1.1\r\nWARC-Type: response{SPLIT}b\r\n"),
    (8, "q", "é€" * 70_000), (9, "q", "é€" * 70_000), (10, "q", "\r\n"), (2, "http://b/", "x"), (None, "n", "x"), (None, "n", "only"), (None, "m", "only"), (11, "q", "y"), (11, "q", "y"),
]


def digest_of(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute_warc(rows, least):
    out = []
    for page, _, html in rows:
        body = html or ""
        same = [p for p, _, x in rows if (x or "") == body]
        keep = max((p for p in same if p is not None), default=None)
        again = len(body.encode()) >= least and keep is not None and page != keep
        out.append((str(page), len(body.encode()), digest_of(html), "revisit" if again else "response", str(keep) if again else "None"))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 2, 10**9])
def test_archives_read_back(spark, least):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'s' AS size", "1 AS salt", "2 AS keep_id", "'b' AS body")
    got = warc.report(df.repartition(3), least).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == brute_warc(PAGES, least)
    assert all(r.intact for r in got)


def test_archives_hold_each_payload_once(spark):
    df = spark.createDataFrame(PAGES[:10], "page_id long, url string, html string")
    found = warc.records(spark, warc.write_archives(df.coalesce(1)), payloads=True).collect()
    held = [bytes(r.payload).decode() for r in found if r.record_type == "response"]
    assert len(held) == len(set(held)) and set(held) == {html or "" for _, _, html in PAGES[:10]}
    assert all(r.payload is None for r in found if r.record_type == "revisit")
    assert {r.page_id: r.target_uri for r in found}[4] == "u%0D%0Av" and {r.page_id: r.target_uri for r in found}[3] == "urn:page:3"


def test_a_broken_archive_is_refused(spark, tmp_path):
    import gzip

    (tmp_path / "a.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 900\r\n\r\nshort\r\n\r\n"))
    with pytest.raises(Exception, match="inside a record"):
        warc.records(spark, f"file://{tmp_path}").collect()


def test_archives_of_an_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.report(df).count() == 0
    assert df.select(F.lit("a").alias("x"), warc.base32_sha1(F.lit("a"))).count() == 0
