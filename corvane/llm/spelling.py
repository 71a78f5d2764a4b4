"""Spelling variants: words one edit apart, and each word's far commoner form.

Words are counted by Spark. The counted words are ordered by length and cut into
shards of at most ``SHARD_WORDS``; each shard in its turn is broadcast as text
lines and becomes two compact tries in each worker (of the words, and of the words from their
end), in which a branch that holds one word is that word. For every word whose length allows it, the automaton of all
strings at most one edit away runs over the shard's tries depth-first. A task keeps,
for each of its words, only the number of neighbours found and the best of them;
Spark adds these up over the shards, so pairs are never shuffled.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, salted_join, written

#: Letters of a word: a fixed pattern.
RUN = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH = 7
LEAST_COUNT = 2
FORM_RATIO = 10
SLIP = 31
#: Words of a shard at most, so that neither a broadcast nor a worker's trie grows with the corpus.
SHARD_WORDS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """word and n of all words that are long and frequent enough.

    Of every ``slip``-th pair of document and run, by checksum, the run loses one letter; 0 leaves all runs as they are.
    Runs that are too short can't become words, so the pattern leaves them out.
    """
    pattern = f"{RUN}{{{least_length},}}"
    runs = F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER), F.lit(pattern), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    if slip:
        h = F.crc32(F.concat("doc", F.lit(":"), "run"))
        at = (h % F.char_length("run")).cast("int")
        cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
        each = each.select(F.when(h % slip == 0, cut).otherwise(F.col("run")).alias("word"))
    else:
        each = each.select(F.col("run").alias("word"))
    return each.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def trie(words: list[str]) -> dict | str:
    """Sorted distinct ``words`` as nested maps from letter to branch; a branch of one word is that word, and "" leads to one that ends there."""

    def branch(lo: int, hi: int, depth: int) -> dict | str:
        if hi - lo == 1:
            return words[lo]
        out: dict = {}
        while lo < hi:
            letter = words[lo][depth : depth + 1]
            end = lo + 1
            while end < hi and words[end][depth : depth + 1] == letter:
                end += 1
            out[letter] = words[lo] if not letter else branch(lo, end, depth + 1)
            lo = end
        return out

    return branch(0, len(words), 0) if words else {}


def neighbours(word: str, root: dict | str, back: dict | str) -> set[str]:
    """The words at exactly one inserted, deleted or replaced code point from ``word``, found depth-first.

    ``root`` is the trie of the words, ``back`` that of the words read from their end. The first finds edits in the second
    half of the word and the other those in the first half, so that branching begins where branches are few.
    """
    half = len(word) // 2
    return _walk(word, root, half) | {w[::-1] for w in _walk(word[::-1], back, len(word) - half)}


def _walk(word: str, root: dict | str, least: int) -> set[str]:
    """The words of the trie at one edit from ``word`` that is spent after ``least`` letters or more.

    While the edit is unspent, the automaton stays on the branch of ``word`` itself. At each of its nodes it spends the edit
    in every way, and what follows must agree to the end.
    """
    found: set[str] = set()
    node, depth = root, 0
    while type(node) is dict:
        if depth < least:
            node, depth = node.get(word[depth]), depth + 1
            continue
        letter, following = word[depth : depth + 1], word[depth + 1 : depth + 2]
        # Branches that begin as the rest of the word after the edit must: (branch, its depth, letters of the word read).
        ways = [(node, depth, depth + 1)] if letter and following in node else []
        for other, after in node.items():
            if other:
                if type(after) is str:
                    tail = after[depth + 1 :]
                    if tail == word[depth:] or (other != letter and letter and tail == word[depth + 1 :]):
                        found.add(after)
                    continue
                if letter in after:
                    ways.append((after, depth + 1, depth))
                if letter and other != letter and following in after:
                    ways.append((after, depth + 1, depth + 1))
        for after, a, b in ways:
            while type(after) is dict:
                after = after.get(word[b : b + 1])
                a, b = a + 1, b + 1
            if after is not None and after[a:] == word[b:]:
                found.add(after)
        node, depth = node.get(letter) if letter else None, depth + 1
    if node is not None:
        # The only word of its branch.
        a = depth
        while a < len(node) and a < len(word) and node[a] == word[a]:
            a += 1
        rest, left = node[a:], word[a:]
        if (rest or left) and (rest[1:] == left[1:] or rest[1:] == left or rest == left[1:]):
            found.add(node)
    found.discard(word)
    return found


class _Shard:
    """A broadcast shard's tries, forwards and backwards, built once in each worker."""

    known: tuple | None = None

    @classmethod
    def of(cls, key: str, rows: bytes) -> tuple:
        if cls.known is None or cls.known[0] != key:
            lines = [line.split(" ") for line in rows.decode().split("\n")]
            cls.known = None
            count = {w: int(n) for w, n in lines}
            cls.known = (key, trie(sorted(count)), trie(sorted(w[::-1] for w in count)), count)
            # The trie lives as long as the shard: the collector needn't walk over it again and again.
            gc.freeze()
        return cls.known


def _beside(words: DataFrame, key: str, rows: bytes) -> DataFrame:
    """word, n, n_near, best_n and best: what each of ``words`` finds in one shard; those that find nothing are left out."""
    held = words.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, root, back, count = _Shard.of(key, held.value)
        for batch in batches:
            out = []
            for word in batch.column("word").to_pylist():
                near = neighbours(word, root, back)
                if near:
                    best = min(near, key=lambda w: (-count[w], w))
                    out.append((word, len(near), count[best], best))
            columns = list(zip(*out)) or [[], [], [], []]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["word", "n_near", "best_n", "best"])

    return words.select("word").mapInArrow(run, "word string, n_near long, best_n long, best string")


def _shards(words: DataFrame, shard_words: int) -> DataFrame:
    """``words`` with ``shard``: neighbours by (length, hash), each shard of ``shard_words`` rows at most.

    Shards hold words of one length. How many a length needs comes from its count; a hash deals its words to them, and a
    shard that a hash fills beyond the bound is dealt to twice as many, until none is.
    """
    sized = words.withColumn("length", F.char_length("word"))
    lengths = [(r["length"], r["n"]) for r in sized.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()]
    parts = {length: -(-n * 5 // (4 * shard_words)) if n > shard_words else 1 for length, n in lengths}
    while True:
        of_length = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]) if parts else F.create_map(F.lit(0), F.lit(1))
        dealt = sized.withColumn("shard", F.pmod(F.xxhash64("word"), of_length[F.col("length")]).cast("int"))
        full = dealt.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_words).select("length").distinct().collect()
        if not full:
            return dealt
        for r in full:
            parts[r["length"]] *= 2


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, n_near, best_n and best (the commonest near word, the smallest of equals) of all words that have near words.

    ``words`` (word, n) is a written table. Shards of one or several neighbouring lengths are broadcast in turn, each bounded
    by ``shard_words``; a word meets those whose lengths differ by one at most from its own.
    """
    spark = words.sparkSession
    dealt = written(_shards(words, shard_words), "shards")
    sizes = dealt.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n")).orderBy("length", "shard").collect()
    groups: list[list] = []
    for r in sizes:
        if groups and sum(x["n"] for x in groups[-1]) + r["n"] <= shard_words:
            groups[-1].append(r)
        else:
            groups.append([r])
    found = []
    for i, group in enumerate(groups):
        here = F.lit(False)
        for r in group:
            here = here | ((F.col("length") == r["length"]) & (F.col("shard") == r["shard"]))
        rows = dealt.filter(here).select(F.concat_ws(" ", "word", F.col("n").cast("string")).alias("line")).toArrow().column("line").to_pylist()
        lo, hi = group[0]["length"] - 1, group[-1]["length"] + 1
        asked = dealt.filter(F.col("length").between(lo, hi)).repartition(spark.sparkContext.defaultParallelism * 4)
        found.append(written(_beside(asked, f"{id(dealt)}-{i}", "\n".join(rows).encode()), "near"))
    if not found:
        return words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(0).cast("long").alias("best_n"), F.col("word").alias("best")).limit(0)
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    # The largest of (n, smallest word): least of (-n, word).
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("b")
    result = written(every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best")), "best")
    for done in (dealt, *found):
        forget(done)
    return result


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of every word that has a form, by doubling the way each round.

    Each step multiplies the count by FORM_RATIO, so chains are short and the rounds few.
    """
    way = written(forms.select("word", F.col("form").alias("root")), "way")
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = salted_join(way, on, "root").select("word", F.col("further").alias("root"))
        moved = written(moved, "moved")
        if moved.isEmpty():
            return way
        way = written(way.join(moved.select("word"), "word", "left_anti").unionByName(moved), "way")


def variants(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    * Words are runs of Latin letters with A-Z lower-cased, of at least LEAST_LENGTH code points and LEAST_COUNT occurrences.
    * A word's form is its commonest near word (equals: the smallest in code-point order) if that is at least FORM_RATIO
      times as common, else null; root follows forms to the last.
    * Null and empty texts have no words; a null doc_id counts as an empty one in the checksum. Repeated rows count again.
    * An empty table gives an empty result; other columns are ignored.
    """
    words = written(counted(docs), "words")
    near = near_words(words, shard_words)
    form = F.col("best_n") >= FORM_RATIO * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", F.when(form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(form, F.col("best_n")).alias("form_n")
    )
    joined = written(joined, "forms")
    forget(near)
    roots = _roots(joined.filter("form IS NOT NULL"))
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
