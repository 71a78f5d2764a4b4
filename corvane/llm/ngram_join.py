"""Near-duplicate classes by a grouped prefix join on five-word shingles.

Shingles have one order for all documents: by hash, and after them the frequent
ones by count and hash. A document's prefix under it is so long that two
documents of similarity 0.75 share a prefix shingle.

* Documents with the same set are one node; nodes with the same prefix and size
  are one group. Groups are posted once under each shingle of their prefix, and
  shingles that one group alone posts are dropped.
* Pairs under a shingle must pass the size and position filters, and then a
  filter on sketches: the number of bits in which two parity sketches differ is
  a lower bound of the symmetric difference. Only then are whole sets compared.
* First each node is compared with the most similar of its neighbours under each
  shingle, which links most of a family of near copies. Then only shingles whose
  groups are still in different components are looked at: there every node
  outside the largest component meets all others, in blocks that are dealt out
  by (shingle, block), so that a hot shingle is many small tasks. Nodes bring
  their sketches along, so a task gives only pairs that pass all filters. At first
  it gives a forest of its most similar pairs, one less than it has components at
  most. Then all that are still apart are given, and of these
  the most similar for each node and other component are compared first, and
  what is then still apart after that.

No pair is skipped but for the filters and for nodes that are already connected,
so components are exact, and copies are never paired with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, salted_join, sliced, tidied, written
from .components import components, contracted
from .hashing import maybe_among, mix, ngrams_of, word_hashes

SHINGLE = 5
#: Similarity, as a fraction.
OVER, UNDER = 75, 100
#: Shingles that a task sums up before it sends counts.
FLUSH = 1 << 21
LEAST_T = 64
#: Neighbours that a group is paired with at first; groups of a block.
WIDTH, BLOCK = 3, 2048
#: Bits of a node's parity sketch for each shingle of its set; the next power of two is taken.
SKETCH_BITS = 2
#: Bits of a sketch at most; those of larger sets filter less.
MOST_SKETCH = 1 << 13
#: Rows, and bytes of them, that a task pairs at a time, whole keys aside; words of sketches that are compared at a time.
ROWS_HELD, BYTES_HELD, WORDS_AT_ONCE = 1 << 18, 1 << 25, 1 << 21


def _need(n: np.ndarray | int) -> np.ndarray | int:
    """Least overlap of a set of ``n`` with any partner."""
    return (OVER * n + UNDER - 1) // UNDER


def _shingle_sets(bodies: list[str], k: int) -> Iterator[np.ndarray]:
    for at in range(0, len(bodies), 64):
        for s in ngrams_of(*word_hashes([body.encode("utf-8", "replace").lower() for body in bodies[at : at + 64]]), k):
            s = np.sort(s)
            yield s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s


def _body() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), _body().alias("body"))


class Frequent:
    """The frequent shingles with their counts; ``of`` gives 0 for all others."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]

    def of(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(shingles), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
        return np.where(self.keys[at] == shingles, self.counts[at], 0)


def repeated(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those that come more than once, and how often. The array is sorted in place, so that besides it there is a byte or two for each shingle."""
    shingles.sort()
    edge = np.diff((shingles[1:] == shingles[:-1]).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    first = np.flatnonzero(edge == 1)
    return shingles[first], np.flatnonzero(edge == -1) - first + 1


def frequencies(docs: DataFrame, k: int = SHINGLE, least_t: int = LEAST_T) -> Frequent:
    """The shingles of more than T distinct sets, T being one for each 8 MB of text and ``least_t`` at least.

    Tasks sum up runs of two million shingles and send those that come twice in a run, so
    counts are lower bounds; they decide on the order of shingles and on nothing else. T grows
    with the corpus, so that at most about a million shingles, 16 bytes each, come to the driver.
    Null and empty texts count nothing; an empty table has no frequent shingle.
    """
    size = _rows(docs).agg(F.sum(F.octet_length("body")).alias("n")).first()["n"] or 0
    t = max(least_t, -(-size // (1 << 23)))

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, known = [], 0, set()

        def flush() -> pa.RecordBatch:
            shingles = np.concatenate(held)
            held.clear()
            shingles, counts = repeated(shingles)
            return pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(counts, pa.int64())], names=["key", "n"])

        for batch in sliced(batches):
            for s in _shingle_sets(batch.column("body").to_pylist(), k):
                own = xxhash.xxh3_64_intdigest(s.tobytes())
                if own in known:
                    continue
                known.add(own)
                held.append(s)
                n += len(s)
                if n >= FLUSH:
                    yield flush()
                    n, known = 0, set()
        if n:
            yield flush()

    counted = _rows(docs).select("body").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > t).toArrow()
    return Frequent(counted.column("key").to_numpy().view(np.uint64), counted.column("n").to_numpy())


def _sketches(sets: list[np.ndarray]) -> list[bytes]:
    """A sketch per set, of a size that follows the set's: bit b is the parity of the shingles that fall on b."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    bits = np.minimum(MOST_SKETCH, 1 << np.ceil(np.log2(np.maximum(64, SKETCH_BITS * sizes))).astype(np.int64))
    base = np.cumsum(bits) - bits
    row = np.repeat(np.arange(len(sets)), sizes)
    at = (mix(np.concatenate([np.zeros(0, dtype=np.uint64), *sets]) + np.uint64(7)) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(base[row] + at, minlength=int(bits.sum())) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[b // 8 : (b + n) // 8] for b, n in zip(base.tolist(), bits.tolist())]


def _difference(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference of the sets behind two sketches; the larger one is folded."""
    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


class Sketches:
    """The sketches of a table's rows, compared many pairs at a time."""

    def __init__(self, column: pa.ChunkedArray):
        held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        _, ends, data = held.buffers()
        ends = np.frombuffer(ends, dtype=np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64) >> 3
        self.words = np.frombuffer(data, dtype=np.uint8)[: int(ends[-1]) << 3].view(np.uint64)
        self.begin, self.size = ends[:-1], np.diff(ends)

    def _of(self, rows: np.ndarray, size: int, to: int) -> np.ndarray:
        words = self.words[self.begin[rows][:, None] + np.arange(size)]
        while size > to:
            size //= 2
            words = words[:, :size] ^ words[:, size:]
        return words

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``_difference`` of the rows ``x`` and ``y``."""
        out = np.zeros(len(x), dtype=np.int64)
        kind = self.size[x] << 32 | self.size[y]
        for k in np.unique(kind).tolist():
            n_x, n_y = k >> 32, k & 0xFFFFFFFF
            to, some = min(n_x, n_y), np.flatnonzero(kind == k)
            step = max(1, WORDS_AT_ONCE // max(n_x, n_y))
            for at in range(0, len(some), step):
                part = some[at : at + step]
                out[part] = np.bitwise_count(self._of(x[part], n_x, to) ^ self._of(y[part], n_y, to)).sum(axis=1)
        return out


def nodes(docs: DataFrame, freq: Frequent, k: int = SHINGLE) -> DataFrame:
    """doc_id, row_key, n, node, grp, prefix, salts, sketch: node to salts are null for a document without shingles.

    ``prefix`` holds a group's shingles in the common order, ``salts`` into how many blocks each is split;
    a task gives them once per group.
    """
    held = docs.sparkSession.sparkContext.broadcast(freq)
    schema = "doc_id long, row_key long, n long, node long, grp long, prefix array<long>, salts array<int>, sketch binary"

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posted = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = list(_shingle_sets(batch.column("body").to_pylist(), k))
                node: list[int | None] = []
                grp: list[int | None] = []
                prefix: list[np.ndarray | None] = []
                salts: list[np.ndarray | None] = []
                for s in sets:
                    n = len(s)
                    if not n:
                        for column in (node, grp, prefix, salts):
                            column.append(None)
                        continue
                    count = held.value.of(s)
                    order = np.argsort(count, kind="stable")[: n - _need(n) + 1]
                    first = s[order]
                    node.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                    grp.append(xxhash.xxh3_64_intdigest(first.tobytes(), seed=n) - (1 << 63))
                    new = grp[-1] not in posted
                    if new:
                        if len(posted) > 1 << 20:
                            posted.clear()
                        posted.add(grp[-1])
                    prefix.append(first.view(np.int64) if new else None)
                    salts.append((1 + count[order] // BLOCK).astype(np.int32) if new else None)
                columns = [
                    batch.column("doc_id"), batch.column("row_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), pa.array(grp, pa.int64()),
                    pa.array(prefix, pa.list_(pa.int64())), pa.array(salts, pa.list_(pa.int32())), pa.array(_sketches(sets), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "n", "node", "grp", "prefix", "salts", "sketch"])

    return _rows(docs).select("doc_id", F.xxhash64("body").alias("row_key"), "body").mapInArrow(run, schema)


def _members(all_nodes: DataFrame) -> DataFrame:
    """One row per node: node, grp, n, the sketch, its least doc_id, and a row that has its text (rep_id, rep_key)."""
    same = [F.min(c).alias(c) for c in ("grp", "n", "sketch")]
    rep = F.min(F.struct("doc_id", "row_key")).alias("rep")
    one = all_nodes.filter("node IS NOT NULL").groupBy("node").agg(*same, F.min("doc_id").alias("least_id"), rep)
    return one.select("node", "grp", "n", "sketch", "least_id", F.col("rep.doc_id").alias("rep_id"), F.col("rep.row_key").alias("rep_key"))


def _postings(all_nodes: DataFrame) -> DataFrame:
    """key, salts, salt, id (the group), n, place: the groups' prefixes, without keys that one group alone has."""
    spread = all_nodes.filter("prefix IS NOT NULL").select("grp", "n", F.posexplode(F.arrays_zip("prefix", "salts")).alias("place", "at"))
    salts = F.col("at.salts")
    # Block and number of blocks in one number, size and place in another: less to shuffle.
    rows = spread.select(
        F.col("at.prefix").alias("key"), (F.pmod(F.xxhash64("grp"), salts.cast("long")) * (1 << 31) + salts).alias("block"), F.col("grp").alias("id"), (F.shiftleft("n", 31) + F.col("place")).alias("spot")
    )
    once = rows.repartition("key", "block").distinct()
    kept = once.withColumn("here", F.count(F.lit(1)).over(Window.partitionBy("key", "block"))).withColumn("salts", F.col("block") % (1 << 31)).filter("here > 1 OR salts > 1")
    low = F.lit((1 << 31) - 1)
    return kept.select("key", "salts", F.shiftright("block", 31).alias("salt"), "id", F.shiftright("spot", 31).alias("n"), F.col("spot").bitwiseAND(low).alias("place"))


def _passes(a: str, b: str) -> Column:
    """Size filter, and the position filter for the first shingle that two sets share."""
    n_a, n_b, at_a, at_b = (F.col(f"{x}.{c}") for c in ("n", "place") for x in (a, b))
    overlap = F.floor((OVER * (n_a + n_b) + (OVER + UNDER - 1)) / (OVER + UNDER))
    return (UNDER * F.least(n_a, n_b) >= OVER * F.greatest(n_a, n_b)) & (1 + F.least(n_a - at_a - 1, n_b - at_b - 1) >= overlap)


def _neighbours(posted: DataFrame, width: int) -> DataFrame:
    """For each group b the group a that most often is among the ``width`` groups before it under a key and block; the first groups of blocks meet likewise."""

    def chained(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("key", "salt").orderBy("x.n", "x.id")
        near = F.array(*(F.lag("x", i).over(order) for i in range(1, width + 1)))
        met = rows.select("x", near.alias("near")).select("x", F.explode("near").alias("y")).filter("y IS NOT NULL")
        return met.filter(_passes("x", "y")).select(F.col("y.id").alias("a"), F.col("x.id").alias("b"))

    rows = posted.select("key", "salt", "salts", F.struct("n", "id", "place").alias("x"))
    heads = rows.filter("salts > 1").groupBy("key", "salt").agg(F.min("x").alias("x")).select("key", F.lit(0).alias("salt"), "x")
    met = chained(rows.select("key", "salt", "x")).unionByName(chained(heads)).groupBy("b", "a").agg(F.count(F.lit(1)).alias("m"))
    return met.groupBy("b").agg(F.max(F.struct("m", "a")).alias("most")).select("most.a", "b")


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Of the pairs (a, b, comp_a, comp_b, differ) a spanning forest over their components, the most similar pairs first."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0], pairs[:, 4]))]
    comp, at = np.unique(pairs[:, 2:4], return_inverse=True)
    u, v = at.reshape(-1, 2).T
    rank, taken = np.arange(len(pairs)), [np.zeros(0, dtype=np.int64)]
    while len(rank):
        best = np.full(len(comp), len(pairs))
        for x in (u, v):
            np.minimum.at(best, x, rank)
        taken.append(np.unique(best[best < len(pairs)]))
        chosen = np.isin(rank, taken[-1])
        node, root = contracted(u[chosen], v[chosen])
        label = np.arange(len(comp))
        label[node] = root
        u, v = label[u], label[v]
        u, v, rank = u[u != v], v[u != v], rank[u != v]
    return pairs[np.concatenate(taken)]


def _candidates(key: np.ndarray, of: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of equal ``key``, by size, that pass the size and position filters and lie in different components; the second is outside the key's largest component."""
    row_id, n, place, comp, salt, cross = (*(of[c] for c in ("id", "n", "place", "comp", "salt")), of["lo"] != of["hi"])
    by = np.lexsort((comp, key))
    fresh = np.r_[True, (key[by][1:] != key[by][:-1]) | (comp[by][1:] != comp[by][:-1])]
    run = np.flatnonzero(fresh)
    size = np.diff(np.r_[run, len(by)])
    largest = np.lexsort((size, key[by][run]))
    last = largest[np.r_[key[by][run][largest][1:] != key[by][run][largest][:-1], True]]
    minor = np.ones(len(key), dtype=bool)
    minor[by[np.isin(np.cumsum(fresh) - 1, last)]] = False
    # Two rows of the largest component are never apart, so only the others look for partners: ahead, and back for rows of the largest.
    for step in (1, -1):
        i, d = np.flatnonzero(minor), 0
        while len(i):
            d += step
            i = i[(i + d >= 0) & (i + d < len(key))]
            i = i[(key[i] == key[i + d]) & (UNDER * np.minimum(n[i], n[i + d]) >= OVER * np.maximum(n[i], n[i + d]))]
            j = i + d
            overlap = -(-OVER * (n[i] + n[j]) // (OVER + UNDER))
            good = (comp[i] != comp[j]) & ~(cross[i] & (salt[i] == salt[j])) & (np.minimum(n[i] - place[i], n[j] - place[j]) >= overlap)
            if step < 0:
                good &= ~minor[j]
            x, y = j[good], i[good]
            swap = minor[x] & (row_id[x] > row_id[y])
            yield np.where(swap, y, x), np.where(swap, x, y)


def _met(key: np.ndarray, of: dict[str, np.ndarray], sketches: Sketches, forest: bool) -> np.ndarray:
    """The ``_candidates`` whose sketches allow the similarity, or a forest of them, as (a, b, comp_a, comp_b, differ)."""
    row_id, n, comp = of["id"], of["n"], of["comp"]
    found, held, total = [np.zeros((0, 5), dtype=np.int64)], [], 0

    def sift() -> None:
        x, y = (np.concatenate(c) for c in zip(*held))
        differ = sketches.differ(x, y)
        keep = differ <= n[x] + n[y] - 2 * (-(-OVER * (n[x] + n[y]) // (OVER + UNDER)))
        found.append(np.stack([row_id[x], row_id[y], comp[x], comp[y], differ], axis=1)[keep])
        if forest:
            found[:] = [_forest(np.concatenate(found))]

    for pair in _candidates(key, of):
        held.append(pair)
        total += len(pair[0])
        if total > ROWS_HELD or len(held) > 4096:
            sift()
            held, total = [], 0
    if held:
        sift()
    return np.unique(np.concatenate(found), axis=0)


def _by_key(rows: DataFrame, make: Callable[[np.ndarray, dict[str, np.ndarray], pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``make`` gives for whole keys of rows (key, salts, id, n, place, comp, ...), by size; it gets numbers of keys, and the columns by name.

    A key that is cut into ``salts`` blocks is a key of its own for each pair of blocks, so a task
    holds two blocks at a time.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        total = size = 0

        def made(table: pa.Table) -> pa.RecordBatch:
            of = {c: table.column(c).to_numpy() for c in table.column_names if c != "sketch"}
            return make(np.cumsum(np.r_[0, np.any([of[c][1:] != of[c][:-1] for c in ("key", "lo", "hi")], axis=0)]), of, table)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            total, size = total + batch.num_rows, size + batch.nbytes
            if total < ROWS_HELD and size < BYTES_HELD:
                continue
            # All but the last key, which may go on.
            table = pa.Table.from_batches(held)
            last = [table.column(c).to_numpy() == table.column(c)[-1].as_py() for c in ("key", "lo", "hi")]
            cut = int(np.flatnonzero(~np.all(last, axis=0)).max(initial=-1)) + 1
            if cut:
                yield made(table.slice(0, cut))
            table = table.slice(cut)
            held, total, size = table.to_batches(), table.num_rows, table.nbytes
        if total:
            yield made(pa.Table.from_batches(held))

    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("other")
    spread = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts"))).select("*", other)
    spread = spread.withColumns({"lo": F.least("salt", "other"), "hi": F.greatest("salt", "other")}).drop("other")
    return spread.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "n", "id").mapInArrow(run, schema)


def _paired(rows: DataFrame) -> DataFrame:
    """The rows (key, salts, place, id) of ``rows`` that have any candidate, so that no others fetch their sketches."""

    def make(key: np.ndarray, of: dict[str, np.ndarray], table: pa.Table) -> pa.RecordBatch:
        hit = np.zeros(len(key), dtype=bool)
        for x, y in _candidates(key, of):
            hit[x] = hit[y] = True
        return pa.RecordBatch.from_arrays([pa.array(of[c][hit], pa.int64()) for c in ("key", "salts", "place", "id")], names=["key", "salts", "place", "id"])

    return _by_key(rows, make, "key long, salts long, place long, id long").distinct()


def _apart(rows: DataFrame, forest: bool) -> DataFrame:
    """Pairs (a, b, comp_a, differ) that pass all filters and lie in different components, of rows (key, salts, id, n, place, comp, sketch); b is outside the largest component.

    With ``forest``, a task gives a forest of the pairs that it has at a time, so no more rows than it reads.
    """

    def make(key: np.ndarray, of: dict[str, np.ndarray], table: pa.Table) -> pa.RecordBatch:
        met = _met(key, of, Sketches(table.column("sketch")), forest)
        return pa.RecordBatch.from_arrays([pa.array(met[:, c]) for c in (0, 1, 2, 4)], names=["a", "b", "comp_a", "differ"])

    return _by_key(rows, make, "a long, b long, comp_a long, differ long").distinct()


def _expanded(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b, differ, comp_a) of members of the group pairs (a, b), in different components, whose sketches allow the similarity."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy()
            differ = np.array([_difference(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("a_sketch"), batch.column("b_sketch"))], dtype=np.int64)
            most = n_a + n_b - 2 * (-(-OVER * (n_a + n_b) // (OVER + UNDER)))
            keep = pa.array(differ <= most)
            columns = [batch.column(c).filter(keep) for c in ("a_node", "b_node", "a_comp")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(differ[differ <= most], pa.int64())], names=["a", "b", "comp_a", "differ"])

    of = lambda x: members.hint("merge").select(F.col("grp").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("node", "comp", "n", "sketch")))
    met = groups.join(of("a"), "a").join(of("b"), "b").filter("a_comp <> b_comp AND a_node <> b_node")
    met = met.filter(UNDER * F.least("a_n", "b_n") >= OVER * F.greatest("a_n", "b_n"))
    return met.drop("a", "b").mapInArrow(run, "a long, b long, comp_a long, differ long")


def _texts(docs: DataFrame, where: DataFrame) -> DataFrame:
    """node, body: the texts of the nodes of ``where`` (node, rep_id, rep_key).

    A bitmap keeps the other texts out of the shuffle.
    """
    asked = maybe_among(docs, where.select(F.col("rep_key").alias("row_key")))
    texts = asked.select(F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(_body()).alias("own_key"), _body().alias("body"))
    return texts.join(where, F.col("own_id").eqNullSafe(F.col("rep_id")) & (F.col("own_key") == F.col("rep_key"))).select("node", "body")


def _linked(docs: DataFrame, pairs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The pairs whose sets reach the similarity; sets are made again from the texts of the nodes in question."""

    @tidied
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = set()
            keep = [not (x in known or known.add(x)) for x in batch.column("node").to_pylist()]
            batch = batch.filter(pa.array(keep, pa.bool_()))
            for part in sliced([batch]):
                bodies = [s.tobytes() for s in _shingle_sets(part.column("body").to_pylist(), k)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(bodies, pa.binary())], names=["node", "shingles"])

    @tidied
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(UNDER * shared >= OVER * (len(x) + len(y) - shared))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    where = written(members.join(asked, "node").select("node", "rep_id", "rep_key"), "asked")
    sets = _texts(docs, where).mapInArrow(whole, "node long, shingles binary").dropDuplicates(["node"])
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    links = written(pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b").mapInArrow(compare, "a long, b long"), "links")
    forget(where)
    return links


def _placed(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with comp: the component that ``links`` put a node in, or the node itself."""
    known = components(links)
    placed = written(members.join(known, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "placed")
    forget(known)
    return placed


def _mixed(labelled: DataFrame) -> DataFrame:
    """The rows whose key has several components; one of one component has no pair that is apart.

    Rows of a key that isn't cut into blocks are shuffled once; only the keys of several blocks are joined by salts.
    """
    of_key = Window.partitionBy("key")
    whole = labelled.filter("salts = 1").withColumns({"lo": F.min("comp").over(of_key), "hi": F.max("comp").over(of_key)}).filter("lo <> hi").drop("lo", "hi")
    hot = labelled.filter("salts > 1")
    keys = hot.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    return whole.unionByName(salted_join(hot, keys, "key"))


def _left(posted: DataFrame, placed: DataFrame, forest: bool = False) -> DataFrame:
    """Pairs (a, b, comp_a, differ) of nodes in different components that the filters leave possible, or with ``forest`` some of them that connect the rest."""
    groups = placed.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"))
    # A group whose members lie in several components is apart from all others, and its members may be linked with each other.
    of_group = groups.select(F.col("grp").alias("id"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("grp")).alias("comp"))
    labelled = written(posted.drop("salt").join(of_group, "id"), "labelled")
    paired = written(_paired(_mixed(labelled)), "paired")
    forget(labelled)
    rows = paired.withColumnRenamed("id", "grp").join(placed, "grp")
    across = _apart(rows.select("key", "salts", F.col("node").alias("id"), "n", "place", "comp", "sketch"), forest)
    split = placed.join(groups.filter("lo <> hi").select("grp", (1 + F.floor(F.col("m") / BLOCK)).alias("salts")), "grp")
    inside = _apart(split.select(F.col("grp").alias("key"), "salts", F.col("node").alias("id"), "n", F.lit(0).cast("long").alias("place"), "comp", "sketch"), forest)
    return across.unionByName(inside).distinct()


def _nearest(pairs: DataFrame, *by: str) -> DataFrame:
    """Of the pairs (a, b) of each ``by`` the one with the most similar sketches, as (smaller, larger) node."""
    best = pairs.groupBy(*by).agg(F.min(F.struct("differ", "a", "b")).alias("p"))
    return best.select(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b")).distinct()


def classes(docs: DataFrame, k: int = SHINGLE, least_t: int = LEAST_T, width: int = WIDTH, keyed: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach), and row_key, a hash of the text, if ``keyed``.

    * Lower-case is ASCII only; words are runs of anything but ASCII white space. A text of fewer than ``k``
      words is one shingle; null and empty texts have none and link with nothing.
    * Documents with equal sets are linked. Repeated rows are one class; rows whose doc_id is null are
      counted as members, and a class of null ids only has a null id.
    * An empty table gives an empty result; other columns are ignored.
    """
    all_nodes = written(nodes(docs, frequencies(docs, k, least_t), k), "nodes", compression="zstd")
    members = written(_members(all_nodes), "members")
    posted = written(_postings(all_nodes), "postings")
    of_doc = written(all_nodes.select("doc_id", *(["row_key"] if keyed else []), F.col("n").alias("n_shingles"), "node"), "node-of-doc")
    forget(all_nodes)
    # Each node tries the most similar of its neighbours; members of a group try its first member.
    first = members.groupBy("grp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("grp", "first")
    within = members.join(first, "grp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"), F.lit(0).cast("long").alias("differ"))
    near = _expanded(_neighbours(posted, width), members.withColumn("comp", F.col("node"))).select("a", "b", "differ")
    tried = [written(_nearest(near.unionByName(within), "b"), "pairs")]
    links = [_linked(docs, tried[0], members, k)]
    sketched = members.drop("least_id", "rep_id", "rep_key")
    # Then the most similar pairs that would connect what is apart.
    placed = _placed(sketched, links[0])
    tried.append(written(_left(posted, placed, forest=True).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs"))
    forget(placed)
    links.append(_linked(docs, tried[1], members, k))
    # Then the most similar node of each other component that it may be linked with.
    placed = _placed(sketched, links[0].unionByName(links[1]))
    left = written(_left(posted, placed), "left")
    forget(placed)
    tried.append(written(_nearest(left, "b", "comp_a"), "pairs"))
    links.append(_linked(docs, tried[2], members, k))
    # Then all of these pairs that are still apart.
    comps = components(links[0].unionByName(links[1]).unionByName(links[2]))
    comp = lambda x: comps.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}"))
    rest = left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried[0].unionByName(tried[1]).unionByName(tried[2]), ["a", "b"], "left_anti")
    rest = rest.join(comp("a"), "a", "left").join(comp("b"), "b", "left").filter("coalesce(comp_a, a) <> coalesce(comp_b, b)").select("a", "b")
    tried.append(written(rest, "pairs"))
    links.append(_linked(docs, tried[3], members, k))
    final = _placed(members.select("node", "least_id"), links[0].unionByName(links[1]).unionByName(links[2]).unionByName(links[3]))
    least = final.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    by_node = salted_join(final.select("node", "comp"), least, "comp").select("node", "component_id")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    result = written(of_doc.join(by_node, "node", "left").select("doc_id", *(["row_key"] if keyed else []), "n_shingles", component), "classes")
    for done in (of_doc, members, posted, left, comps, final, *tried, *links):
        forget(done)
    return result


def first_of_class(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their class's smallest, with their own columns; rows that repeat an id and a text all stay or go.

    A row is known by its id and its text, so of one id with two texts the one may stay and the other go.
    Rows without shingles and rows with a null doc_id stay: they are nobody's copy by name.
    """
    found = classes(docs, k, keyed=True)
    stay = found.filter(F.col("doc_id").isNotNull() & (F.col("doc_id") == F.col("component_id")))
    stay = stay.select(F.col("doc_id").alias("_kept_id"), F.col("row_key").alias("_kept_key")).distinct()
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    kept = docs.join(stay, (docs["doc_id"].cast("long") == F.col("_kept_id")) & (key == F.col("_kept_key")), "left_semi")
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))
