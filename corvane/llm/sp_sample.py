"""Distinct sampled segmentations by Gumbel top-k over the SentencePiece lattice.

The lattice of a text has a node before each character and an edge for each
piece that spells the characters up to a later node. Pieces are weighted by
Zipf's law over their rank, so a path's probability is the product of its
pieces' weights over the sum of all paths. A word is a run of space marks and
what follows up to the next mark; pieces of marks only lie in the run, and no
other piece of the vocabularies used here has a mark but in front. So no piece
crosses a word's beginning, the lattice is a chain of word lattices, and each
word's backward sums are worked out once a worker.

Perturbed A* search finds the k segmentations of greatest perturbed
log-probability in order: the space starts as one region whose best path has a
Gumbel value at the total's place. Taking a region's best path off the queue
splits the rest of the region by where a path first leaves it; each part's own
maximum is a Gumbel at the logarithm of the part's probability, truncated at the
value taken off. The part of greatest value comes next, so paths come out
without replacement and no path is looked at that isn't output. The next value
in the queue is the threshold that turns a path's probability into its chance of
having been included. All draws are hashes of the row key and the place of the
draw, so a row's samples depend on nothing but its own key and text.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied
from .hashing import mix

#: Segmentations of each text, and the power of piece weights: 1 samples by Zipf weight, more favours common pieces.
K, SHARPNESS = 2, 1.0
#: Texts that are sampled together.
ROWS_AT_ONCE = 128
#: Distinct words and nodes of lattices that a task remembers, and bits of a table of beginnings.
WORDS_KEPT, NODES_KEPT, SLOT_BITS = 1 << 17, 1 << 21, 20
#: The mark of a space; the noncharacter that stands for such a mark in a text itself.
SPACE, STANDS_FOR_MARK = "▁", "\uffff"
WORD = re.compile(f"{SPACE}+[^{SPACE}]*")


class Vocabulary:
    """Pieces, their log weights by Zipf's law, their bytes, and hashes of all their beginnings."""

    def __init__(self, model_file: str, sharpness: float = SHARPNESS):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.of_byte = np.zeros(256, dtype=np.int32)
        pieces, ranks = {}, {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[i] = bytes([int(piece[3:5], 16)])
                self.of_byte[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)) and (SPACE not in piece[1:] or not piece.strip(SPACE)):
                self.bytes[i] = piece.replace(SPACE, " ").encode()
                pieces[piece] = i
                ranks[i] = -sp.get_score(i)
        harmonic = sum(1 / (r + 2.7) for r in ranks.values())
        self.log_weight = np.full(n, -np.inf)
        for i, r in ranks.items():
            self.log_weight[i] = -sharpness * math.log((r + 2.7) * harmonic)
        self.byte_weight = -sharpness * math.log((max(ranks.values(), default=1.0) + 3.7) * harmonic)
        # Hashes of the pieces' beginnings, sorted; the piece that each one is, or -1; where each hash's first bits begin.
        self.longest = max(map(len, pieces), default=1)
        known = {p[:size]: pieces.get(p[:size], -1) for p in pieces for size in range(1, len(p) + 1)}
        hashes = np.zeros(len(known), dtype=np.uint64)
        size = np.array([len(p) for p in known])
        code = np.zeros((len(known), self.longest), dtype=np.uint64)
        for row, p in zip(code, known):
            row[: len(p)] = [ord(c) for c in p]
        for k in range(self.longest):
            hashes = np.where(size > k, _longer(hashes, code[:, k]), hashes)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(list(known.values()), dtype=np.int64)[order]
        self.slots = np.searchsorted(self.hashes >> np.uint64(64 - SLOT_BITS), np.arange((1 << SLOT_BITS) + 1).astype(np.uint64)).astype(np.int32)
        self.depth = int(np.diff(self.slots).max())

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place in ``hashes`` of each hash, or -1."""
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = np.full(len(h), -1, dtype=np.int64)
        at, end = self.slots[slot].astype(np.int64), self.slots[slot + 1]
        open_ = np.flatnonzero(at < end)
        for _ in range(self.depth):
            if not len(open_):
                break
            place = at[open_]
            hit = self.hashes[place] == h[open_]
            out[open_[hit]] = place[hit]
            at[open_] += 1
            open_ = open_[~hit & (at[open_] < end[open_])]
        return out


def _longer(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + code + np.uint64(1))


class Lattices:
    """Word lattices side by side: for each node, edges (piece, next node) with cumulative probabilities.

    Node 0 is the end of all words. A character without a piece has one edge, -1 - its code, that stands for its byte pieces.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.release()

    def release(self) -> None:
        """Forget all words and give back the arrays, which else keep their size."""
        self.clear()
        self.nodes = np.zeros((2, 1 << 12), dtype=np.int32)
        self.edges = np.zeros((2, 1 << 12), dtype=np.int32)
        self.weights = np.zeros((2, 1 << 12), dtype=np.float32)

    def clear(self) -> None:
        self.root: dict[str, int] = {}
        self.n_nodes, self.n_edges = 1, 0

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        while x.shape[1] < n:
            x = np.concatenate([x, np.zeros_like(x)], axis=1)
        return x

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self.root))
        for at in range(0, len(new), 8192):
            self._learn(new[at : at + 8192])

    def _learn(self, words: list[str]) -> None:
        v = self.v
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        size = np.array([len(w) for w in words], dtype=np.int64)
        end = np.cumsum(size)
        n = len(code)
        left = np.repeat(end, size) - np.arange(n)
        at, h = np.arange(n), np.zeros(n, dtype=np.uint64)
        found = []
        for k in range(v.longest):
            live = left[at] > k
            at, h = at[live], h[live]
            if not len(at):
                break
            h = _longer(h, code[at + k])
            place = v.find(h)
            live = place >= 0
            at, h = at[live], h[live]
            piece = v.ids[place[live]]
            found.append(np.stack([at, np.full(len(at), k + 1), piece])[:, piece >= 0])
        src, length, piece = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
        bare = np.flatnonzero(np.bincount(src, minlength=n) == 0)
        low = code[bare].astype(np.int64)
        n_bytes = 1 + (low > 0x7F) + (low > 0x7FF) + (low > 0xFFFF)
        weight = np.r_[v.log_weight[piece], n_bytes * v.byte_weight]
        src, length = np.r_[src, bare], np.r_[length, np.ones(len(bare), dtype=np.int64)]
        piece = np.r_[piece, np.where(low > 0x7F, -1 - low, v.of_byte[low & 0x7F])]
        order = np.argsort(src * (v.longest + 1) + length)
        src, length, piece, weight = src[order], length[order], piece[order], weight[order]
        to = np.where(left[src] == length, n, src + length)
        # Backward sums: all nodes with one character left, then two, and so on.
        remaining = left[src].astype(np.uint16 if size.max() < 1 << 16 else np.int64)
        back = np.argsort(remaining, kind="stable")
        b_src, b_to, b_weight = src[back], to[back], weight[back]
        steps = np.searchsorted(remaining[back], np.arange(1, int(size.max()) + 2))
        total = np.zeros(n + 1)
        for a, b in zip(steps[:-1], steps[1:]):
            first = np.flatnonzero(np.r_[True, b_src[a + 1 : b] != b_src[a : b - 1]])
            total[b_src[a:b][first]] = np.logaddexp.reduceat(b_weight[a:b] + total[b_to[a:b]], first)
        log_p = np.minimum(weight + total[to] - total[src], 0.0)
        count = np.bincount(src, minlength=n)
        first = np.cumsum(count) - count
        running = np.cumsum(np.exp(log_p))
        above = running - np.repeat(np.r_[0.0, running][first], count)
        base, m = self.n_nodes, len(src)
        self.nodes, self.edges, self.weights = self._room(self.nodes, base + n), self._room(self.edges, self.n_edges + m), self._room(self.weights, self.n_edges + m)
        self.nodes[:, base : base + n] = first + self.n_edges, count
        self.edges[:, self.n_edges : self.n_edges + m] = piece, np.where(to == n, 0, to + base)
        self.weights[:, self.n_edges : self.n_edges + m] = log_p, above
        self.n_nodes += n
        self.n_edges += m
        self.root.update(zip(words, (end - size + base).tolist()))

    def arrays(self) -> tuple:
        """first and count of nodes; piece, next node, log-probability and cumulative probability of edges."""
        nodes, edges, weights = self.nodes[:, : self.n_nodes], self.edges[:, : self.n_edges], self.weights[:, : self.n_edges]
        return nodes[0], nodes[1], edges[0], edges[1], weights[0], weights[1]


def _drawn(h: np.ndarray, *place: np.ndarray | int) -> np.ndarray:
    """A hash that goes on from ``h`` by the place of the draw."""
    for p in place:
        h = _longer(h, np.asarray(p).astype(np.uint64))
    return h


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def uniform(key: np.ndarray, *place: np.ndarray | int) -> np.ndarray:
    """Numbers between 0 and 1, fixed by a row's key and the place of the draw."""
    return _unit(_drawn(np.atleast_1d(key).astype(np.uint64), *place))


def gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def truncated(log_mass: np.ndarray, bound: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """A Gumbel at ``log_mass`` given that it is under ``bound``."""
    return log_mass - np.logaddexp(log_mass - bound, np.log(-np.log(u)))


def _log1mexp(x: np.ndarray) -> np.ndarray:
    """log(1 - exp(x)) for x <= 0; -inf where nothing is left."""
    with np.errstate(divide="ignore"):
        return np.where(x > -1e-12, -np.inf, np.log(-np.expm1(np.minimum(x, -1e-12))))


class Path:
    """Edges in order, each with its word; values: of the regions that leave the path there; regions: edges excluded at a place."""

    __slots__ = ("edge", "word", "value", "log_p", "regions", "values")


def split_words(text: str) -> list[str]:
    """A text as SentencePiece sees it: a space goes in front, and a word is a run of spaces' marks and what follows up to the next one."""
    marked = (" " + text).replace(SPACE, STANDS_FOR_MARK).replace(" ", SPACE)
    return WORD.findall(marked)


class Sampler:
    def __init__(self, model_file: str, k: int = K, sharpness: float = SHARPNESS):
        self.v = Vocabulary(model_file, sharpness)
        self.lattices = Lattices(self.v)
        self.k = k

    def _walk(self, node: np.ndarray, key: np.ndarray, draw: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow each start node to its word's end by sampling edges; (which start, edge) in order of start and step."""
        first, count, _, to, _, above = self.lattices.arrays()
        who, step = np.flatnonzero(node > 0), 0
        node = node[who]
        h = _drawn(key[who].astype(np.uint64), draw[who], place[who])
        starts, edges = [who], []
        out_who, out_edge, out_step = [], [], []
        while len(who):
            u = _unit(_drawn(h, step))
            edge, last = first[node].astype(np.int64), first[node] + count[node] - 1
            low = np.flatnonzero((above[edge] < u) & (edge < last))
            while len(low):
                edge[low] += 1
                low = low[(above[edge[low]] < u[low]) & (edge[low] < last[low])]
            out_who.append(who)
            out_edge.append(edge)
            out_step.append(np.full(len(who), step))
            node = to[edge]
            live = node > 0
            who, node, h, step = who[live], node[live], h[live], step + 1
        if not out_who:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        w, e, s = np.concatenate(out_who), np.concatenate(out_edge), np.concatenate(out_step)
        order = np.lexsort((s, w))
        return w[order], e[order]

    def sample(self, keys: np.ndarray, texts: list[str]) -> list[list[dict]]:
        """For each text its samples: ids, log_p, value (perturbed log-probability) and inclusion, best value first."""
        if len(self.lattices.root) > WORDS_KEPT or self.lattices.n_nodes > NODES_KEPT:
            self.lattices.clear()
        split = [split_words(t) for t in texts]
        self.lattices.learn(set().union(*split))
        tables = self.lattices.arrays()
        sizes = np.array([len(w) for w in split], dtype=np.int64)
        node = np.fromiter(map(self.lattices.root.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(sizes.sum()))
        row = np.repeat(np.arange(len(texts)), sizes)
        begin = np.cumsum(sizes) - sizes
        place = np.arange(len(node)) - begin[row]
        keys = np.asarray(keys).astype(np.int64).view(np.uint64)
        who, edge = self._walk(node, keys[row], np.zeros(len(node), dtype=np.int64), place)
        cuts = np.searchsorted(row[who], np.arange(len(texts) + 1))
        top = gumbel(uniform(keys, 1 << 40))
        states = []
        for i in range(len(texts)):
            a, b = cuts[i], cuts[i + 1]
            path = self._path(edge[a:b], who[a:b] - begin[i], 0, float(top[i]), keys[i], 0, tables)
            states.append([path])
        found: list[list[Path]] = [[s[0]] for s in states]
        for draw in range(1, self.k):
            jobs = [(i, *self._next(states[i])) for i in range(len(texts))]
            jobs = [j for j in jobs if j[1] is not None]
            self._deviate(jobs, np.split(node, np.cumsum(sizes)[:-1]), keys, draw, tables, states, found)
        out = []
        for i in range(len(texts)):
            kappa = max((float(p.values.max()) for p in states[i] if len(p.values)), default=-np.inf)
            out.append([self._row(p, kappa, tables) for p in found[i]])
        return out

    def _path(self, edge: np.ndarray, word: np.ndarray, fixed: int, value: float, key: int, draw: int, tables: tuple, left: np.ndarray | None = None) -> Path:
        """``fixed``: the edges before it are shared with another path. ``left``: logarithm of the share of siblings that a region at ``fixed`` still has."""
        p = Path()
        p.edge, p.word, p.value = edge, word, value
        log_p = tables[4][edge].astype(np.float64)
        ahead = np.cumsum(log_p) - log_p
        p.log_p = float(log_p.sum())
        mass = ahead + _log1mexp(log_p)
        if left is not None and len(edge):
            mass[fixed] = ahead[fixed] + left
        p.values = np.full(len(edge), -np.inf)
        at = np.arange(fixed, len(edge))
        use = at[mass[fixed:] > -np.inf]
        if len(use):
            p.values[use] = truncated(mass[use], value, uniform(np.array([key], dtype=np.uint64), (1 << 41) + draw, use))
        p.regions = {}
        return p

    @staticmethod
    def _next(paths: list[Path]) -> tuple[Path | None, int]:
        best, where = None, -1
        top = -np.inf
        for p in paths:
            if len(p.values) and (v := p.values.max()) > top:
                best, where, top = p, int(p.values.argmax()), v
        return best, where

    def _deviate(self, jobs: list, words: list[np.ndarray], keys: np.ndarray, draw: int, tables: tuple, states: list, found: list) -> None:
        first, count, _, to, log_p, _ = tables
        heads, nodes, owner, places = [], [], [], []
        for n, (i, path, t) in enumerate(jobs):
            at = int(path.edge[t])
            start = int(np.searchsorted(first, first.dtype.type(at), "right")) - 1
            own = np.arange(first[start], first[start] + count[start])
            gone = path.regions.get(t, []) + [at]
            rest = own[~np.isin(own, gone)]
            p = np.exp(log_p[rest].astype(np.float64))
            u = float(uniform(np.array([keys[i]]), (1 << 42) + draw, t)[0]) * p.sum()
            chosen = int(rest[min(int(np.searchsorted(np.cumsum(p), u)), len(rest) - 1)])
            remaining = rest[rest != chosen]
            left = float(np.log(np.exp(log_p[remaining].astype(np.float64)).sum())) if len(remaining) else -np.inf
            heads.append((chosen, gone, left))
            word = int(path.word[t])
            tail = np.concatenate([to[chosen : chosen + 1], words[i][word + 1 :]]).astype(np.int64)
            nodes.append(tail)
            owner.append(np.full(len(tail), n))
            places.append(np.arange(word, word + len(tail)))
        if not jobs:
            return
        owner_all = np.concatenate(owner)
        key_all = keys[np.array([j[0] for j in jobs])][owner_all]
        who, edge = self._walk(np.concatenate(nodes), key_all, np.full(len(owner_all), draw), np.concatenate(places))
        cuts = np.searchsorted(owner_all[who], np.arange(len(jobs) + 1))
        word_of = np.concatenate(places)
        for n, (i, path, t) in enumerate(jobs):
            chosen, gone, left = heads[n]
            a, b = cuts[n], cuts[n + 1]
            edges = np.concatenate([path.edge[:t], [chosen], edge[a:b]]).astype(np.int64)
            word = np.concatenate([path.word[:t], [path.word[t]], word_of[who[a:b]]]).astype(np.int64)
            value = float(path.values[t])
            new = self._path(edges, word, t, value, keys[i], draw, tables, left)
            new.regions = {t: gone}
            path.values[t] = -np.inf
            states[i].append(new)
            found[i].append(new)

    def _row(self, p: Path, kappa: float, tables: tuple) -> dict:
        pieces = tables[2][p.edge]
        if len(pieces) and pieces.min() < 0:
            ids: list[int] = []
            for x in pieces.tolist():
                ids += [x] if x >= 0 else self.v.of_byte[list(chr(-1 - x).replace(STANDS_FOR_MARK, SPACE).encode("utf-8", "replace"))].tolist()
            pieces = np.array(ids, dtype=np.int64)
        inclusion = 1.0 if kappa == -np.inf else -math.expm1(-math.exp(min(700.0, p.log_p - kappa)))
        return {"ids": pieces.astype(np.int32), "log_p": p.log_p, "value": p.value, "inclusion": inclusion}

    def decode(self, ids: np.ndarray) -> str:
        """The text of any of its segmentations."""
        return b"".join(map(self.v.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


@functools.lru_cache(maxsize=1)
def _sampler(model_file: str, k: int, sharpness: float) -> Sampler:
    """The sampler of a worker process: its vocabulary serves the worker's next tasks; the lattices go with each task."""
    return Sampler(model_file, k, sharpness)


def row_key(doc_id: str = "doc_id") -> F.Column:
    return F.xxhash64(F.col(doc_id).cast("long"))


def segmentations(docs: DataFrame, model_file: str, k: int = K, sharpness: float = SHARPNESS, with_ids: bool = True) -> DataFrame:
    """Up to ``k`` rows per document: doc_id, sample (0 is best), ids (not without ``with_ids``), ids_crc32, n_pieces, log_p, value, inclusion, decoded_sha256.

    * Each row's ids decode to the document's text; ``decoded_sha256`` is of what they decode to.
    * A text has fewer rows if it has fewer segmentations: null and empty texts have one, a single space mark.
    * Repeated rows have equal keys and texts and give equal samples; a null doc_id is a key like another.
    * An empty table gives an empty result; other columns are ignored.
    """
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(model_file, k, sharpness)
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                    batch = whole.slice(at, ROWS_AT_ONCE)
                    samples = sampler.sample(batch.column("key").to_numpy(), batch.column("body").to_pylist())
                    doc = [d for d, s in zip(batch.column("doc_id").to_pylist(), samples) for _ in s]
                    flat = [x for s in samples for x in s]
                    ids = [x["ids"] for x in flat]
                    sizes = np.array([len(x) for x in ids], dtype=np.int32)
                    columns = {
                        "doc_id": pa.array(doc, pa.int64()),
                        "sample": pa.array([j for s in samples for j in range(len(s))], pa.int32()),
                        "n_pieces": pa.array(sizes, pa.int32()),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<i4")) for x in ids], pa.int64()),
                        **{c: pa.array([x[c] for x in flat], pa.float64()) for c in ("log_p", "value", "inclusion")},
                        "decoded_sha256": pa.array([hashlib.sha256(sampler.decode(x).encode("utf-8", "replace")).hexdigest() for x in ids], pa.string()),
                    }
                    if with_ids:
                        columns["ids"] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        finally:
            # Idle workers stay, also while other stages run, and what they hold counts against the executor's memory.
            sampler.lattices.release()

    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("key"), F.coalesce("text", F.lit("")).alias("body"))
    return rows.mapInArrow(run, "doc_id long, sample int, n_pieces int, ids_crc32 long, log_p double, value double, inclusion double, decoded_sha256 string" + ", ids array<int>" * with_ids)
