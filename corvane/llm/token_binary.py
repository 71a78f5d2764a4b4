"""Token ids in byte-aligned variable-length files.

Ids are renumbered by how often the corpus uses them, so that frequent ids take
one byte. A file holds blocks; a block's numbers take one to four bytes each,
and two bits per number in separate control bytes say how many. A control byte
describes four numbers, and numpy decodes by looking the control bytes up in a
table of lengths.

File: the magic bytes, then blocks one after another until the end.
Block: three uint32 (documents, numbers, data bytes), the doc_ids as int64, the
documents' token counts as uint32, the control bytes, the data bytes; all
little-endian.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, new_path, sliced, written

MAGIC = b"TOKV1\n"
#: Documents in a file, and numbers in a block. A file holds whole documents.
DOCS_A_FILE, BLOCK = 4096, 1 << 20
#: Distinct words whose ids a worker process remembers.
WORDS_KEPT = 1 << 19
#: Ids of such words, and of texts that were encoded whole, until all are forgotten.
IDS_KEPT = 1 << 23
#: Texts whose words are looked up together: the more, the fewer look-ups of the same word.
TEXTS_AT_ONCE = 2048
#: Between words that are encoded together; texts that hold it are encoded whole.
MARK = "\x01"
#: Of words that end in such after a letter, the letters are learnt alone.
STOPS = (".", ",")
#: White space that is taken for a space; a word between two spaces may be empty.
BLANKS = "\t\n\x0b\x0c\r"
#: Letters of words that need no normalising once ASCII is lower-cased, but for lower-casing.
SMALL = {c for c in map(chr, range(0x100)) if c.isalpha() and (c >= "\u00C0" or "a" <= c <= "z")}
LETTERS = re.compile(f"[{''.join(sorted(SMALL))}]+")
LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], dtype=np.uint8)


def _packed(code: np.ndarray) -> bytes:
    """Control bytes of codes of two bits, four a byte; the last byte is filled up with zeros."""
    padded = np.zeros(-(-len(code) // 4) * 4, dtype=np.uint8)
    padded[: len(code)] = code
    a, b, c, d = (padded[k::4] for k in range(4))
    return (a | b << np.uint8(2) | c << np.uint8(4) | d << np.uint8(6)).tobytes()


def encode_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of uint32 numbers."""
    numbers = np.ascontiguousarray(numbers, dtype="<u4")
    code = (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    keep = np.arange(4, dtype=np.uint8)[None, :] <= code[:, None]
    return _packed(code), numbers.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def runs(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A column of the bytes of ``values``, cut into runs of so many bytes."""
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def from_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The uint32 numbers of a column of their bytes, and how many each row has."""
    held = column.cast(pa.binary())
    _, ends, data = held.buffers()
    if not len(held) or data is None:
        return np.zeros(0, dtype="<u4"), np.zeros(len(held), dtype=np.int64)
    ends = np.frombuffer(ends, dtype=np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].view("<u4"), np.diff(ends) // 4


def encode_runs(numbers: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Columns of control and data bytes, as ``encode_numbers`` gives them for each run of numbers."""
    numbers = np.ascontiguousarray(numbers, dtype="<u4")
    code = (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    keep = np.arange(4, dtype=np.uint8)[None, :] <= code[:, None]
    size = np.r_[0, np.cumsum(code + 1, dtype=np.int64)][np.r_[0, np.cumsum(counts)]]
    room = -(-counts // 4) * 4
    spaced = np.zeros(int(room.sum()), dtype=np.uint8)
    spaced[np.arange(len(code)) + np.repeat(np.cumsum(room - counts) - (room - counts), counts)] = code
    return runs(np.frombuffer(_packed(spaced), dtype=np.uint8), room // 4), runs(numbers.view(np.uint8).reshape(-1, 4)[keep], np.diff(size))


def joined(coded: list[tuple[bytes, bytes]], counts: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of runs of numbers put in a row, from those of each run. Data bytes stay as they are."""
    padded = -(-counts // 4) * 4
    shift = np.cumsum(padded - counts) - (padded - counts)
    code = LENGTHS[np.frombuffer(b"".join(c for c, _ in coded), np.uint8)].reshape(-1)
    return _packed(code[np.arange(int(counts.sum())) + np.repeat(shift, counts)] - np.uint8(1)), b"".join(d for _, d in coded)


def decode_numbers(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The numbers back, by table lookup of the control bytes."""
    lengths = LENGTHS[control].reshape(-1)[:count].astype(np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)]).astype(np.uint32)
    out = padded[starts] if count else np.zeros(0, dtype=np.uint32)
    for k in (1, 2, 3):
        out = out | np.where(lengths > k, padded[starts + k] << np.uint32(8 * k), np.uint32(0))
    return out.astype(np.uint32)


def write_blocks(ids: np.ndarray, counts: np.ndarray, coded: list[tuple[bytes, bytes]]) -> Iterator[bytes]:
    """A file's parts, from the coded numbers of one document after another."""
    yield MAGIC
    ends = np.cumsum(counts, dtype=np.int64)
    first = 0
    while first < len(ids):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        control, data = joined(coded[first:last], counts[first:last])
        yield np.array([last - first, counts[first:last].sum(), len(data)], dtype="<u4").tobytes()
        yield ids[first:last].astype("<i8").tobytes()
        yield counts[first:last].astype("<u4").tobytes()
        yield control
        yield data
        first = last


def read_blocks(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, token counts and numbers of each block."""
    if content[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    at = len(MAGIC)
    while at < len(content):
        docs, count, size = (int(x) for x in np.frombuffer(content, "<u4", 3, at))
        at += 12
        ids = np.frombuffer(content, "<i8", docs, at)
        counts = np.frombuffer(content, "<u4", docs, at + 8 * docs)
        at += 12 * docs
        n_control = -(-count // 4)
        control = np.frombuffer(content, np.uint8, n_control, at)
        data = np.frombuffer(content, np.uint8, size, at + n_control)
        at += n_control + size
        yield ids, counts, decode_numbers(control, data, count)


class WordEncoder:
    """Ids of whole texts from a tokenizer that lower-cases, drops white space and never joins words across it.

    Each distinct word goes through the tokenizer once a worker; texts are then put
    together from the remembered ids. Texts that hold the opening of a special
    token are encoded whole. ``tests/llm`` compares with whole-text encoding.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.openings = tuple({t[:2] for t in special} | {MARK})
        self.mark_id, *more = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        if more:
            raise ValueError("the tokenizer has no single id for the mark between words")
        # Words of Latin letters in lower case need no normalising and are one piece each, whose last id says that it is the last.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(names.values()) + 1, dtype=bool)
        if suffix:
            self.last[[i for name, i in names.items() if name.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.begin = np.zeros(1 << 12, dtype=np.int64)
        self.size = np.zeros(1 << 12, dtype=np.int64)
        self.used = self.known = 0
        self.index[""] = self._keep(np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64))

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Remember runs of ids; the number of the first."""
        first = self.known
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(sizes) > len(self.size):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[first : first + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + len(sizes)] = sizes
        self.used += len(ids)
        self.known += len(sizes)
        return first

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            letters = [w for w in some if LETTERS.fullmatch(w)]
            ids = np.array(self.plain.encode_batch_fast([" ".join(letters).lower()], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.last[ids])
            if len(ends) == len(letters):
                self._index(letters, ids, np.diff(ends, prepend=-1))
                some = [w for w in some if w not in self.index]
            if some:
                ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
                cut = np.flatnonzero(ids == self.mark_id)
                self._index(some, ids[ids != self.mark_id], np.diff(np.r_[-1, cut, len(ids)]) - 1)

    def _index(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = self._keep(ids, sizes)
        self.index.update(zip(words, range(first, first + len(words))))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has, its end id included."""
        if len(self.index) > WORDS_KEPT or self.used > IDS_KEPT:
            self.clear()
        texts = texts.cast(pa.string())
        whole = functools.reduce(pc.or_, [pc.match_substring(texts, o) for o in self.openings])
        if pc.any(whole).as_py():
            names = [None] * len(texts)
            for n in pc.indices_nonzero(whole).to_pylist():
                ids = np.array(self.tokenizer.encode(texts[n].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
                names[n] = MARK + str(n)
                self.index[names[n]] = self._keep(ids, np.array([len(ids)]))
            texts = pc.coalesce(pa.array(names, pa.string()), texts)
        words = pc.split_pattern(functools.reduce(lambda x, blank: pc.replace_substring(x, blank, " "), BLANKS, pc.ascii_lower(texts)), " ")
        ends = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        stems = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # A stop or comma between a letter and white space is a piece of its own already.
        stopped = [n for n, w in enumerate(stems) if w[-1:] in STOPS and w[-2:-1] in SMALL]
        stops = [stems[n][-1] for n in stopped]
        for n in stopped:
            stems[n] = stems[n][:-1]
        found = list(map(self.index.get, stems))
        new = [n for n, k in enumerate(found) if k is None]
        self._learn(list(dict.fromkeys([stems[n] for n in new] + [w for w in STOPS if w not in self.index])))
        for n in new:
            found[n] = self.index[stems[n]]
        parts = np.full((len(stems), 2), self.index[""], dtype=np.int64)
        parts[:, 0] = found
        parts[stopped, 1] = [self.index[w] for w in stops]
        at = parts[coded.indices.to_numpy()].reshape(-1)
        per_part = self.size[at]
        total = np.cumsum(per_part)
        ids = self.flat[np.repeat(self.begin[at] - (total - per_part), per_part) + np.arange(total[-1] if len(total) else 0)]
        ends = np.r_[0, total][2 * ends]
        out = np.full(len(ids) + len(ends), end_id, dtype=np.uint32)
        own = np.ones(len(out), dtype=bool)
        own[ends + np.arange(len(ends))] = False
        out[own] = ids
        return out, np.diff(ends, prepend=0) + 1


@functools.lru_cache(maxsize=1)
def _encoder(tokenizer_file: str) -> WordEncoder:
    """The encoder of a worker process: the words that a task learned serve the worker's next tasks, ``WORDS_KEPT`` at most."""
    return WordEncoder(tokenizer_file)


def _encoded(docs: DataFrame, tokenizer_file: str, end_id: int, bounds: list[int]) -> DataFrame:
    cuts = np.array(bounds, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(at, TEXTS_AT_ONCE)
                ids, counts = encoder.encode(batch.column("body"), end_id)
                doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                columns = [pa.array(np.searchsorted(cuts, doc_ids, "right"), pa.int64()), pa.array(doc_ids, pa.int64()), runs(ids.astype("<u4"), 4 * counts)]
                yield pa.RecordBatch.from_arrays(columns, names=["file_no", "doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("body")).filter("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "file_no long, doc_id long, ids binary")


def _counts(tokens: DataFrame) -> DataFrame:
    """How often each id occurs, summed inside tasks first: at most one row per id and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            ids, _ = from_runs(batch.column("ids"))
            if len(ids):
                if (most := int(ids.max())) >= len(total):
                    total = np.concatenate([total, np.zeros(most + 1 - len(total), dtype=np.int64)])
                total[: most + 1] += np.bincount(ids, minlength=most + 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _put(folder: str, name: str, parts: Iterator[bytes]) -> None:
    """A file of the shared folder, whole or not at all: a task that runs again replaces it."""
    fs, root = pa.fs.FileSystem.from_uri(folder)
    own = f"{root}/_{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
    fs.move(own, f"{root}/{name}")


def write_tokens(docs: DataFrame, tokenizer_file: str, end_id: int = 2, docs_a_file: int = DOCS_A_FILE) -> tuple[str, DataFrame, np.ndarray]:
    """Encode ``docs`` (doc_id, text), write the files, and give folder, manifest and the ids by rank.

    * Null text is empty: such a document has the end id only. Rows with a null doc_id are left out,
      since a place in doc_id order is asked for; repeated doc_ids stay, one after another, ordered by their ids' bytes.
    * Files hold ranges of doc_id; their bounds come from quantiles of doc_id, so a file's size doesn't depend on the corpus.
      File numbers ascend with doc_id.
    * The table of ranks has an entry per id of the vocabulary, which bounds what goes to the driver and to the tasks.
    * An empty table makes no file.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long"))
    n = ids.count()
    shares = max(1, -(-n // docs_a_file))
    bounds = ids.stat.approxQuantile("doc_id", [k / shares for k in range(1, shares)], 0.2 / shares) if shares > 1 else []
    tokens = written(_encoded(docs, tokenizer_file, end_id, sorted({int(b) for b in bounds})), "tokens", compression="zstd")
    by_rank = np.array([r["id"] for r in sorted(_counts(tokens).collect(), key=lambda r: (-r["n"], r["id"]))], dtype=np.int64)
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, dtype=np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    folder = new_path(spark, "token-files")
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)
    ranks = spark.sparkContext.broadcast(rank_of)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, counts = from_runs(batch.column("ids"))
            columns = [batch.column("file_no"), batch.column("doc_id"), pa.array(counts, pa.int64()), *encode_runs(ranks.value[ids], counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["file_no", "doc_id", "n", "control", "data"])

    def put(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "n", "control", "data"], kind="stable")
        counts = rows["n"].to_numpy()
        name = f"{int(key[0]):012d}.tok"
        _put(folder, name, write_blocks(rows["doc_id"].to_numpy(), counts, list(zip(rows["control"], rows["data"]))))
        return pd.DataFrame({"file_no": [int(key[0])], "name": [name], "n_docs": [len(rows)], "n_tokens": [int(counts.sum())]})

    # Ids are coded before the shuffle: about a third of the bytes move.
    coded = tokens.mapInArrow(ranked, "file_no long, doc_id long, n long, control binary, data binary")
    manifest = written(coded.groupBy("file_no").applyInPandas(put, "file_no long, name string, n_docs long, n_tokens long"), "token-manifest")
    forget(tokens)
    return folder, manifest, by_rank


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids (uint32, little-endian).

    The manifest has a row per file, so the running sum over it in one task stays small: a file holds thousands of documents.
    """
    import zlib

    table = spark.sparkContext.broadcast(by_rank.astype("<u4"))
    starts = {r["name"]: r for r in manifest.collect()}
    at, base = 0, {}
    for name in sorted(starts):
        base[name] = at
        at += starts[name]["n_tokens"]
    if not starts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    bases = spark.sparkContext.broadcast(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                at = bases.value[path.rpartition("/")[2]]
                for ids, counts, numbers in read_blocks(content.as_py()):
                    tokens = table.value[numbers]
                    ends = np.cumsum(counts, dtype=np.int64)
                    crcs = [zlib.crc32(tokens[e - c : e]) for c, e in zip(counts.astype(np.int64), ends)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(at + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                    )
                    at += int(ends[-1])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("path", "content")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
