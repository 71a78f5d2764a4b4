"""Word and window hashes with numpy, and bitmaps of fixed size that tasks may hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bitmaps follow the number of rows up to so many bits, 128 MB. Beyond that they filter less; results stay the same.
MOST_BITS = 30


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of uint64 that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; of the whole sequence if it has fewer words, none if it has none."""
    if not len(h):
        return h
    n = min(k, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mix(out * ODD + h[i : len(h) - n + 1 + i] + np.uint64(i + 1))
    return mix(out + np.uint64(n)) if n < k else out


def ngrams_of(h: np.ndarray, sizes: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """``ngrams`` of each of several sequences that stand one after another in ``h``, hashed in one go."""
    ends = np.cumsum(sizes)
    whole = ngrams(h, k) if len(h) >= k else h[:0]
    for end, n in zip(ends.tolist(), np.asarray(sizes).tolist()):
        yield whole[end - n : end - k + 1] if n >= k else ngrams(h[end - n : end], k)


class Rolling:
    """Hashes of any runs of words in an array, by prefix sums of word hash times a power."""

    BASE = 0xD6E8FEB86659FD93
    powers = back = np.ones(1, dtype=np.uint64)

    def __init__(self, h: np.ndarray, twist: int = 0):
        self._sum(mix(h + np.uint64(twist)))

    @classmethod
    def of(cls, values: np.ndarray) -> Rolling:
        """Of values that are random numbers already."""
        own = cls.__new__(cls)
        own._sum(values)
        return own

    def _sum(self, values: np.ndarray) -> None:
        n = len(values)
        if len(Rolling.powers) <= n:
            for name, base in (("powers", Rolling.BASE), ("back", pow(Rolling.BASE, -1, 1 << 64))):
                steps = np.full(2 * n + 2, np.uint64(base))
                steps[0] = 1
                setattr(Rolling, name, np.multiply.accumulate(steps))
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * Rolling.powers[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * Rolling.back[start] + np.atleast_1d(length).astype(np.uint64) * ODD)

    def all(self, length: int) -> np.ndarray:
        """Of the runs of ``length`` words at every place."""
        n = max(0, len(self.sums) - length)
        return mix((self.sums[length:] - self.sums[:n]) * Rolling.back[:n] + np.uint64((length * int(ODD)) & (2**64 - 1)))


#: ASCII white space, and a random number for each byte.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
OF_BYTE = mix(np.arange(1, 257).astype(np.uint64) * ODD)
#: Bytes of a word beyond which it is hashed by itself: sums modulo 2**64 are weak for long strings.
LONG_WORD = 64


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of anything but ASCII white space) of all texts in a row, and how many words each text has.

    A word's hash depends on its bytes only: a sum of random numbers of its bytes times powers, from prefix sums.
    """
    raw = b" ".join(texts) + b" "
    at = np.frombuffer(raw, dtype=np.uint8)
    blank = BLANK[at]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    start, end = edge[::2], edge[1::2]
    length = end - start
    out = Rolling.of(OF_BYTE[at])(start, length) if len(start) else np.zeros(0, dtype=np.uint64)
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return out, np.diff(np.searchsorted(start, ends), prepend=0)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def bitmap_bits(rows: int) -> int:
    """The logarithm of a bitmap's size for so many hashes: sixteen bits for each, MOST_BITS at most."""
    return min(MOST_BITS, max(15, (16 * rows).bit_length()))


def bitmap(df: DataFrame, h: Column) -> np.ndarray:
    """The bits that ``h``, bigints that hold a uint64's bits, set: rows of 4 KB come to the driver, 2 bytes for each hash and at most 2**MOST_BITS bits in all."""
    bits = bitmap_bits(df.count())
    at = F.shiftrightunsigned(h, 64 - bits) + 1
    rows = df.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for b, part in zip(rows.column("b").to_pylist(), rows.column("bits")):
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(part.as_buffer(), dtype=np.uint8)
    return out


def has_bit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def maybe(rows: DataFrame) -> Callable:
    """Whether a row key may be among those of ``rows``, by a bitmap."""
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(rows.select("row_key"), F.col("row_key")))

    @F.pandas_udf("boolean")
    def known(h: pd.Series) -> pd.Series:
        return pd.Series(has_bit(bits.value, h.to_numpy().view(np.uint64)))

    return known


def maybe_among(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without those that surely have no row in ``rows``, so that their words are not hashed again."""
    return docs.filter(maybe(rows)(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))))
