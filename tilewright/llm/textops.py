"""Array views of text columns: words, code points and hashes for a whole Arrow batch at once.

Tasks receive Arrow record batches (`mapInArrow`). A text column is one byte buffer with
offsets, so words, lines and n-grams of thousands of documents are found by a few numpy
passes, without a Python object per word. Batches are cut into slices of about
`SLICE_BYTES`; only a single text longer than that makes a larger slice, so memory follows
the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.session import ship_package

SLICE_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

SPACE = np.zeros(256, bool)  # bytes that end a word: \x20 and \x09-\x0D
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """A session whose Python workers can import this package."""
    ship_package(spark)
    return spark


def id_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Just the key and the text, null texts as empty ones; other columns can't clash."""
    return docs.select(F.col(key).cast("bigint").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def as_int64(column) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).to_numpy(zero_copy_only=False), np.int64)


def byte_slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each slice of a string column."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit number."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if kind not in _powers or len(_powers[kind]) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


class SpanHash:
    """64-bit hash of any byte span, by prefix sums of a polynomial (computed once per slice)."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", BASE, n), out=self.prefix[1:])
        self.down = _power("down", BASE_INVERSE, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.down[starts])


@dataclass
class Words:
    """Words of the texts of a slice: byte spans in order, and the first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # len(texts) + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are not in `outside`, never across two texts."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~outside[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    starts[borders] = inside[borders + 1]
    ends[borders - 1] = inside[borders]
    at = np.flatnonzero(starts)
    return Words(at, np.flatnonzero(ends) + 1, np.searchsorted(at, offsets))


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each UTF-8 character."""
    return (data & 0xC0) != 0x80


def sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of `flags` between consecutive bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows, and the word at which each begins; none crosses a text."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rolled = np.zeros(size, np.uint64)
    for k in range(n):
        rolled = rolled * BASE + hashes[k : k + size]
    left = np.repeat(first[1:], np.diff(first))[:size] - np.arange(size)
    at = np.flatnonzero(left >= n)
    return mix(rolled[at] + np.uint64(n)), at


def ranked(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: how many equal (group, key) there are, and whether it is the first of them."""
    own = mix(keys + group.astype(np.uint64) * BASE)
    count, first = np.ones(len(own), np.int64), np.ones(len(own), bool)
    values = np.sort(own)
    twice = values[1:][values[1:] == values[:-1]]
    if len(twice):  # only items that may be equal to another one are put in order
        maybe = np.zeros(1 << 20, bool)
        maybe[twice >> np.uint64(44)] = True
        at = np.flatnonzero(maybe[own >> np.uint64(44)])
        at = at[np.argsort(own[at], kind="stable")]
        new = np.ones(len(at), bool)
        new[1:] = own[at][1:] != own[at][:-1]
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        count[at] = np.repeat(size, size)
        first[at] = new
    return count, first


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """True for each of `size` words that lies in a window of n words beginning at one of `at`."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, at, 1)
    np.subtract.at(edge, at + n, 1)
    return np.cumsum(edge)[:size] > 0
