"""What the operators share: reading tables, Arrow batches of bounded size, word and shingle hashes.

Words are hashed over the bytes of a whole batch at once; all hashes are 64-bit and depend on the
bytes of the word alone, never on the batch, the partition or the machine.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of one Arrow batch; a batch of average texts is a few megabytes.
BATCH_ROWS = 1024
#: Bytes of text that a numpy pass takes at once.
CHUNK_BYTES = 1 << 20

_MASK = (1 << 64) - 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, since texts may be long. Set for the session, where it is wider."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Give freed memory back to the system: Python workers are kept for later stages, and with them what they once needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    arrow_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)


def remainder(key: str | Column, by: int) -> Column:
    """crc32 of the key as text, modulo `by`; null keys count as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % by


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes of text, or of one row."""
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)), dtype=np.int64)
    start, done = 0, 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield start, stop
        start, done = stop, int(ends[stop - 1])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows one after the other, and each row's start (one more at the end); null: empty."""
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)


_BASE = 0x5851F42D4C957F2D
#: Bytes that are weighted at once when words are hashed.
_TILE = 1 << 15


def _powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.empty(n, np.uint64)
    p = 1
    for i in range(n):
        out[i] = p
        p = p * base & _MASK
    return out


_POWERS = _powers(256)
_UP, _DOWN = _powers(_TILE), _powers(_TILE, pow(_BASE, -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 0x20 and 0x09 to 0x0D separate words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
#: All ASCII but letters and digits separates words.
NO_LETTER = np.ones(256, bool)
NO_LETTER[48:58] = NO_LETTER[65:91] = NO_LETTER[97:123] = NO_LETTER[128:] = False

VALUES = _byte_values()
LOWER_VALUES = VALUES[LOWER]


class Words:
    """The words of a chunk of rows: `start` and `end` in `data`, their `row`, and per row the `first` word (one more at the end)."""

    def __init__(self, column: pa.Array, blank: np.ndarray = BLANK):
        self.data, self.offsets = text_bytes(column)
        n = len(self.data)
        gap = np.ones(n + 1, bool)
        gap[:n] = blank[self.data]
        here = ~gap[:n]
        begins = here.copy()
        begins[1:] &= gap[:n - 1]
        ends = np.zeros(n + 1, bool)
        ends[1:] = here & gap[1:]
        # a row's first byte begins a word, and the row before ends one, whatever its last byte is
        edge = self.offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        begins[edge] = here[edge]
        ends[edge] = here[edge - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, values: np.ndarray = LOWER_VALUES) -> np.ndarray:
        """A hash of each word, by default of its lower-case form (A-Z alone)."""
        if len(self.start) == 0:
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        if length.max() <= len(_POWERS):
            return mix(self._sums(values) + length.astype(np.uint64) * _GOLD)
        within = np.arange(len(self.data)) - np.repeat(
            np.concatenate([[0], self.start]), np.diff(np.concatenate([[0], self.start, [len(self.data)]])))
        # a very long word: its powers repeat, plus its block's number
        high = (within // len(_POWERS)).astype(np.uint64)
        weight = _POWERS[within % len(_POWERS)] * (high * _GOLD * np.uint64(2) + np.uint64(1))
        terms = values[self.data] * weight
        bounds = np.empty(2 * len(self.start), np.int64)
        bounds[0::2], bounds[1::2] = self.start, self.end
        if bounds[-1] == len(terms):
            terms = np.append(terms, np.uint64(0))
        return mix(np.add.reduceat(terms, bounds)[0::2] + length.astype(np.uint64) * _GOLD)

    def _sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of each word's byte values, each times the power of its place in the word: running sums with the powers
        of places in the data, whose differences are divided by the power of the word's start (modulo 2^64, so exactly)."""
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        for t, at in enumerate(range(0, n, _TILE)):
            part = total[at + 1:at + 1 + _TILE]
            np.multiply(values[self.data[at:at + _TILE]], _UP[:len(part)], out=part)
            part *= np.uint64(pow(_BASE, t * _TILE, 1 << 64))
        np.cumsum(total, out=total)
        tiles = _powers(n // _TILE + 1, pow(_BASE, -_TILE, 1 << 64))
        return (total[self.end] - total[self.start]) * _DOWN[self.start % _TILE] * tiles[self.start // _TILE]


def combine(hashes: Iterable[np.ndarray]) -> np.ndarray:
    """One hash of several, in order."""
    out = None
    for h in hashes:
        out = mix(h + _GOLD) if out is None else mix(out * _M1 + h)
    return out


def shingles(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of k words; a row of fewer words, but one at least, gives all its words as one shingle."""
    n = len(hashes)
    rows, out = [], []
    if n >= k:
        run = combine([hashes[j:n - k + 1 + j] for j in range(k)])
        whole = words.row[:n - k + 1] == words.row[k - 1:]
        rows.append(words.row[:n - k + 1][whole])
        out.append(run[whole])
    for size in range(1, k):  # short rows, together by their number of words
        short = np.flatnonzero(words.count == size)
        if len(short):
            at = words.first[short]
            rows.append(short)
            out.append(combine([hashes[at + j] for j in range(size)] + [np.full(len(short), size, np.uint64)]))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(out)


def distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash), sorted by row and hash."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[keep], hashes[keep]


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as a Spark long."""
    return pa.array(x.view(np.int64))


def uniform(*keys: Column | str | int) -> Column:
    """A number in [0, 1) that the keys alone decide (53 bits of a hash)."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in keys]
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))
