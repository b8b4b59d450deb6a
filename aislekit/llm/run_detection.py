"""Periodic runs of words, found by tiles scaled to the period.

Periods are dealt into octaves, S to 2S - 1 words. A document is exploded into the overlapping tiles of each octave:
around every S-th word, the tile's boundary, 2S words before and 4S + 8 after it. A run of an octave is so long
that some boundary c lies in it with c + period + 8 still inside, so the eight words from c and those from
c + period are equal: tiles without such a pair hold nothing. The others are solved one by one: values of the Z-function
from the boundary on, and backwards from it, tell how far the words before and after the boundary repeat
at each distance. A stretch of two periods or more, whose period no divisor replaces, is a fragment.

Fragments are shuffled by document and period and stitched there: fragments that overlap by a period are of one run,
and two runs of a period overlap by less. What is long enough then is a run. Texts of documents without fragments stay
where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from aislekit.llm.base import VALUES, Words, chunks, combine, map_arrow
from aislekit.session import written

#: A run has so many words at least, and so many periods.
LEAST, PERIODS = 24, 3
#: Words that must be equal at a boundary and a period later; also the step of the first octave, of periods below it.
GRAM = 8
#: Up to so many periods of a tile have their Z-values computed one by one; for more, whole Z-functions are cheaper.
_SINGLE = 8


def z_function(x: list) -> list[int]:
    """For every place the length of the longest prefix of x that begins there."""
    n = len(x)
    z = [n] + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[i + k] == x[k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


class Boundary:
    """How far the words of a tile [low, high) repeat at a distance, forwards and backwards from the boundary."""

    def __init__(self, x: np.ndarray, at: int, low: int, high: int, whole: bool):
        self.x, self.at, self.low, self.high = x, at, low, high
        self.ahead = self.behind = None
        if whole:
            tile = x[low:high].tolist()
            split = at - low
            self.ahead = z_function(tile[split:]) + [0]
            before = tile[:split][::-1]
            # None separates: it equals no word
            self.behind = z_function(before + [None] + tile[::-1])[split + 1:][::-1]

    def forward(self, d: int) -> int:
        """Words from the boundary on that are equal to those d later."""
        if self.ahead is not None:
            return self.ahead[d]
        differ = self.x[self.at:self.high - d] != self.x[self.at + d:self.high]
        return int(differ.argmax()) if differ.any() else len(differ)

    def backward(self, d: int) -> int:
        """Words before the boundary that are equal to those d later."""
        if self.behind is not None:
            return self.behind[self.at - self.low + d - 1] if self.at > self.low else 0
        differ = (self.x[self.low:self.at] != self.x[self.low + d:self.at + d])[::-1]
        return int(differ.argmax()) if differ.any() else len(differ)


def _primes(n: int) -> list[int]:
    """The prime divisors of n."""
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def solve_tile(x: np.ndarray, at: int, low: int, high: int, first: int, last: int, periods: list[int]) -> list[tuple[int, int, int]]:
    """(period, start, end) of the fragments around the boundary `at` of the tile [low, high) of a document [first, last)."""
    boundary = Boundary(x, at, low, high, len(periods) > _SINGLE)
    out = []
    for q in periods:
        start, end = at - boundary.backward(q), at + q + boundary.forward(q)
        cut = (start == low > first) or (end == high < last)
        if end - start < (2 * q if cut else max(LEAST, PERIODS * q)):
            continue
        if not any(boundary.forward(d) >= end - d - at and boundary.backward(d) >= at - start for d in (q // p for p in _primes(q))):
            out.append((q, start, end))
    return out


def fragments(x: np.ndarray, row: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, period, start, end) of the fragments of all rows of a chunk; x are its words, row i has those from first[i] to first[i + 1]."""
    n = len(x)
    longest = int(np.diff(first).max(initial=0))
    out = []
    if longest < LEAST:
        return out
    gram = combine([x[j:n - GRAM + 1 + j] for j in range(GRAM)])
    step = GRAM
    octaves = [(GRAM, 1, GRAM)]  # step, periods from, to
    while PERIODS * step <= longest:
        octaves.append((step, step, 2 * step))
        step *= 2
    for step, low_q, high_q in octaves:
        at = np.arange(0, len(gram), step)
        offsets = np.arange(low_q, high_q)
        # boundaries in slices, so that the table of comparisons stays small
        for s in range(0, len(at), max(1, (1 << 20) // len(offsets))):
            some = at[s:s + max(1, (1 << 20) // len(offsets))]
            later = some[:, None] + offsets[None, :]
            inside = later < len(gram)
            later = np.minimum(later, len(gram) - 1)
            i, j = np.nonzero((gram[some][:, None] == gram[later]) & inside & (row[some][:, None] == row[later + GRAM - 1]))
            if len(i) == 0:
                continue
            ends = np.flatnonzero(np.append(np.diff(i), 1)) + 1
            for b, e in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
                c = int(some[i[b]])
                r = int(row[c])
                lo, hi = int(first[r]), int(first[r + 1])
                tile = max(lo, c - 2 * step), min(hi, c + 4 * step + GRAM)
                out += [(r, q, start - lo, end - lo) for q, start, end in solve_tile(x, c, *tile, lo, hi, offsets[j[b:e]].tolist())]
    return out


def repeated_tail(n: int, h: int) -> tuple[int, int]:
    """(a, p): the words of a text of n words from a on repeat with period p, as its key's hash h tells."""
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _tile_table(docs: DataFrame, tails: bool) -> DataFrame:
    """(id, key, fragments, words, digest): of documents (id, key, h, text); a document without fragments has no words
    but their digest."""
    kind = docs.schema["key"].dataType.simpleString()
    schema = f"id bigint, key {kind}, fragments array<struct<period:bigint,start:bigint,end:bigint>>, words binary, digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(2).to_pylist()
            for a, b in chunks(batch.column(3)):
                words = Words(batch.column(3)[a:b])
                x = words.hashes(VALUES)
                place = np.arange(len(x))
                for r in range(b - a):
                    n, h = int(words.count[r]), hashes[a + r]
                    if tails and n and h % 10 == 0:
                        start, p = repeated_tail(n, h)
                        begin = int(words.first[r])
                        place[begin + start:begin + n] = begin + start + np.arange(n - start) % p
                found: list[list] = [[] for _ in range(b - a)]
                for r, q, start, end in fragments(x[place], words.row, words.first):
                    found[r].append({"period": q, "start": start, "end": end})
                texts, digests = [], []
                whole = words.data.tobytes()
                for r in range(b - a):
                    parts = whole[words.offsets[r]:words.offsets[r + 1]].split()  # at the blanks of the words
                    if tails and parts and hashes[a + r] % 10 == 0:
                        begin = int(words.first[r])
                        parts = [parts[i] for i in (place[begin:begin + len(parts)] - begin).tolist()]
                    text = b" ".join(parts)
                    texts.append(text if found[r] else None)
                    digests.append(None if found[r] else hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b],
                     pa.array(found, pa.list_(pa.struct([("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))),
                     pa.array(texts, pa.binary()), pa.array(digests, pa.string())],
                    names=["id", "key", "fragments", "words", "digest"])

    return map_arrow(docs.select("id", "key", "h", "text"), run, schema)


def stitched(pieces: DataFrame) -> DataFrame:
    """(id, period, start, end) of the runs made of fragments (id, period, start, end)."""
    by = Window.partitionBy("id", "period").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("start") > before - F.col("period")).cast("int"), F.lit(1))
    islands = pieces.withColumn("begins", begins).withColumn("island", F.sum("begins").over(by))
    runs = islands.groupBy("id", "period", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.where((F.col("end") - F.col("start")) >= F.greatest(F.lit(LEAST), PERIODS * F.col("period"))).select("id", "period", "start", "end")


def _described(key: str, kind: str):
    schema = (f"{key} {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
              "runs_sha256 string, collapsed_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for text, runs, digest in zip(*(batch.column(c) for c in ("words", "runs", "digest"))):
                runs = sorted((r["start"], r["end"] - r["start"], r["period"]) for r in runs.as_py() or [])
                best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                if digest.as_py() is None:
                    words = text.as_py().split(b" ")
                    kept = np.ones(len(words), bool)
                    for start, length, period in runs:
                        kept[start + period:start + length] = False
                    digest = hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])).hexdigest()
                else:
                    digest = digest.as_py()
                listed = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
                row = [len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), digest]
                for column, value in zip(columns, row):
                    column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.string()] * 2)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *arrays], names=[key, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return run, schema


def _tiled(docs: DataFrame, key: str, text: str, tails: bool) -> DataFrame:
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    h = F.crc32(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary"))
    rows = rows.select(F.monotonically_increasing_id().alias("id"), "key", h.alias("h"), "text")
    return written(_tile_table(rows, tails), "run-tiles")


def _runs(tiles: DataFrame) -> DataFrame:
    return stitched(tiles.select("id", F.explode("fragments").alias("f")).select("id", "f.*"))


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, period) of every run of every text, words numbered from 0."""
    tiles = _tiled(docs, key, text, False)
    return _runs(tiles).join(tiles.select("id", "key"), "id").select(
        F.col("key").alias(key), "start", (F.col("end") - F.col("start")).alias("length"), "period")


def describe_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", tails: bool = False) -> DataFrame:
    """(key, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every row.

    A run is a stretch of max(24, 3 · period) words or more that repeats with its smallest period and that no
    word beside it extends. With `tails` the texts of a tenth of the keys repeat a part of themselves first (see
    `repeated_tail`). Null and empty texts have no words and no runs; a null key counts as empty text where keys
    decide. Repeated rows are rows of their own. Other columns are not looked at. An empty table gives an empty one.
    """
    tiles = _tiled(docs, key, text, tails)
    lists = _runs(tiles).groupBy("id").agg(F.collect_list(F.struct("start", "end", "period")).alias("runs"))
    function, schema = _described(key, docs.schema[key].dataType.simpleString())
    none = F.lit(None).cast("array<struct<start:bigint,end:bigint,period:bigint>>").alias("runs")
    plain = tiles.where("words IS NULL").select("key", "words", none, "digest")
    rest = tiles.where("words IS NOT NULL").join(lists, "id", "left").select("key", "words", "runs", "digest")
    return map_arrow(plain.union(rest), function, schema)
