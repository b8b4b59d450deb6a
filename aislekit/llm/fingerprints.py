"""Document fingerprints: threshold-scaled sketches of word shingles.

A fingerprint keeps every shingle hash below a fixed fraction of the hash range, so fingerprints of
documents of very unequal length sample the same shingles, merge by union, and estimate containment.
A text with fewer than KEEP hashes below the fraction keeps its KEEP smallest ones; its threshold is
then the last of them, or the whole range if it has no more. Two fingerprints are compared below the
smaller of their thresholds.

Shingles have five words; the text counts as if four blanks stood before it, so that a text of few
words has as many shingles as words.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aislekit.llm.base import Words, chunks, combine, distinct, map_arrow

#: The share of all hashes that a fingerprint keeps, and the hashes that it keeps at least.
FRACTION, KEEP = 1 / 8, 64
SHINGLE = 5
#: Hashes have 48 bits.
BITS = 48
#: Rows of one range of documents, and ranges at most, or nearly (their bounds are sent to every task).
RANGE_ROWS, RANGES = 1024, 16384


def _shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    hashes = words.hashes()
    rows, out = [], []
    n = len(hashes)
    if n >= SHINGLE:
        whole = words.row[:n - SHINGLE + 1] == words.row[SHINGLE - 1:]
        out.append(combine([hashes[j:n - SHINGLE + 1 + j] for j in range(SHINGLE)])[whole])
        rows.append(words.row[:n - SHINGLE + 1][whole])
    for size in range(1, SHINGLE):
        have = np.flatnonzero(words.count >= size)
        at = words.first[have]
        out.append(combine([hashes[at + j] for j in range(size)] + [np.full(len(have), size, np.uint64)]))
        rows.append(have)
    return np.concatenate(rows), np.concatenate(out) >> np.uint64(64 - BITS)


class Sketches:
    """The fingerprints of some texts: `hash` of each row, sorted, from `begin`; `threshold` per row."""

    def __init__(self, texts: pa.Array, fraction: float = FRACTION, keep: int = KEEP):
        parts = []
        for a, b in chunks(texts):
            rows, hashes = distinct(*_shingles(Words(texts[a:b])))
            parts.append((rows + a, hashes))
        rows = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        hashes = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint64)
        size = np.bincount(rows, minlength=len(texts))
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
        limit = np.uint64(int(fraction * (1 << BITS)))
        below = np.bincount(rows[hashes < limit], minlength=len(texts))
        self.threshold = np.full(len(texts), limit)
        self.threshold[(below < keep) & (size <= keep)] = np.uint64(1 << BITS)
        last = (nth == keep - 1) & (below < keep)[rows] & (size > keep)[rows]
        self.threshold[rows[last]] = hashes[last] + np.uint64(1)
        kept = hashes < self.threshold[rows]
        self.row, self.hash = rows[kept], hashes[kept]
        self.size = np.bincount(self.row, minlength=len(texts))
        self.begin = np.concatenate([[0], np.cumsum(self.size)])

    def text(self) -> list[str]:
        """Threshold in hexadecimal, then the hashes, six bytes each, in base 64."""
        packed = self.hash.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
        return [f"{int(t):x}:" + base64.b64encode(packed[6 * a:6 * b]).decode() for t, a, b in zip(self.threshold, self.begin, self.begin[1:])]


def parse(fingerprint: str) -> tuple[int, np.ndarray]:
    """(threshold, hashes) of a fingerprint."""
    threshold, _, packed = fingerprint.partition(":")
    raw = np.frombuffer(base64.b64decode(packed), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 2:] = raw
    return int(threshold, 16), out.view(">u8").ravel().astype(np.uint64)


def merge(a: str, b: str) -> str:
    """The fingerprint of both texts' shingles together."""
    (t, x), (u, y) = parse(a), parse(b)
    least = min(t, u)
    both = np.union1d(x, y)
    packed = both[both < least].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
    return f"{least:x}:" + base64.b64encode(packed).decode()


def containment(a: str, b: str) -> float:
    """The estimated share of a's shingles that b has too; of no shingles, 1 if b has none either."""
    (t, x), (u, y) = parse(a), parse(b)
    least = min(t, u)
    x, y = x[x < least], y[y < least]
    return float(np.isin(x, y).mean()) if len(x) else float(not len(y) and t == u)


def _overlap(a: Sketches, rows_a: np.ndarray, b: Sketches, rows_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(containment of the smaller, Jaccard) of row pairs."""
    n = len(rows_a)
    least = np.minimum(a.threshold[rows_a], b.threshold[rows_b])

    def picked(s: Sketches, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = s.size[rows]
        pair = np.repeat(np.arange(n), size)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + s.begin[rows][pair]
        hashes = s.hash[at]
        ok = hashes < least[pair]
        return pair[ok], hashes[ok]

    pa_, ha = picked(a, rows_a)
    pb, hb = picked(b, rows_b)
    pairs, hashes = np.concatenate([pa_, pb]), np.concatenate([ha, hb])
    order = np.lexsort((hashes, pairs))
    pairs, hashes = pairs[order], hashes[order]
    twice = (pairs[1:] == pairs[:-1]) & (hashes[1:] == hashes[:-1])
    common = np.bincount(pairs[1:][twice], minlength=n)
    x, y = np.bincount(pa_, minlength=n), np.bincount(pb, minlength=n)
    none = (a.size[rows_a] == 0) & (b.size[rows_b] == 0)
    contained = np.where(none, 1.0, common / np.maximum(np.minimum(x, y), 1))
    return contained, np.where(none, 1.0, common / np.maximum(x + y - common, 1))


class Ranges:
    """Ranges of about equal rows of the order by key, descending, nulls last, then by text hash.

    Keys are cut at percentiles. A key that fills several ranges is cut by its text hash as well, and rows of one
    key and text hash that fill several ranges, which are equal, are dealt to them by `salt`. `rows` has k and h.
    """

    def __init__(self, rows: DataFrame):
        total, known = rows.agg(F.count("*"), F.count("k")).first()
        wanted = min(RANGES, total // RANGE_ROWS)
        step = max(RANGE_ROWS, total // max(wanted, 1))
        bounds, slices = [], {}
        if known >= 2 * step:
            parts = known // step
            ends = rows.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
            slices = {k: n + 1 for k, n in Counter(ends).items() if n > 1}
            least = -(1 << 63)
            bounds = sorted({*ends, *(k - 1 for k in slices if k > least)})
        if total - known >= 2 * step:
            slices[None] = (total - known) // step
        self.bounds = np.array(bounds, np.int64)
        # hashes that begin a cell, by number of the key range; 0 is that of the nulls
        numbers = {0 if k is None else 1 + bounds.index(k): k for k in slices}
        grid = {at: [(1 << 64) * i // slices[k] - (1 << 63) for i in range(slices[k])] for at, k in numbers.items()}
        copies: dict[tuple[int, int], int] = {}
        if slices:
            hot = F.col("k").isin([k for k in slices if k is not None])
            hot = hot | F.col("k").isNull() if None in slices else hot
            heavy = rows.where(hot).groupBy("k", "h").count().where(F.col("count") >= 2 * step)  # total / (2 * step) rows at most
            for r in heavy.collect():
                at = 0 if r["k"] is None else 1 + bounds.index(r["k"])
                copies[at, r["h"]] = r["count"]
                grid[at] += [r["h"], *([r["h"] + 1] if r["h"] + 1 < 1 << 63 else [])]
        self.grid = {at: np.array(sorted(set(starts)), np.int64) for at, starts in grid.items()}
        # cells in document order: key ranges from the last to the first, the hashes of each from the least
        self.cell = np.zeros(len(bounds) + 2, np.int64)
        width, self.every = [], []
        for at in reversed(range(len(bounds) + 2)):
            self.cell[at] = len(width)
            for start in self.grid[at].tolist() if at in self.grid else [None]:
                n = copies.get((at, start), 0)
                width.append(max(1, n // step))
                self.every.append(max(1, n // 64))
        self.width, self.every = np.array(width), np.array(self.every)
        self.range = np.cumsum(self.width) - self.width

    def cells(self, k: np.ndarray, known: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = np.where(known, 1 + np.searchsorted(self.bounds, k), 0)
        out = self.cell[at]
        for hot in np.intersect1d(at, list(self.grid)).tolist():
            some = at == hot
            out[some] += np.searchsorted(self.grid[hot], h[some], "right") - 1
        return out


def _placed(rows: DataFrame) -> DataFrame:
    """(k, t, range, after, h): each of `rows` (k, t) in its range, after = 0, and rows like the first one of a range
    in the range before it too, after = 1. The range before the first is the last."""
    rows = rows.withColumn("h", F.xxhash64("t"))
    ranges = Ranges(rows.select("k", "h"))

    # keys as their complement, nulls last: the least is the first document of a cell
    @F.pandas_udf("int")
    def cell(k: pd.Series, null: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(ranges.cells(k.to_numpy(), ~null.to_numpy(bool), h.to_numpy()).astype(np.int32))

    keyed = rows.withColumn("null", F.col("k").isNull()).withColumn("key", F.coalesce("k", F.lit(0)))
    least = keyed.select("null", "key", "h", cell("key", "null", "h").alias("cell")).groupBy("cell").agg(
        F.min(F.struct("null", F.bitwise_not("key").alias("back"), "h")).alias("first"))
    found = {r["cell"]: r["first"] for r in least.collect()}  # a row a cell
    n = len(ranges.width)
    first_key, first_hash, before = (np.zeros(n, np.int64) for _ in range(3))
    filled = sorted(found)
    for i, c in enumerate(filled):
        last = filled[i - 1]
        first_key[c], first_hash[c], before[c] = ~found[c]["back"], found[c]["h"], ranges.range[last] + ranges.width[last] - 1

    @F.pandas_udf("array<bigint>")
    def places(k: pd.Series, null: pd.Series, h: pd.Series, salt: pd.Series) -> pd.Series:
        k, null, h, salt = k.to_numpy(), null.to_numpy(bool), h.to_numpy(), salt.to_numpy() & ((1 << 62) - 1)
        at = ranges.cells(k, ~null, h)
        own = 2 * (ranges.range[at] + salt % ranges.width[at])
        # of many copies about 64 are sent ahead, chosen by other bits than their range
        ahead = (h == first_hash[at]) & (k == first_key[at]) & ((salt >> 20) % ranges.every[at] == 0)
        return pd.Series([[a, 2 * b + 1] if more else [a] for a, b, more in zip(own.tolist(), before[at].tolist(), ahead.tolist())])

    salted = keyed.withColumn("place", F.explode(places("key", "null", "h", F.xxhash64(F.monotonically_increasing_id()))))
    return salted.selectExpr("k", "t", "place div 2 AS range", "place % 2 AS after", "h")


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, jaccard_edited, jaccard_next).

    The next document is the one of the next smaller key, after the last one the first; of equal keys the
    one of the greater text hash. Null keys come last. A null text is empty. near_… is the share of the
    smaller fingerprint's shingles found in the other; two texts without words are alike, one without words
    is unlike others. A single document is its own next. Keys are integers; other columns are not looked at.

    Each document goes, once, to its range; the first document of a range goes to the range before it as well, as the
    next of its last one. Ranges are sorted and read in order. A key, or a row, that fills several ranges is split.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    placed = _placed(rows).repartition("range").sortWithinPartitions("range", "after", F.col("k").desc_nulls_last(), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.table(batch.columns[:4], names=["k", "t", "r", "a"])
            if held is not None:
                table = pa.concat_tables([held, table])
            held = table.slice(table.num_rows - 1)
            yield from _compared(table, table.num_rows - 1)
        if held is not None:
            yield from _compared(held, 1)

    schema = ("k bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, jaccard_edited double, jaccard_next double")
    out = map_arrow(placed.select("k", "t", "range", "after"), run, schema)
    return out.select(F.col("k").cast(kind).alias(key), *out.columns[1:])


def _compared(table: pa.Table, n: int) -> Iterator[pa.RecordBatch]:
    """Result rows of the first n rows, each with the row after it; rows sent after a range give none. Where no row was
    sent after a range, its last row is followed by an equal one, and by itself here."""
    texts = pa.concat_arrays(table.column("t").chunks)
    after, ranges = np.asarray(table.column("a")), np.asarray(table.column("r"))
    rows = np.flatnonzero(after[:n] == 0)
    if len(rows) == 0:
        return
    then = np.minimum(rows + 1, len(ranges) - 1)
    then = np.where(ranges[then] == ranges[rows], then, rows)
    strings = texts.to_pylist()
    edited = []
    for i, j in zip(rows.tolist(), then.tolist()):
        own = strings[i]
        cut = len(own) // 3
        edited.append(own[:len(own) - cut] + strings[j][:cut])
    own, other = Sketches(texts), Sketches(pa.array(edited, pa.string()))
    near = _overlap(own, rows, other, np.arange(len(rows)))
    following = _overlap(own, rows, own, then)
    prints = own.text()
    yield pa.RecordBatch.from_arrays([
        pa.concat_arrays(table.column("k").chunks).take(pa.array(rows)),
        pa.array([len(strings[i]) for i in rows.tolist()], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array([prints[i] for i in rows.tolist()]), pa.array(other.text()),
        pa.array(near[0]), pa.array(following[0]), pa.array(near[1]), pa.array(following[1])],
        names=["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "jaccard_edited", "jaccard_next"])
