"""Sampled SentencePiece segmentations: forward filtering, backward sampling over the piece lattice.

The weight of a segmentation is the product of its pieces' weights, and a piece's weight falls with
its rank in the vocabulary, 1 / (rank + 2.7), raised to `sharpness`. A forward pass sums the weights
of all ways to reach each character; a backward pass draws the last piece, then the one before it, in
proportion. Draws are hashes of (seed, row key, place in the text, step), so a row's segmentation does
not depend on batches, partitions or retries.

No piece of the vocabulary holds a blank after another character, so the lattice falls apart into
independent segments at the starts of runs of blanks (and, in long ones, between characters that no
piece has side by side). Each distinct segment of a chunk of rows is filtered once; all its places
draw from it at once. Characters without a piece become their UTF-8 bytes' pieces, as does a literal
blank mark, so that decoding gives every text back unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aislekit.llm.base import chunks, map_arrow, mix, text_bytes
from aislekit.llm.token_counts import MARK, processor, splits_at_blanks

SEED = 42
#: Segments of more characters are filtered one by one.
LONG = 24
#: Bytes of text that a numpy pass takes at once; its arrays are some 90 times as large, in every Python worker of an executor.
CHUNK = 1 << 20
_LITERAL = 0x110000  # stands for a literal blank mark
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1B54A32D192ED03)


def _unit(x: np.ndarray) -> np.ndarray:
    return (mix(x) >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))


class Lattice:
    """The vocabulary as lookup tables."""

    def __init__(self, model: str, sharpness: float = 1.0):
        sp = processor(model)
        size = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        if not splits_at_blanks(pieces):
            raise ValueError("a piece with a blank after another character: the lattice does not split at blanks")
        self.byte_id = np.zeros(256, np.int32)
        normal = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append(i)
        first = min(normal)
        total = sum(1 / (i - first + 2.7) for i in normal)
        self.weight = np.zeros(size + 1)  # the last, also found by -1, is that of no piece
        for i in normal:
            self.weight[i] = (1 / (i - first + 2.7) / total) ** sharpness
        self.missing = float(self.weight[normal].min()) / 10  # of a character without a piece
        self.ids = {pieces[i]: i for i in normal}
        self.longest = max(len(pieces[i]) for i in normal)
        self.pairs = frozenset(p[j:j + 2] for p in self.ids for j in range(len(p) - 1))
        self.powers = np.array([pow(0x5851F42D4C957F2D, j, 1 << 64) for j in range(self.longest + 1)], np.uint64)
        keys = np.array([self._hash(p) for p in self.ids], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(list(self.ids.values()), np.int32)[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces share a hash")
        slot = (self.keys >> np.uint64(44)).astype(np.int64)
        self.slot = np.searchsorted(slot, np.arange((1 << 20) + 1)).astype(np.int32)
        self.filled = np.diff(self.slot) > 0
        self.deepest = int(np.diff(self.slot).max())
        # bytes of each piece, blanks as blanks
        texts = self._texts(sp, pieces)
        self.text_start = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.text_bytes = np.frombuffer(b"".join(texts), np.uint8)

    @staticmethod
    def _texts(sp, pieces: list[str]) -> list[bytes]:
        out = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                out.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                out.append(b"")
            else:
                out.append(p.replace(MARK, " ").encode())
        return out

    def _hash(self, piece: str) -> int:
        points = np.array([ord(c) for c in piece], np.uint64)
        return int(mix((mix((points + np.uint64(1)) * _GOLD) * self.powers[:len(piece)]).sum(keepdims=True))[0])

    def find(self, sums: np.ndarray) -> np.ndarray:
        """Ids of the substrings with these hash sums; -1: no piece."""
        keys = mix(sums).ravel()
        out = np.full(keys.shape, -1, np.int32)
        slot = (keys >> np.uint64(44)).astype(np.int64)
        left = np.flatnonzero(self.filled[slot])
        at = self.slot[slot[left]]
        for _ in range(self.deepest):
            same = self.keys[at] == keys[left]
            out[left[same]] = self.key_ids[at[same]]
            left, at = left[~same], at[~same] + 1
            more = at < self.slot[slot[left] + 1]
            left, at = left[more], at[more]
        return out.reshape(sums.shape)

    # ---- encoding ---------------------------------------------------------------------

    def encode(self, texts: list[str], keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each text's start and the end)."""
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        joined = "".join(" " + t for t in texts if t)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if len(points) == 0:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        points[points == 0x2581] = _LITERAL
        points[points == 0x20] = 0x2581
        edges = np.concatenate([[0], np.cumsum(sizes)])
        blank = points == 0x2581
        begin = blank.copy()
        begin[1:] &= ~blank[:-1]
        begin[edges[:-1][sizes > 0]] = True
        start = np.flatnonzero(begin)
        length = np.diff(np.append(start, len(points)))
        if (length > LONG).any():
            start = self._cut(points, start, length)
            length = np.diff(np.append(start, len(points)))
        row = np.searchsorted(edges, start, "right") - 1
        within = np.arange(len(start)) - np.searchsorted(start, edges)[row]
        draw = mix(keys.view(np.uint64)[row] + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) + within.astype(np.uint64) * _STEP
        values = mix((points.astype(np.uint64) + np.uint64(1)) * _GOLD)
        by_length = np.argsort(np.minimum(length, LONG + 1), kind="stable")
        bounds = np.searchsorted(length[by_length], np.arange(1, LONG + 2))
        parts = [self._short(points, values, start, n + 1, draw, by_length[a:b]) for n, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
        parts += [self._alone(points[start[i]:start[i] + length[i]], i, draw[i]) for i in np.flatnonzero(length > LONG)]
        place = np.concatenate([p[0] for p in parts])
        step = np.concatenate([p[1] for p in parts])
        ids = np.concatenate([p[2] for p in parts])
        count = np.bincount(place, minlength=len(start))
        base = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(len(ids), np.int64)
        out[base[place] + count[place] - 1 - step] = ids
        ends = base[np.searchsorted(start, edges)]
        if (out < 0).any():
            out, ends = self._bytes(out, ends)
        return out.astype(np.int32), ends

    def _cut(self, points: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """More starts in long segments: between characters that no piece has side by side."""
        more = []
        for s, n in zip(start[length > LONG], length[length > LONG]):
            text = [chr(c) if c < _LITERAL else "" for c in points[s:s + n].tolist()]
            more += [s + j for j in range(1, n) if text[j - 1] + text[j] not in self.pairs or not text[j] or not text[j - 1]]
        return np.sort(np.concatenate([start, np.array(more, np.int64)]))

    def _short(self, points, values, start, wide: int, draw, which) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of the segments `which`, all of `wide` characters: their place, step from the end, id."""
        most = min(self.longest, wide)
        values = values[start[which][:, None] + np.arange(wide)]
        whole = mix((values * mix(np.arange(1, wide + 1, dtype=np.uint64) * _GOLD | np.uint64(1))).sum(1))
        _, example, number = np.unique(whole, return_index=True, return_inverse=True)
        values = values[example]
        n = len(example)
        ids = np.full((n, wide + 1, most), -1, np.int32)  # [segment, end, length - 1]
        sums = np.zeros((n, wide), np.uint64)
        for l in range(1, most + 1):
            sums = sums[:, :wide - l + 1] + values[:, l - 1:] * self.powers[l - 1]
            ids[:, l:, l - 1] = self.find(sums)
        bare = ids[:, 1:, 0] < 0
        if bare.any():
            codes = points[start[which[example]][:, None] + np.arange(wide)]
            ids[:, 1:, 0][bare] = -1 - codes[bare]
        reach = np.zeros((n, wide + 1))
        reach[:, 0] = 1
        share = np.full((n, wide + 1, most), 2, np.float32)
        for e in range(1, wide + 1):
            m = min(e, most)
            here = ids[:, e, :m]
            ways = self.weight[np.maximum(here, -1)]
            if bare[:, e - 1].any():
                ways[bare[:, e - 1], 0] = self.missing
            ways *= reach[:, e - m:e][:, ::-1]
            np.cumsum(ways, 1, out=ways)
            reach[:, e] = ways[:, -1]
            share[:, e, :m] = ways / np.where(ways[:, -1:] > 0, ways[:, -1:], 1)
        # the last share is 1, and a draw is below it
        active, at, draw = np.arange(len(which)), np.full(len(which), wide), draw[which]
        out, step = [], 0
        while len(active):
            u = _unit(draw[active] + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).astype(np.float32)
            rows, end = number[active], at[active]
            pick = (share[rows, end] <= np.minimum(u, np.float32(1 - 2 ** -24))[:, None]).sum(1)
            out.append((which[active], np.full(len(active), step), ids[rows, end, pick].astype(np.int64)))
            at[active] = end - pick - 1
            active, step = active[end - pick - 1 > 0], step + 1
        return tuple(np.concatenate(x) for x in zip(*out))

    def _alone(self, points: np.ndarray, place: int, draw: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for one long segment, in logarithms."""
        codes = points.tolist()
        text = "".join(chr(c) if c < _LITERAL else "\x00" for c in codes)
        known = [c < _LITERAL for c in codes]
        reach = [0.0] + [-math.inf] * len(codes)
        ways: list[list[tuple[float, int, int]]] = [[]]
        for e in range(1, len(codes) + 1):
            here = []
            for l in range(1, min(e, self.longest) + 1):
                i = self.ids.get(text[e - l:e]) if known[e - l] else None
                if i is not None and all(known[e - l:e]):
                    here.append((reach[e - l] + math.log(self.weight[i]), l, i))
                elif l == 1:
                    here.append((reach[e - 1] + math.log(self.missing), 1, -1 - codes[e - 1]))
            top = max(w for w, _, _ in here)
            reach[e] = top + math.log(sum(math.exp(w - top) for w, _, _ in here))
            ways.append(here)
        ids, at = [], len(codes)
        draws = _unit(draw + np.arange(1, len(codes) + 1, dtype=np.uint64) * _GOLD)
        while at:
            left = draws[len(ids)]
            for w, l, i in ways[at]:
                left -= math.exp(w - reach[at])
                if left < 0:
                    break
            ids.append(i)
            at -= l
        return np.full(len(ids), place), np.arange(len(ids)), np.array(ids, np.int64)

    def _bytes(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the pieces of their bytes."""
        code = np.where(ids < 0, -1 - ids, 0)
        code = np.where(code == _LITERAL, 0x2581, code)
        size = np.where(ids >= 0, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        base = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(ids, size)
        for i in np.flatnonzero(ids < 0):
            out[base[i]:base[i + 1]] = self.byte_id[list(chr(code[i]).encode("utf-8", "surrogatepass"))]
        return out, base[ends]

    # ---- decoding ---------------------------------------------------------------------

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes of all texts, each text's start and the end): pieces joined, less the first blank of each text."""
        begin, size = self.text_start[ids], np.diff(self.text_start)[ids]
        base = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(base[-1]) + np.repeat(begin - base[:-1], size)
        data = self.text_bytes[at]
        edges = base[ends]
        full = edges[1:] > edges[:-1]
        keep = np.ones(len(data), bool)
        keep[edges[:-1][full]] = False
        return data[keep], np.concatenate([[0], np.cumsum(np.diff(edges) - full)])


@lru_cache(maxsize=2)
def lattice(model: str, sharpness: float = 1.0) -> Lattice:
    return Lattice(model, sharpness)


def encode(df: DataFrame, model: str, key: str = "doc_id", text: str = "text", seed: int = SEED, sharpness: float = 1.0,
           keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) of every row, `piece_ids` array<int>, one sampled segmentation of its
    text, and `lossless`, whether decoding it gave the text back byte by byte.

    Rows are seeded by their key: equal keys and texts get equal segmentations, null keys count as one
    key. Null and empty texts give an empty array. Columns named as the new ones give way. One pass, no shuffle.
    """
    rest = [c for c in (df.columns if keep is None else keep) if c not in ("piece_ids", "lossless")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = lattice(model, sharpness)
        for batch in batches:
            texts, keys = batch.column(len(rest)), np.asarray(batch.column(len(rest) + 1), np.int64)
            ids, ends, same = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], []
            for a, b in chunks(texts, CHUNK):
                some, stops = tables.encode([t or "" for t in texts[a:b].to_pylist()], np.ascontiguousarray(keys[a:b]), seed)
                same.append(_equal_rows(text_bytes(texts[a:b]), tables.decode(some, stops)))
                ids.append(some)
                ends.append(stops[1:] + ends[-1][-1])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(rest)], lists, pa.array(np.concatenate(same) if same else np.zeros(0, bool))],
                names=[f"c{i}" for i in range(len(rest))] + ["p", "l"])

    narrow = df.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)],
        F.col(text).alias("t"), F.xxhash64(F.col(key)).alias("k"))
    schema = ", ".join([f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)] + ["p array<int>, l boolean"])
    return map_arrow(narrow, run, schema).toDF(*rest, "piece_ids", "lossless")


def _equal_rows(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    (data, at), (other, other_at) = a, b
    if np.array_equal(at, other_at) and np.array_equal(data, other):
        return np.ones(len(at) - 1, bool)
    return np.array([np.array_equal(data[s:e], other[o:p]) for s, e, o, p in zip(at, at[1:], other_at, other_at[1:])])


def decode(df: DataFrame, model: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """All columns of `df`, with the text of `ids` as `text`; a null array gives a null text. One pass, no shuffle."""
    rest = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = lattice(model)
        for batch in batches:
            column = batch.column(len(rest))
            ends = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)))])
            data, edges = tables.decode(np.asarray(column.flatten(), np.int64), ends.astype(np.int64))
            raw = data.tobytes()
            texts = [None if gone else raw[a:b].decode("utf-8", "replace") for a, b, gone in zip(edges[:-1], edges[1:], column.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(rest)], pa.array(texts, pa.string())], names=[f"c{i}" for i in range(len(rest))] + ["x"])

    narrow = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col(ids).alias("i"))
    schema = ", ".join([f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)] + ["x string"])
    return map_arrow(narrow, run, schema).toDF(*rest, text)
