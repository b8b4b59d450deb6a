"""Substring dedup: words of passages that occur elsewhere too, found by automata of the repeated phrases.

A window is `window` consecutive words. Its anchor is the run of eight words in it with the lowest hash, the first
one among equals, so equal windows have equal anchors at equal places. Consecutive windows of a text around one
anchor are a context of at most 2 · window - 8 words, and a window is in one context of a text's anchor once.

1. Anchors that occur once in all texts hold no repeated window; most of the texts go no further.
2. The contexts of the other anchors are cut from their texts, equal contexts are counted as one, and the windows of
   distinct contexts are counted: those that occur twice or more are confirmed. Each is a phrase of one context, its owner.
3. Phrases are dealt into shards by anchor. A shard compiles its phrases, over numbered word groups, into an Aho-Corasick
   automaton and streams all contexts of its anchors through it. So every text meets the automata that can match it and
   no others. An anchor of very many contexts has shards of its own, its contexts and phrases in bounded parts.
4. What is located marks the words of the texts.

Anchors, contexts and windows are counted by hashes: 64 bits (contexts 122). Places of phrases are found by the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aislekit.llm.base import VALUES, Words, chunks, map_arrow, mix, signed
from aislekit.session import written

#: Words of an anchor.
GRAM = 8
#: Phrases of an automaton (some 20 MB) and contexts that it streams, at most on average; and of one anchor at most.
PHRASES, CONTEXTS = 30_000, 16_384
#: Of a number that names a window, the bits for its place in the context; the others are its context's.
_PLACE = 6
#: Letters of a place of a number in an automaton.
_BASE = 64
_BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_POSITION = np.uint64((1 << 28) - 1)


class Spans:
    """Hashes of spans of words by prefix sums, in one of two independent lanes."""

    def __init__(self, x: np.ndarray, lane: int = 0):
        base = int(_BASES[lane])
        powers = np.full(len(x) + 1, base, np.uint64)
        inverse = np.full(len(x) + 1, pow(base, -1, 1 << 64), np.uint64)
        powers[0] = inverse[0] = 1
        self.inverse = np.cumprod(inverse)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x + _BASES[1 - lane]) * np.cumprod(powers)[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.inverse[start] + np.asarray(length).astype(np.uint64))


def contexts(row: np.ndarray, spans: Spans, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, n, anchor) of all contexts: the first word, the number of windows and the anchor's hash."""
    size = len(row) - window + 1
    none = np.zeros(0, np.int64)
    if size <= 0:
        return none, none, none.astype(np.uint64)
    grams = spans.of(np.arange(len(row) - GRAM + 1), GRAM)
    # the lowest hash of the grams of a window; among equal ones the first
    lowest = (mix(grams) & ~_POSITION) | (np.arange(len(grams)).astype(np.uint64) & _POSITION)
    wide, reach = window - GRAM + 1, 1
    while reach * 2 <= wide:
        lowest = np.minimum(lowest[:-reach], lowest[reach:])
        reach *= 2
    if reach < wide:
        lowest = np.minimum(lowest[:size], lowest[wide - reach:wide - reach + size])
    start = np.arange(size)
    at = start + ((lowest - start.astype(np.uint64)) & _POSITION).astype(np.int64)
    whole = np.flatnonzero(row[:size] == row[window - 1:])
    if len(whole) == 0:
        return none, none, none.astype(np.uint64)
    begins = np.ones(len(whole), bool)
    begins[1:] = (at[whole[1:]] != at[whole[:-1]]) | (np.diff(whole) > 1)
    begins = np.flatnonzero(begins)
    return whole[begins], np.diff(np.append(begins, len(whole))), grams[at[whole[begins]]]


def _anchors(texts: DataFrame, window: int) -> DataFrame:
    """(anchor, t1, t2) of every context of the texts (t1, t2, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(2)):
                words = Words(batch.column(2)[a:b])
                first, _, anchor = contexts(words.row, Spans(words.hashes(VALUES)), window)
                rows = pa.array(words.row[first] + a) if len(first) else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([signed(anchor), batch.column(0).take(rows), batch.column(1).take(rows)], names=["anchor", "t1", "t2"])

    return map_arrow(texts, run, "anchor bigint, t1 bigint, t2 bigint")


def _cut_contexts(texts: DataFrame, window: int) -> DataFrame:
    """The contexts of the wanted anchors of texts (t1, t2, text, anchors, copies), with their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(2)):
                words = Words(batch.column(2)[a:b])
                x = words.hashes(VALUES)
                lanes = Spans(x), Spans(x, 1)
                first, n, anchor = contexts(words.row, lanes[0], window)
                if len(first) == 0:
                    continue
                row = words.row[first]
                lists = batch.column(3)[a:b]
                wanted = np.zeros(len(first), bool)
                flat, ends = np.asarray(lists.flatten()).view(np.uint64), np.cumsum(np.asarray(lists.value_lengths()))
                edges = np.searchsorted(row, np.arange(b - a + 1))
                for r in range(b - a):
                    wanted[edges[r]:edges[r + 1]] = np.isin(anchor[edges[r]:edges[r + 1]], flat[(ends[r - 1] if r else 0):ends[r]])
                first, n, anchor, row = (v[wanted] for v in (first, n, anchor, row))
                length = n + window - 1
                c1, c2 = (lane.of(first, length) for lane in lanes)
                whole, parts, cut = words.data.tobytes(), None, []
                for r, f, l in zip(row.tolist(), (first - words.first[row]).tolist(), length.tolist()):
                    if parts is None or r != parts[0]:
                        parts = r, whole[words.offsets[r]:words.offsets[r + 1]].split()
                    cut.append(b" ".join(parts[1][f:f + l]))
                rows = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([
                    signed(anchor), signed(c1 >> np.uint64(_PLACE) << np.uint64(_PLACE)), signed(c2), pa.array(n, pa.int32()),
                    *(batch.column(i).take(rows) for i in (0, 1)), pa.array(first - words.first[row], pa.int64()),
                    batch.column(4).take(rows), pa.array(cut, pa.binary()).cast(pa.string()),
                ], names=["anchor", "c1", "c2", "n", "t1", "t2", "first", "copies", "words"])

    return map_arrow(texts, run, "anchor bigint, c1 bigint, c2 bigint, n int, t1 bigint, t2 bigint, first bigint, copies bigint, words string")


def _windows(distinct: DataFrame, window: int) -> DataFrame:
    """(window, copies, owner) of the windows of distinct contexts (c1, copies, words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(2)):
                words = Words(batch.column(2)[a:b])
                spans = Spans(words.hashes(VALUES))
                n = np.maximum(words.count - window + 1, 0)
                row = np.repeat(np.arange(b - a), n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                owner = np.asarray(batch.column(0)[a:b])[row] | place
                yield pa.RecordBatch.from_arrays([
                    signed(spans.of(words.first[row] + place, window)), batch.column(1).take(pa.array(row + a)), pa.array(owner, pa.int64())],
                    names=["window", "copies", "owner"])

    return map_arrow(distinct.select("c1", "copies", "words"), run, "window bigint, copies bigint, owner bigint")


class Automaton:
    """The windows that the masks of phrases (words, mask) name, in an Aho-Corasick automaton.

    Groups of `step` words are numbered, told apart by the words themselves, and a window is window / step of
    them one after the other. A text is streamed once for each of the `step` places at which a window may begin.
    Numbers are spelled in digits, each place with letters of its own, since a state looks through its successors one by one.
    """

    def __init__(self, phrases: list[tuple[str, int]], window: int):
        self.window = window
        self.step = max(d for d in range(1, 8) if window % d == 0)
        self.words: dict[str, int] = {}
        self.groups: dict[tuple[int, ...], tuple[int, ...]] = {}
        numbered = []
        for text, mask in phrases:
            words = [self.words.setdefault(w, len(self.words) + 1) for w in text.split(" ")]
            groups = list(self._groups(words))
            for g in groups:
                self.groups.setdefault(g, ())
            numbered.append((groups, mask))
        self.digits = 1
        while _BASE ** self.digits < len(self.groups):
            self.digits += 1
        for number, g in enumerate(self.groups):
            self.groups[g] = tuple(number // _BASE ** d % _BASE + d * _BASE for d in range(self.digits))
        self.nothing = (self.digits * _BASE,) * self.digits
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for groups, mask in numbered:
            spelled = [self.groups[g] for g in groups]
            while mask:
                at = (mask & -mask).bit_length() - 1
                mask &= mask - 1
                self.automaton.add_word(tuple(chain.from_iterable(spelled[at:at + window - self.step + 1:self.step])), 1)
        self.automaton.make_automaton()

    def _groups(self, words: list[int]) -> Iterator[tuple[int, ...]]:
        return zip(*(words[i:] for i in range(self.step)))

    def find(self, text: str) -> int:
        """The mask of the words at which a window begins."""
        known, spelled = self.words.get, self.groups.get
        words = [known(w, 0) for w in text.split(" ")]
        letters = [spelled(g, self.nothing) for g in self._groups(words)]
        mask, back = 0, self.window // self.step - 1
        for phase in range(self.step):
            for end, _ in self.automaton.iter(tuple(chain.from_iterable(letters[phase::self.step]))):
                mask |= 1 << (phase + (end // self.digits - back) * self.step)
        return mask


def _locate(window: int):
    def run(phrases: pa.Table, streamed: pa.Table) -> pa.Table:
        masks = np.zeros(streamed.num_rows, np.int64)
        if phrases.num_rows and streamed.num_rows:
            automaton = Automaton(list(zip(phrases.column("words").to_pylist(), phrases.column("mask").to_pylist())), window)
            masks = np.array([automaton.find(words) for words in streamed.column("words").to_pylist()], np.int64)
        hit = pa.array(masks != 0)
        return pa.table({"c1": streamed.column("c1").filter(hit), "c2": streamed.column("c2").filter(hit), "mask": pa.array(masks[masks != 0])})

    return run


def _keep(key: str, kind: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, marks in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode().split()  # at the blanks of the words
                marks = marks.as_py()
                n_words.append(len(words))
                if marks:
                    edges = np.zeros(len(words) + 1, np.int64)
                    for mark in marks:
                        mask = mark["mask"]
                        while mask:
                            at = mark["first"] + (mask & -mask).bit_length() - 1
                            mask &= mask - 1
                            edges[at] += 1
                            edges[at + window] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=[key, "n_words", "n_removed", "kept"])

    return run, f"{key} {kind}, n_words bigint, n_removed bigint, kept string"


def repeated_windows(texts: DataFrame, window: int) -> DataFrame:
    """(t1, t2, marks): of texts (t1, t2, text) with a repeated window the places of all of them, as (first, mask):
    bit i of mask stands for the window that starts at word first + i."""
    anchors = written(_anchors(texts.select("t1", "t2", "text"), window), "phrase-anchors")
    again = anchors.groupBy("anchor").agg(F.count("*").alias("places")).where("places > 1").select("anchor")
    again = written(again, "phrase-repeated-anchors")
    wanted = anchors.join(again, "anchor", "left_semi").groupBy("t1", "t2").agg(F.collect_set("anchor").alias("anchors"))
    wanted = written(wanted, "phrase-texts")
    # equal texts are one from here on, and before they are shuffled
    some = texts.groupBy("t1", "t2").agg(F.first("text").alias("text"), F.count("*").alias("copies")).join(wanted, ["t1", "t2"])
    cut = written(_cut_contexts(some.select("t1", "t2", "text", "anchors", "copies"), window), "phrase-contexts", compression="zstd")
    distinct = cut.groupBy("c1", "c2").agg(F.sum("copies").alias("copies"), F.first("anchor").alias("anchor"), F.first("words").alias("words"))
    distinct = written(distinct, "phrase-distinct", compression="zstd")

    confirmed = _windows(distinct, window).groupBy("window").agg(F.sum("copies").alias("copies"), F.min("owner").alias("owner")).where("copies > 1")
    place = F.col("owner").bitwiseAND((1 << _PLACE) - 1)
    owned = confirmed.groupBy((F.col("owner") - place).alias("c1")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(owner & {(1 << _PLACE) - 1} AS int))")).alias("mask"))
    phrases = written(distinct.join(owned, "c1").select("anchor", "c2", "words", "mask"), "phrases", compression="zstd")

    # shards by anchor; anchors beyond a shard's size have shards of their own, by parts of contexts and of phrases
    of_phrases = phrases.groupBy("anchor").agg(F.sum(F.bit_count("mask")).alias("phrases"))
    sizes = written(of_phrases.join(distinct.groupBy("anchor").agg(F.count("*").alias("contexts")), "anchor"), "phrase-sizes")
    total = sizes.agg(F.coalesce(F.sum("phrases"), F.lit(0)), F.coalesce(F.sum("contexts"), F.lit(0))).first()
    shards = 1 + max(total[0] // PHRASES, total[1] // CONTEXTS)
    large = sizes.where((F.col("phrases") > PHRASES) | (F.col("contexts") > CONTEXTS)).select(
        "anchor", F.ceil(F.col("phrases") / PHRASES).cast("int").alias("p"), F.ceil(F.col("contexts") / CONTEXTS).cast("int").alias("c"))
    streamed = distinct.join(sizes.select("anchor"), "anchor", "left_semi").select("anchor", "c1", "c2", "words")

    def sharded(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.join(large, "anchor", "left").withColumns({
            own: F.when(F.col(own).isNotNull(), F.pmod("c2", F.col(own)).cast("int")),
            "others": F.when(F.col(other).isNotNull(), F.sequence(F.lit(0), F.col(other) - 1)).otherwise(F.array(F.lit(0)))})
        df = df.withColumn(other, F.explode("others")).drop("others")
        return df.withColumn("shard", F.when(F.col(own).isNull(), F.pmod("anchor", F.lit(shards))).otherwise(F.xxhash64("anchor", "p", "c")))

    by_phrase = sharded(phrases, "p", "c").select("shard", "words", "mask").groupBy("shard")
    by_context = sharded(streamed, "c", "p").select("shard", "c1", "c2", "words").groupBy("shard")
    located = by_phrase.cogroup(by_context).applyInArrow(_locate(window), "c1 bigint, c2 bigint, mask bigint")
    located = written(located.groupBy("c1", "c2").agg(F.bit_or("mask").alias("mask")), "phrase-places")
    marks = cut.select("t1", "t2", "first", "c1", "c2").join(located, ["c1", "c2"])
    return written(marks.groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "mask")).alias("marks")), "phrase-marks")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """(key, n_words, n_removed, kept) of every row: the words not covered by a window that starts anywhere else too.

    Words are parted by blanks and compared as they are. Windows are judged on the input, the same text included; a
    repeated row repeats all its windows. `kept` joins the words left by one space. Null and empty texts
    have no words; texts of fewer words than a window keep all. Other columns are not looked at. An empty
    table gives an empty one. `window` is 9 to 70 words.
    """
    if not GRAM < window <= 70:
        raise ValueError("window must be 9 to 70 words")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # a text is known by 96 bits of hashes
    rows = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))})
    marks = repeated_windows(rows, window)
    function, schema = _keep(key, docs.schema[key].dataType.simpleString(), window)
    return map_arrow(rows.join(marks, ["t1", "t2"], "left").select("key", "text", "marks"), function, schema)
