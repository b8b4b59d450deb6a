"""Similarity join of word shingle sets by parity sketches.

Every shingle is hashed to a bit (XOR: shingles of even number in a place cancel) of a sketch. Two
sets whose sketches differ in x bits differ in x shingles at least. A linked pair of sets of a and b
shingles differs in at most (a + b)(1 - s) / (1 + s) of them, s being the similarity.

Candidates by pigeonhole: documents of a size band share a layout of blocks, more of them than a
linked pair can differ in. A block's word is the XOR of 64-bit hashes of its shingles, so a linked
pair has equal words in some blocks. Empty blocks would meet everywhere; the layout has so many blocks
to spare that a linked pair still meets in one that is not empty, and a document with more empty
blocks than that shows them too. A document near the top of its band also takes the next band's layout.

Then pairs whose sketches are near enough are verified on the sets themselves. In groups of equal block
words of up to SMALL documents every pair is a candidate, each pair once whatever the number of words it
shares. In larger groups a first pass over an eighth of the words takes a spanning forest of near sketches
of each group; after that, groups within one component need no look any more. A linked pair across components
has all its equal words in large groups of several components, and it has as many as its layout has blocks
to spare: a document is looked at in its rarest such groups alone, all but that many (prefix filtering), and
there every pair of near sketches across components is verified. Large groups are cut into bounded
parts, and parts meet in pairs inside a task on folded sketches. Near copies that are no links are as many
as the square of a group, so no pairs leave these tasks, only the documents that have a near one. Their sets meet
in tasks again, and of the links found there a spanning forest of the components leaves a task. Groups of one family
of near copies have much the same members: they share their greatest component, and meet once, not group by group.
Parts within that component never meet. So a family's rows grow in proportion to it as long as the others fill a
part, and with the product of others and parts beyond.

Equal sets are one node, known by a 64-bit hash of the set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from aislekit.llm.base import CHUNK_BYTES, Words, chunks, distinct, map_arrow, mix, shingles
from aislekit.llm.components import components
from aislekit.session import written

#: Width of a size band, and bits of a sketch per shingle that a linked pair may differ in.
BAND, BITS = 1.5, 16
#: Documents of a group whose pairs are all candidates; of larger groups one in so many takes part in the first pass.
SMALL, FIRST = 8, 8
#: Documents of a group that one task compares with as many others, and shingles of theirs if it takes whole sets.
PART, PART_SHINGLES = 1024, 1 << 20
#: Times as many documents and shingles if a task takes folded sketches and keeps no pairs.
WIDE, WIDE_SHINGLES = 8, 1 << 26
#: Share of a group's documents in its greatest component from which on the group is looked at with that component's others.
FAMILY = 0.5
#: Bits of the filter in which the nodes to verify are marked: as many for each node, within bounds that a driver
#: and a task can hold. It only spares work, the join after it decides.
FILTER_PER_NODE, FILTER_LEAST, FILTER_MOST = 16, 1 << 16, 1 << 26
#: Groups are looked at by sketches of so many times fewer bits; folding keeps the lower bound.
BRIEF = 4
_GOLD, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)


class Layouts:
    """Blocks and sketch bits by set size, for similarity `percent`."""

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        low = [1]
        while low[-1] <= largest:
            low.append(max(low[-1] + 1, int(np.ceil(low[-1] * BAND))))
        low.append(max(low[-1] + 1, int(np.ceil(low[-1] * BAND))))
        self.low = np.array(low, np.int64)
        top = self.low[1:] - 1
        differ = self.differ(top, top)
        self.spare = np.where(differ > 0, np.ceil(differ * 0.03).astype(np.int64) + 3, 0)
        self.blocks = differ + 1 + self.spare
        self.bits = np.maximum(64, 2 ** np.ceil(np.log2(np.maximum(differ, 1) * BITS)).astype(np.int64))

    def differ(self, a, b):
        """The most shingles in which a linked pair of these sizes differs."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: first row, last row, (row, hash) of the distinct shingles, the set sizes and the nodes."""
    for a, b in chunks(column, CHUNK_BYTES):
        words = Words(column[a:b])
        rows, hashes = distinct(*shingles(words, words.hashes(), k))
        size = np.bincount(rows, minlength=b - a)
        total = np.zeros(b - a, np.uint64)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        full = size > 0
        if full.any():
            total[full] = np.add.reduceat(mix(hashes ^ _GOLD), begin[full])
        yield a, b, rows, hashes, size, mix(total + size.astype(np.uint64) * _GOLD)


def _places(layouts: Layouts, band: np.ndarray, rows: np.ndarray, hashes: np.ndarray, size: np.ndarray):
    """Which rows have blocks, how many, where the blocks of each begin, and the block and hash of every shingle of these rows."""
    used = (band >= 0) & (size > 0)
    blocks = np.where(used, layouts.blocks[np.maximum(band, 0)], 0)
    base = np.concatenate([[0], np.cumsum(blocks)])
    pick = used[rows]
    rows, hashes = rows[pick], hashes[pick]
    place = mix(hashes * np.uint64(3) + _GOLD) >> np.uint64(32)
    return used, blocks, base, base[rows] + (place * blocks[rows].astype(np.uint64) >> np.uint64(32)).astype(np.int64), hashes


def shared_words(layouts: Layouts, band: np.ndarray, rows: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many of the block words that a row shows under the layout `band` any row linked with it shows too, at least.

    All blocks but as many as shingles may differ are equal, and at most the row's empty blocks are not shown.
    """
    used, blocks, base, at, _ = _places(layouts, band, rows, hashes, size)
    full = np.bincount(at, minlength=base[-1]) > 0
    empty = blocks - np.diff(np.concatenate([[0], np.cumsum(full)])[base])
    spare = np.where(used, layouts.spare[np.maximum(band, 0)], 0)
    return np.where(used, 1 + spare - np.where(empty > spare, 0, empty), 0)


def _block_words(layouts: Layouts, band: np.ndarray, rows: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the block words of all rows under the layout `band` of each (below 0: none)."""
    used, blocks, base, at, hashes = _places(layouts, band, rows, hashes, size)
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    word = np.zeros(base[-1], np.uint64)
    empty = np.ones(base[-1], bool)
    if len(first):
        word[at[first]] = np.bitwise_xor.reduceat(mix(hashes[order] ^ _WORD), first)
        empty[at[first]] = False
    row = np.repeat(np.arange(len(band)), blocks)
    number = np.arange(base[-1]) - base[row]
    layout = band[row].astype(np.uint64)
    key = mix(word + mix((number.astype(np.uint64) << np.uint64(20)) + layout * np.uint64(2) + np.uint64(1)))
    key = key & ~np.uint64(1) | layout & np.uint64(1)  # the last bit tells which of a row's two layouts it is
    crowded = np.bincount(row[empty], minlength=len(band)) > np.where(used, layouts.spare[np.maximum(band, 0)], 0)
    show = ~empty | crowded[row]
    return row[show], key[show]


def _sketches(layouts: Layouts, rows: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> list[bytes]:
    bits = np.where(size > 0, layouts.bits[np.maximum(layouts.band(size), 0)], 0)
    base = np.concatenate([[0], np.cumsum(bits)])
    place = (mix(hashes * np.uint64(5) + _GOLD) & (bits[rows].astype(np.uint64) - np.uint64(1))).astype(np.int64)
    parity = np.packbits((np.bincount(base[rows] + place, minlength=base[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [parity[a // 8:b // 8] for a, b in zip(base[:-1], base[1:])]


def _fresh(size: np.ndarray, node: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which rows have a set that the task has not seen yet."""
    fresh = np.zeros(len(size), bool)
    for i, s in enumerate(node.tolist()):
        if size[i] and s not in seen:
            seen.add(s)
            fresh[i] = True
    return fresh


def _sketch_table(docs: DataFrame, layouts: Layouts, k: int) -> DataFrame:
    """(doc, n, node, sketch, brief, even, odd) of every row (doc, text); equal sets of a task show the sketches once.

    `even` and `odd` are the `shared_words` under its two layouts, by the layout's number.
    """
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b, rows, hashes, size, node in _sets(batch.column(1), k):
                fresh = _fresh(size, node, seen)
                pick = fresh[rows]
                some = rows[pick], hashes[pick], np.where(fresh, size, 0)
                sketch = _sketches(layouts, *some)
                brief = [_fold([x], max(8, len(x) // BRIEF)).tobytes() if x else None for x in sketch]
                own = layouts.band(size)
                needs = [shared_words(layouts, np.where(fresh, band, -1), *some) for band in (own, own + 1)]
                by_number = [np.where(own % 2 == number, *needs) for number in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(size, pa.int64()), pa.array(node.view(np.int64), mask=size == 0),
                     *(pa.array([x if f else None for x, f in zip(v, fresh)], pa.binary()) for v in (sketch, brief)),
                     *(pa.array(v, pa.int32()) for v in by_number)],
                    names=["doc", "n", "node", "sketch", "brief", "even", "odd"])

    return map_arrow(docs, run, f"doc {kind}, n bigint, node bigint, sketch binary, brief binary, even int, odd int")


def _shown_words(docs: DataFrame, layouts: Layouts, k: int) -> DataFrame:
    """(key, node) of all block words of the texts; equal sets of a task show theirs once. Made from the texts a
    second time: there are too many words to keep them on disk beside their shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b, rows, hashes, size, node in _sets(batch.column(0), k):
                fresh = _fresh(size, node, seen)
                pick = fresh[rows]
                own = layouts.band(size)
                reach = size * 100 >= layouts.low[own + 1] * layouts.percent
                for band, ok in ((own, fresh), (own + 1, fresh & reach)):
                    at, key = _block_words(layouts, np.where(ok, band, -1), rows[pick], hashes[pick], np.where(fresh, size, 0))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[at].view(np.int64))], names=["key", "node"])

    return map_arrow(docs.select("text"), run, "key bigint, node bigint")


def _fold(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches as rows of 64-bit numbers, all of `width` bytes: halves of a sketch XOR to the one of half the bits."""
    out = np.empty((len(sketches), width), np.uint8)
    size = np.array([len(s) for s in sketches])
    for wide in np.unique(size).tolist():
        at = np.flatnonzero(size == wide)
        x = np.frombuffer(b"".join([sketches[i] for i in at.tolist()]), np.uint8).reshape(-1, wide)
        while x.shape[1] > width:
            half = x.shape[1] // 2
            x = x[:, :half] ^ x[:, half:]
        out[at] = x
    return out.view(np.uint64)


def near_pairs(left, right, layouts: Layouts) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of rows of `left` and `right`, each (nodes, sizes, sketches, components), that may be linked and are in different components."""
    sketches = [*left[2], *right[2]]
    both = _fold(sketches, min(map(len, sketches)))
    a, b = both[:len(left[0])], both[len(left[0]):]
    out = []
    step = max(1, (1 << 21) // max(1, b.size))
    for s in range(0, len(a), step):
        differ = np.bitwise_count(a[s:s + step, None, :] ^ b[None, :, :]).sum(2, dtype=np.int64)
        near = differ <= layouts.differ(left[1][s:s + step, None], right[1][None, :])
        near &= left[3][s:s + step, None] != right[3][None, :]
        i, j = np.nonzero(near)
        out.append((i + s, j))
    i, j = (np.concatenate(x) for x in zip(*out))
    return i, j


def _forest(i: np.ndarray, j: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Which of the pairs make a spanning forest over the components, pairs of much linked rows first."""
    degree = np.bincount(np.concatenate([i, j]), minlength=len(component))
    order = np.argsort(-np.maximum(degree[i], degree[j]), kind="stable")
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    keep = []
    labels = component.tolist()
    for e, x, y in zip(order.tolist(), i[order].tolist(), j[order].tolist()):
        x, y = find(labels[x]), find(labels[y])
        if x != y:
            root[x] = y
            keep.append(e)
    return np.array(keep, np.int64)


def _near(pairs: DataFrame, nodes: DataFrame, layouts: Layouts) -> DataFrame:
    """The pairs (a, b) whose sketches differ in no more bits than a linked pair's sets."""
    met = pairs
    for end in ("a", "b"):
        met = met.join(nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"s_{end}")), end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(i) for i in (4, 5))
            widths = [np.asarray(pa.compute.binary_length(c)) for c in (left, right)]
            differ = np.zeros(batch.num_rows, np.int64)
            for x, y in set(zip(*(w.tolist() for w in widths))):
                at = np.flatnonzero((widths[0] == x) & (widths[1] == y))
                some = [_fold(c.take(pa.array(at)).to_pylist(), min(x, y)) for c in (left, right)]
                differ[at] = np.bitwise_count(some[0] ^ some[1]).sum(1, dtype=np.int64)
            near = differ <= layouts.differ(np.asarray(batch.column(2)), np.asarray(batch.column(3)))
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return map_arrow(met.select("a", "b", "n_a", "n_b", "s_a", "s_b"), run, "a bigint, b bigint")


def _cut(members: DataFrame, key: str, alone: bool = False, rows: int | None = None, shingles: int = 1 << 62) -> DataFrame:
    """The members, each once for every pair (p, q) of parts of its group `key` that its own `part` belongs to.

    A group of more than `rows` rows (PART), or more than so many shingles `n`, is cut into parts by the node. Every part
    meets itself `alone`; otherwise every pair of parts meets in a task of its own, but those of the component that has
    the number `key` are cut apart from the others and do not meet each other.
    """
    def parts(some):
        return F.greatest(F.ceil(F.count_if(some) / (rows or PART)), F.ceil(F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)) / shingles)).cast("int")

    one = F.lit(False) if alone else F.col("component") == F.col(key)
    counted = members.groupBy(key).agg(parts(F.lit(True)).alias("all"), parts(one).alias("one"), parts(~one).alias("rest"))
    whole = F.col("all") == 1
    counted = counted.select(key, F.when(whole, 0).otherwise(F.col("one")).alias("one"), F.when(whole, 1).otherwise(F.col("rest")).alias("rest"))
    cut = members.join(counted, key).withColumn("first", one & (F.col("one") > 0))
    own = F.greatest(F.when(F.col("first"), F.col("one")).otherwise(F.col("rest")), F.lit(1))
    cut = cut.withColumn("part", (F.pmod(F.xxhash64("node", key), own) + F.when(F.col("first"), 0).otherwise(F.col("one"))).cast("int"))
    begin, end = F.when(F.col("first"), F.col("one")).otherwise(0), F.col("one") + F.col("rest") - 1
    others = F.array(F.col("part")) if alone else F.when(begin <= end, F.sequence(begin, end))
    cut = cut.withColumn("other", F.explode(others))
    return cut.select(key, F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", *(c for c in members.columns if c != key))


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the two parts that meet in a task, twice the same ones if a part meets itself."""
    p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
    part = np.asarray(table.column("part"))
    return np.flatnonzero(part == p), np.flatnonzero(part == q)


def _meetings(keys: list[list[int]], left: np.ndarray, right: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows to compare so that all pairs of a row `left` and one `right` with a key in common are: key by key, or all at once if these are fewer pairs."""
    by_key: tuple[dict[int, list[int]], ...] = ({}, {})
    for rows, of in zip((left, right), by_key):
        for row in rows.tolist():
            for key in keys[row]:
                of.setdefault(key, []).append(row)
    both = [(x, by_key[1][key]) for key, x in by_key[0].items() if key in by_key[1]]
    if len(left) * len(right) <= sum(len(x) * len(y) for x, y in both):
        return [(left, right)]
    return [(np.array(x), np.array(y)) for x, y in both]


def _met(rows: list[np.ndarray], meetings: list[tuple[np.ndarray, np.ndarray]], layouts: Layouts) -> tuple[np.ndarray, np.ndarray]:
    """The distinct `near_pairs` (i, j), i below j, of `rows` (nodes, sizes, sketches, components) in all the meetings, by i."""
    found = [np.zeros(0, np.int64)]
    for left, right in meetings:
        if len(left) and len(right):
            i, j = near_pairs([x[left] for x in rows], [x[right] for x in rows], layouts)
            i, j = left[i], right[j]
            found.append(np.unique(np.minimum(i, j) * len(rows[0]) + np.maximum(i, j)))
    return np.divmod(np.unique(np.concatenate(found)), max(1, len(rows[0])))


def _briefs(table: pa.Table) -> list[np.ndarray]:
    return [np.asarray(table.column("node")), np.asarray(table.column("n")), np.array(table.column("brief").to_pylist(), object), np.asarray(table.column("component"))]


def _candidates(members: DataFrame, layouts: Layouts) -> DataFrame:
    """(a, b) of near sketches, a spanning forest of each part of each group, of rows (key, node, n, brief, component)."""
    def meet(table: pa.Table) -> pa.Table:
        node, _, _, component = rows = _briefs(table)
        i, j = _met(rows, [_sides(table)], layouts)
        if len(i):
            keep = _forest(i, j, component)
            i, j = i[keep], j[keep]
        return pa.table({"a": pa.array(node[i], pa.int64()), "b": pa.array(node[j], pa.int64())})

    found = _cut(members, "key", alone=True).groupBy("key", "p", "q").applyInArrow(meet, "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _families(members: DataFrame, share: float) -> DataFrame:
    """(family, most, node, component, keys) of the distinct members (key, node, component): groups whose greatest component
    has such a share of their rows are a family with the others of that component, other groups are one each. `most` is
    the greatest component of all groups of the family."""
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("rows"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("rows", "component")).alias("most"), F.sum("rows").alias("rows"))
    family = F.when(F.col("most.rows") >= F.col("rows") * share, F.col("most.component")).otherwise(F.col("key"))
    return members.join(sizes.select("key", family.alias("family"), F.col("most.component").alias("most")), "key").groupBy("family", "most", "node").agg(
        F.first("component").alias("component"), F.array_sort(F.collect_list("key")).alias("keys"))  # as many keys as the node has words, at most


def have_near(rows: list[np.ndarray], meetings: list[tuple[np.ndarray, np.ndarray]], layouts: Layouts) -> np.ndarray:
    """Whether each of `rows` has `near_pairs` in the meetings. Two rows that are known to have some are not compared any more."""
    near = np.zeros(len(rows[0]), bool)

    def mark(x: np.ndarray, y: np.ndarray) -> None:
        if len(x) and len(y):
            i, j = near_pairs([c[x] for c in rows], [c[y] for c in rows], layouts)
            near[x[i]] = near[y[j]] = True

    for left, right in meetings:
        for s in range(0, len(left), PART):
            for t in range(0, len(right), PART):
                x, y = left[s:s + PART], right[t:t + PART]
                known = near[x]
                mark(x[~known], y)
                mark(x[known], y[~near[y]])
    return near


def _near_ones(members: DataFrame, layouts: Layouts) -> DataFrame:
    """The members (family, node, component, keys, n, brief, ...) without n and brief that have a near sketch of another
    component in their family, once for each meeting of parts that shows it."""
    kept = [c for c in members.columns if c not in ("n", "brief")]
    number = pa.int64()
    made = pa.schema([(c, pa.list_(pa.field("element", number)) if c == "keys" else number) for c in kept])

    def meet(table: pa.Table) -> pa.Table:
        near = have_near(_briefs(table), _meetings(table.column("keys").to_pylist(), *_sides(table)), layouts)
        return table.select(kept).filter(pa.array(near)).cast(made)

    cut = _cut(members, "family", rows=PART * WIDE, shingles=WIDE_SHINGLES)
    return cut.groupBy("family", "p", "q").applyInArrow(meet, ", ".join(f"{c} {'array<bigint>' if c == 'keys' else 'bigint'}" for c in kept))


def _once(near: DataFrame) -> DataFrame:
    """(family, node, component, keys), each node once in a family with all its keys there: families of one greatest component are one."""
    keys = F.array_distinct(F.flatten(F.collect_set("keys")))  # as many as the node has words, at most
    return near.groupBy(F.col("most").alias("family"), "node").agg(F.first("component").alias("component"), keys.alias("keys"))


def linked_forest(i: np.ndarray, j: np.ndarray, hashes: np.ndarray, size: np.ndarray, component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of the pairs (i, j) of rows, by i, a spanning forest of the components that linked ones join. The rows' shingles are in `hashes`, one row after the other."""
    ends = np.concatenate([[0], np.cumsum(size)])
    number = np.unique(hashes, return_inverse=True)[1]
    own = np.zeros(len(hashes), np.int64)
    label = np.unique(component, return_inverse=True)[1]
    out = []
    for x, others in zip(np.unique(i).tolist(), np.split(j, np.flatnonzero(np.diff(i)) + 1)):
        others = others[label[others] != label[x]]
        if len(others) == 0:
            continue
        many = size[others]
        start = np.cumsum(many) - many
        own[number[ends[x]:ends[x + 1]]] = 1
        common = np.add.reduceat(own[number[np.repeat(ends[others] - start, many) + np.arange(many.sum())]], start)
        own[number[ends[x]:ends[x + 1]]] = 0
        for y in others[common * 100 >= (size[x] + many - common) * percent].tolist():
            if label[y] != label[x]:
                out.append((x, y))
                label[label == label[y]] = label[x]
    return out


def _links_across(near: DataFrame, nodes: DataFrame, docs: DataFrame, sketched: DataFrame, layouts: Layouts, k: int, percent: int) -> DataFrame:
    """Links (a, b) that join all components which the links within groups of `near` (family, node, component, keys) join."""
    sets = _sets_of(near.select("node").distinct(), docs, sketched, k)
    cut = _cut(near.join(nodes.select("node", "n"), "node"), "family", shingles=PART_SHINGLES).join(sets, "node")

    def meet(table: pa.Table) -> pa.Table:
        node, size, component = (np.asarray(table.column(c)) for c in ("node", "n", "component"))
        hashes = np.asarray(table.column("shingles").combine_chunks().flatten()).view(np.uint64)
        sketch = np.array(_sketches(layouts, np.repeat(np.arange(len(size)), size), hashes, size), object)
        i, j = _met([node, size, sketch, component], _meetings(table.column("keys").to_pylist(), *_sides(table)), layouts)
        found = linked_forest(i, j, hashes, size, component, percent)
        return pa.table({end: pa.array([node[x[e]] for x in found], pa.int64()) for e, end in enumerate("ab")})

    return cut.groupBy("family", "p", "q").applyInArrow(meet, "a bigint, b bigint")


def _sets_of(nodes: DataFrame, docs: DataFrame, sketched: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the distinct nodes. Only their sets are made, each from one of its documents."""
    # one document for each node, found by its row hash; marks in a filter spare most of the others
    owners = sketched.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("mark").alias("mark"))
    owners = written(owners, "join-owners")
    width = min(FILTER_MOST, max(FILTER_LEAST, owners.count() * FILTER_PER_NODE))
    words = owners.select(F.pmod("mark", F.lit(width)).alias("bit")).groupBy(F.expr("bit div 63").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 63 AS int))")).alias("bits")).toArrow()  # FILTER_MOST / 63 rows at most
    marks = np.zeros(width // 63 + 1, np.int64)
    marks[np.asarray(words.column("word"))] = np.asarray(words.column("bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.asarray(batch.column(0)) % width
            rows = np.flatnonzero(marks[bit // 63] >> (bit % 63) & 1)
            if len(rows) == 0:
                continue
            some = batch.take(pa.array(rows))
            for a, b, _, hashes, size, node in _sets(some.column(1), k):
                ends = np.concatenate([[0], np.cumsum(size)])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0)[a:b], pa.array(node.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes.view(np.int64)))],
                    names=["mark", "node", "shingles"])

    sets = map_arrow(docs.select("mark", "text"), run, "mark bigint, node bigint, shingles array<bigint>")
    sets = sets.join(owners, ["mark", "node"], "left_semi").dropDuplicates(["node"]).drop("mark")
    return written(sets.select("node", "shingles"), "join-sets")


def _verified(pairs: DataFrame, docs: DataFrame, sketched: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough."""
    pairs = written(pairs, "join-pairs")
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, sketched, k)
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    met = met.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    met = met.withColumn("common", F.size(F.array_intersect("x", "y")))
    whole = F.size("x") + F.size("y") - F.col("common")
    return met.where(F.col("common") * 100 >= whole * percent).select("a", "b")


def _rooted(df: DataFrame, key: str, text: str, words: int, percent: int, largest: int) -> DataFrame:
    """(doc, mark, n, root): of every row its set's size and the node that links reach from it, null without words."""
    layouts = Layouts(percent, largest)
    docs = df.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("doc", "text"))
    table = written(_sketch_table(docs.select(F.struct("doc", "mark").alias("doc"), "text"), layouts, words), "join-sketches")
    sketched = table.select("doc.doc", "doc.mark", "n", "node")
    labels = _linked(table, docs, sketched, layouts, words, percent)
    return sketched.join(labels, "node", "left").select("doc", "mark", "n", F.coalesce("root", "node").alias("root"))


def similar_texts(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85,
                  largest: int = 1 << 40) -> DataFrame:
    """(key, n_shingles, component_id) for every row: two texts link where 100 · |A ∩ B| >= percent · |A ∪ B|.

    Texts without words, empty or null, have no shingles and link with nothing: their component is their own
    key. Fewer words than `words` are one shingle. Equal texts link; repeated rows are rows of their own.
    component_id is the smallest key that links reach; null keys are passed over (null if all are). Other
    columns are not looked at. An empty table gives an empty one.
    """
    rows = _rooted(df, key, text, words, percent, largest)
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc").alias("least"))
    rows = rows.join(least, "root", "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc"))
    return rows.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def without_copies(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80,
                   largest: int = 1 << 40) -> DataFrame:
    """The rows of `df`, one of each group of linked texts: that of the smallest key, null last, and among rows of that
    key the one of the smallest hash of key and text. A repeated row stays once; texts without words all stay."""
    rows = _rooted(df, key, text, words, percent, largest).where("root IS NOT NULL")
    first = F.min(F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "mark")).alias("first")
    groups = rows.groupBy("root").agg(first, F.count("*").alias("rows")).where("rows > 1").select("root", F.col("first.mark").alias("first"))
    marks = rows.join(groups, "root").groupBy("mark").agg(F.max(F.col("mark") == F.col("first")).alias("stays"), F.count("*").alias("rows"))
    marks = written(marks.where("NOT stays OR rows > 1"), "join-marks")
    mark, stays, times = ("__" + "_".join([name, *df.columns]) for name in ("mark", "stays", "rows"))  # names that df does not have
    marks = marks.toDF(mark, stays, times)
    met = df.withColumn(mark, F.xxhash64(F.col(key), F.col(text))).join(marks, mark, "left")
    alone = met.where(F.col(stays).isNull())
    repeated = met.where(F.col(stays)).dropDuplicates([mark])
    return alone.select(*df.columns).union(repeated.select(*df.columns))


def _small_pairs(shared: DataFrame) -> DataFrame:
    """The distinct pairs (a, b), a below b, of nodes with a key in common, of groups of SMALL nodes at most."""
    groups = shared.groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    after = F.transform("nodes", lambda x, i: F.transform(
        F.slice("nodes", i + 2, F.lit(SMALL)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    return groups.select(F.explode(F.flatten(after)).alias("pair")).select("pair.a", "pair.b").distinct()


def _linked(table: DataFrame, docs: DataFrame, sketched: DataFrame, layouts: Layouts, k: int, percent: int) -> DataFrame:
    """(node, root) of all nodes that are linked with another."""
    shown = _shown_words(docs, layouts, k)
    group = Window.partitionBy("key")
    shown = shown.select("key", "node", F.min("node").over(group).alias("low"), F.max("node").over(group).alias("high"))
    # still together by key: no more shuffles for these
    shared = shown.where("low < high").select("key", "node").distinct().withColumn("rows", F.count("*").over(group))
    shared = written(shared, "join-shared")
    nodes = table.where("sketch is not null").drop("doc").join(shared.select("node").distinct(), "node", "left_semi")
    nodes = written(nodes.dropDuplicates(["node"]), "join-nodes")
    large = shared.where(F.col("rows") > SMALL)
    brief = nodes.select("node", "n", "brief")
    first = large.drop("rows").where(F.pmod(F.shiftright("key", 1), F.lit(FIRST)) == 0).join(brief, "node").withColumn("component", F.col("node"))
    pairs = _near(_small_pairs(shared.where(F.col("rows") <= SMALL)), nodes, layouts)
    pairs = pairs.union(_candidates(first, layouts)).distinct()
    links = written(_verified(pairs, docs, sketched, k, percent), "join-links")
    labels = components(links)
    named = large.join(labels, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")
    rest = written(_rarest(_mixed(named), nodes.select("node", "even", "odd")), "join-rest")
    near = written(_once(_near_ones(_families(_mixed(rest), FAMILY).join(brief, "node"), layouts)), "join-near")
    more = _links_across(near, nodes, docs, sketched, layouts, k, percent)
    return components(links.union(more))


def _mixed(members: DataFrame) -> DataFrame:
    """The members (key, node, component, ...) of groups of more than one component."""
    mixed = members.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("h")).where("l < h").select("key")
    return members.join(mixed, "key", "left_semi")


def _rarest(members: DataFrame, needs: DataFrame) -> DataFrame:
    """Of the groups (key, rows) of each node under a layout the rarest: all but as many as it shares with a linked node, less one.

    Two nodes that share so many groups share one that is among the rarest of both.
    """
    of_node = Window.partitionBy("node", "layout")
    members = members.withColumn("layout", F.col("key").bitwiseAND(1)).join(needs, "node")
    need = F.when(F.col("layout") == 0, F.col("even")).otherwise(F.col("odd"))
    members = members.withColumns({"place": F.row_number().over(of_node.orderBy("rows", "key")), "all": F.count("*").over(of_node)})
    return members.where(F.col("place") <= F.col("all") - need + 1).select("key", "node", "component")
