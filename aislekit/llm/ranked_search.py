"""Ranked lexical search: the best documents of every item, by groups of documents that hold the same of its terms.

Documents are dealt into blocks where they are read, and only their occurrences of terms that some item asks
for leave the task. A block meets the items of a batch in one task. There the documents of an item are grouped
by presence masks, one bit a term: bits are set term by term from the term's documents, and equal masks
are one group. No document of a group scores more than the sum of its terms' weights times their highest
saturation in the block, so groups are evaluated by falling bound until the k-th score found is above all
bounds left. The best k of all blocks are ranked once more.

Terms are known by a 64-bit hash of their bytes. Weights and scores are those of the contract, in 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from aislekit.llm.base import NO_LETTER, Words, chunks, map_arrow, signed
from aislekit.session import written

#: Documents, and bytes of text, of a block; a longer text is a block of its own.
BLOCK_DOCS, BLOCK_BYTES = 8192, 32 << 20
#: Items that meet a block in one task.
BATCH_ITEMS = 1024
#: Stands for a document itself among its terms.
_DOCUMENT = 0


def counted_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the distinct terms of each row, and the number of terms of every row with repeats."""
    words = Words(column, NO_LETTER)
    hashes = words.hashes()
    hashes[hashes == _DOCUMENT] = 1
    order = np.lexsort((hashes, words.row))
    row, term = words.row[order], hashes[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(first)
    return row[at], term[at], np.diff(np.append(at, len(row))), words.count


def _occurrences(docs: DataFrame) -> DataFrame:
    """(block, doc, id, term, tf) of all documents (id, text); the row of a document itself has its number of terms as tf."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, docs_in, bytes_in = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in chunks(texts):
                size = texts[a:b].nbytes
                if docs_in and (docs_in + b - a > BLOCK_DOCS or bytes_in + size > BLOCK_BYTES):
                    block, docs_in, bytes_in = block + 1, 0, 0
                row, term, tf, n = counted_terms(texts[a:b])
                own = np.flatnonzero(n)
                doc = np.concatenate([own, row]) + docs_in
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(doc), block, np.int64)), pa.array(doc, pa.int32()),
                    pa.concat_arrays([ids[a:b].take(pa.array(own)), pa.nulls(len(row), ids.type)]),
                    signed(np.concatenate([np.full(len(own), _DOCUMENT, np.uint64), term])), pa.array(np.concatenate([n[own], tf]), pa.int64()),
                ], names=["block", "doc", "id", "term", "tf"])
                docs_in, bytes_in = docs_in + b - a, bytes_in + size

    return map_arrow(docs, run, f"block bigint, doc int, id {kind}, term bigint, tf bigint")


def _item_terms(items: DataFrame) -> DataFrame:
    """(item, term) of all items (item, text), distinct."""
    kind = items.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                row, term, _, _ = counted_terms(batch.column(1)[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(pa.array(row)), signed(term)], names=["item", "term"])

    return map_arrow(items, run, f"item {kind}, term bigint").distinct()


def presence_masks(held: list[np.ndarray], docs: int) -> np.ndarray:
    """For each document a mask of as many 64-bit words as the terms need; bit j of it tells that the document is in held[j]."""
    masks = np.zeros((docs, max(1, (len(held) + 63) // 64)), np.uint64)
    for j, at in enumerate(held):
        masks[at, j // 64] |= np.uint64(1) << np.uint64(j % 64)
    return masks


def best_of_masks(held: list[np.ndarray], worth: list[np.ndarray], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, score) of the k best documents by score, then id, of those that score above 0.

    held[j] are the documents with term j and worth[j] what the term adds to each. Distinct masks are taken
    by falling bound, twice as many documents every time, until no mask left can reach the k-th score.
    """
    masks = presence_masks(held, len(ids))
    some = np.flatnonzero(masks.any(1))
    best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(some) == 0:
        return best, score
    distinct, group, size = np.unique(masks[some], axis=0, return_inverse=True, return_counts=True)
    bound = np.zeros(len(distinct), np.int64)
    table = np.zeros((len(held), len(ids)), np.int64)
    for j, (at, add) in enumerate(zip(held, worth)):
        table[j, at] = add
        has = (distinct[:, j // 64] >> np.uint64(j % 64) & np.uint64(1)).astype(bool)
        bound[has] += add.max(initial=0)
    falling = np.argsort(-bound, kind="stable")
    place = np.empty(len(falling), np.int64)
    place[falling] = np.arange(len(falling))
    members = some[np.argsort(place[group.reshape(-1)], kind="stable")]
    ends = np.cumsum(size[falling])
    done, start, want = 0, 0, 4 * k
    while done < len(falling) and not (len(best) == k and score[-1] > bound[falling[done]]):
        upto = min(len(falling), max(done + 1, int(np.searchsorted(ends, start + want, "right"))))
        here = members[start:ends[upto - 1]]
        best, score = np.concatenate([best, here]), np.concatenate([score, table[:, here].sum(0)])
        order = np.lexsort((ids[best], -score))
        order = order[score[order] > 0][:k]
        best, score = best[order], score[order]
        done, start, want = upto, int(ends[upto - 1]), want * 2
    return best, score


def _evaluate(k: int, documents: int, terms: int, item_type: pa.DataType, id_type: pa.DataType):
    def run(occurrences: pa.Table, items: pa.Table) -> pa.Table:
        doc, term, tf = (np.asarray(occurrences.column(c)) for c in ("doc", "term", "tf"))
        out_item, out_doc, out_score = [], [], []
        if len(doc) and items.num_rows:
            own = np.flatnonzero(term == _DOCUMENT)
            numbers, first = np.unique(doc[own], return_index=True)
            own = own[first]
            # a null id comes after all others
            names = occurrences.column("id").take(pa.array(own))
            ids = np.asarray(pa.compute.rank(names, sort_keys="ascending", null_placement="at_end", tiebreaker="dense"), np.int64)
            m = 10 + 90 * tf[own] * documents // terms
            held = np.flatnonzero(term != _DOCUMENT)
            held = held[np.argsort(term[held], kind="stable")]
            at = np.searchsorted(numbers, doc[held])
            value = 1_000_000_000 * tf[held] // (1000 * tf[held] + 8 * m[at])
            sorted_terms = term[held]
            keys = items.column("key").to_numpy()
            order = np.argsort(keys, kind="stable")
            asked, weight = items.column("term").to_numpy()[order], items.column("weight").to_numpy()[order]
            low, high = np.searchsorted(sorted_terms, asked, "left"), np.searchsorted(sorted_terms, asked, "right")
            begins = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
            for b, e in zip(begins, np.append(begins[1:], len(keys))):
                spans = [(low[j], high[j], weight[j]) for j in range(b, e) if high[j] > low[j]]
                best, score = best_of_masks([at[x:y] for x, y, _ in spans], [value[x:y] * w for x, y, w in spans], ids, k)
                out_item += [order[b]] * len(best)
                out_doc.append(best)
                out_score.append(score)
        found = np.concatenate(out_doc) if out_doc else np.zeros(0, np.int64)
        return pa.table({
            "item": items.column("item").take(pa.array(out_item, pa.int64())).cast(item_type) if out_item else pa.array([], item_type),
            "doc": names.take(pa.array(found)).cast(id_type) if len(found) else pa.array([], id_type),
            "score": pa.array(np.concatenate(out_score) if out_score else [], pa.int64()),
        })

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, rank, key, score): the k best documents of each item with a score above 0.

    Rows of one item id, null included, are one item with the terms of all of them. Every row of `docs` is a
    document of its own, also if it is repeated; a null or empty text has no terms and is never found. Equal scores
    rank by key, null last. Other columns are not looked at. Without documents or items there are no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    terms = written(_item_terms(items.select(F.col(item).alias("item"), F.col(text).alias("text"))), "search-items")
    batches = max(1, -(-terms.select("item").distinct().count() // BATCH_ITEMS))
    terms = terms.withColumn("batch", F.pmod(F.xxhash64("item"), F.lit(batches)).cast("int"))
    asked = written(terms.select("term").distinct(), "search-terms")
    found = _occurrences(docs.select(F.col(key).alias("id"), F.col(text).alias("text")))
    # one pass: documents themselves stay beside what the items ask for
    both = asked.unionAll(asked.sparkSession.range(_DOCUMENT, _DOCUMENT + 1).select(F.col("id").alias("term")))
    found = written(found.join(both, "term", "left_semi").select(*found.columns), "search-occurrences")
    own = found.where(F.col("term") == _DOCUMENT)
    documents, total = own.agg(F.count("*"), F.coalesce(F.sum("tf"), F.lit(0))).first()
    df = found.where(F.col("term") != _DOCUMENT).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("bigint")
    weighed = written(terms.join(df, "term").select("batch", "item", F.xxhash64("item").alias("key"), "term", weight.alias("weight")), "search-weights")
    in_batch = weighed.select("batch", "term").distinct()
    dealt = found.join(in_batch, "term").select("block", "batch", "doc", "id", "term", "tf")
    pairs = written(dealt.select("block", "batch").distinct(), "search-pairs")
    dealt = dealt.unionByName(own.join(pairs, "block").select("block", "batch", "doc", "id", "term", "tf"))
    meet = _evaluate(k, documents, max(total, 1), to_arrow_type(items.schema[item].dataType), to_arrow_type(docs.schema[key].dataType))
    schema = f"item {items.schema[item].dataType.simpleString()}, doc {docs.schema[key].dataType.simpleString()}, score bigint"
    asking = weighed.join(pairs, "batch").select(*(F.col(c).alias(c) for c in ("block", "batch", "item", "key", "term", "weight")))
    best = dealt.groupBy("block", "batch").cogroup(asking.groupBy("block", "batch")).applyInArrow(meet, schema)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("doc").alias(key), "score")
