"""Toxicity scores: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

A text's features are the distinct slots of its words, word pairs and pairs with one word between.
Words are runs of letters and digits, A-Z in lower case. FTRL-proximal gives each weight a learning
rate of its own, and an L1 penalty that leaves most weights at zero; the others travel with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aislekit.llm.base import NO_LETTER, Words, chunks, combine, distinct, map_arrow, mix, remainder

#: Slots of the feature hash.
SLOTS = 1 << 20
#: Labelled rows that the model is fitted on, about; of more, a sample by hash of the key.
SAMPLE = 16_000
ALPHA, BETA, L2, EPOCHS = 2.0, 1.0, 1.0, 6
#: L1 penalty over the square root of the number of examples: noise in a sum of gradients grows like that.
L1_NOISE = 0.18
SEED = 42


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the distinct features of each text."""
    parts = []
    for a, b in chunks(texts):
        words = Words(texts[a:b], NO_LETTER)
        h, row = words.hashes(), words.row
        found = [(row, h)]
        for gap, mark in ((1, np.uint64(0x51ED270B0A1F39C1)), (2, np.uint64(0x3C79AC492BA7B653))):
            if len(h) > gap:
                same = row[:-gap] == row[gap:]
                found.append((row[:-gap][same], combine([h[:-gap], h[gap:]])[same] ^ mark))
        rows = np.concatenate([f[0] for f in found])
        slots = mix(np.concatenate([f[1] for f in found])) % np.uint64(SLOTS)
        rows, slots = distinct(rows, slots)
        parts.append((rows + a, slots.astype(np.int64)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def fit(examples: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, bias) of weights that are not zero. Examples come in the order given."""
    z, n, l1 = np.zeros(SLOTS), np.zeros(SLOTS), L1_NOISE * len(examples) ** 0.5
    bias_z = bias_n = 0.0

    def weights(slots: np.ndarray) -> np.ndarray:
        zs = z[slots]
        w = -(zs - np.sign(zs) * l1) / ((BETA + np.sqrt(n[slots])) / ALPHA + L2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    for _ in range(epochs):
        for slots, y in zip(examples, labels):
            w = weights(slots)
            bias = -bias_z / ((BETA + bias_n ** 0.5) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - y
            step = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / ALPHA
            z[slots] += g - step * w
            n[slots] += g * g
            step = ((bias_n + g * g) ** 0.5 - bias_n ** 0.5) / ALPHA
            bias_z += g - step * bias
            bias_n += g * g
    used = np.flatnonzero(np.abs(z) > l1)
    return used, weights(used), -bias_z / ((BETA + bias_n ** 0.5) / ALPHA)


class Model:
    """Sparse weights, and the scores they give."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, bias: float):
        self.slots, self.weights, self.bias = np.asarray(slots, np.int64), np.asarray(weights, np.float64), float(bias)

    def scores(self, texts: pa.Array) -> np.ndarray:
        dense = np.zeros(SLOTS)
        dense[self.slots] = self.weights
        rows, slots = features(texts)
        total = np.bincount(rows, dense[slots], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(self.bias + total, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE,
          fold: int = 5) -> Model:
    """A model of the labelled rows outside the held-out fold (crc32 of the key as text, modulo `fold`, is 0).

    At most about `sample` rows, chosen by a hash of the key; null keys and labels are left out. Of a key
    labelled more than once the greatest label counts, of one with several texts the text of the lowest hash, so a
    key that many rows share is one example. Without any labelled row nothing is toxic: all scores are near 0.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null")
    known = known.where(remainder("k", fold) != 0).groupBy("k").agg(F.max("y").alias("y"))
    share = sample / max(1, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64(F.lit(SEED), "k"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # a sample of bounded size: small enough to go to every task
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(known), "k")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = features(batch.column(1))
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2), batch.column(3)], names=["h", "slots", "y", "th"])

    encoded = map_arrow(rows.select(F.xxhash64(F.lit(SEED), "k").alias("h"), "t", "y", F.xxhash64("t").alias("th")), slots, "h bigint, slots array<int>, y int, th bigint")
    encoded = encoded.groupBy("h").agg(F.min_by(F.struct("slots", "y"), "th").alias("one")).select("h", "one.slots", "one.y")

    def fitted(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table.column("h")), kind="stable")
        column = pa.concat_arrays(table.column("slots").chunks)
        ends = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(column)))])
        flat = np.asarray(column.flatten())
        used, weights, bias = fit([flat[ends[i]:ends[i + 1]] for i in order], np.asarray(table.column("y"))[order])
        return pa.table({"slots": pa.array([used.tolist()], pa.list_(pa.int32())), "weights": pa.array([weights.tolist()], pa.list_(pa.float64())), "bias": [bias]})

    found = encoded.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(fitted, "slots array<int>, weights array<double>, bias double").collect()
    return Model(found[0]["slots"], found[0]["weights"], found[0]["bias"]) if found else Model(np.zeros(0), np.zeros(0), -35.0)


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", fold: int = 5) -> DataFrame:
    """(key, held_out, score, predicted) for every row; null and empty texts get the score of no features."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)))], names=["k", "score"])

    scored = map_arrow(df.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"k {kind}, score double")
    return scored.select(
        F.col("k").alias(key), (remainder("k", fold) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(df: DataFrame, model: Model, text: str = "text", most: float = 0.5) -> DataFrame:
    """The rows of `df`, all columns, whose text scores below `most`."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = model.scores(batch.column(names.index(text))) < most
            yield batch.filter(pa.array(keep))

    return map_arrow(df, run, df.schema)
