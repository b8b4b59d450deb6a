"""Language-model scores: a log-bilinear model over word classes, trained by noise-contrastive estimation.

A word's probability is that of its class after the words before it, times that of the word in its class.
The most frequent words are classes of their own; the others are classed by their last letters. The class
model is log-bilinear: the vectors of the words before, each weighted by its distance, predict the vector
of the class. It is trained in numpy: first on a sample in one task, then from there on all training
documents, dealt into shards by a hash; the mean of the shards' parameters, weighted by their tokens, is
the model. For scoring, batched matrix products give the scores of all classes, which are normalised.

Word counts are those of all training documents. The counts of the most frequent HEAVY words go to every
task; rarer words meet their counts in a join. So no word, however frequent, is a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aislekit.llm.base import LOWER, Words, chunks, map_arrow, mix, remainder
from aislekit.session import written

#: Words whose counts go to every task; classes of one word; classes by last letters.
HEAVY, SINGLE, ENDINGS = 1 << 18, 191, 320
CLASSES = 1 + SINGLE + ENDINGS  # class 0 is the end of a text
#: Dimensions of a vector, words before that are looked at, noise words of a batch, tokens of a batch.
DIM, CONTEXT, NOISE, BATCH = 16, 5, 64, 2048
#: Documents of the first training, about, and learning rates of both.
SAMPLE, RATES = 4000, (0.2, 0.05)
ADD = 0.1
SEED = 42
END = np.int64(-0x61C8864680B583EB)  # stands for the end of a text among word hashes
_CHUNK = 2 << 20
#: Tokens whose scores of all classes are made at once: they stay in a core's cache.
_SCORED = 512
#: The ending class of each pair of last bytes (the last one times 256, plus the one before it), and the places of a row's numbers.
_ENDING = (mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64)) % np.uint64(ENDINGS)).astype(np.int64)
_PLACES = np.arange((CLASSES + 1) * DIM).reshape(CLASSES + 1, DIM)
#: Texts of a training shard, and their words that are taken at once; parts of 1 in which parameters are added up.
SHARD, _STEP, _WHOLE = 8192, 1 << 18, 1 << 24


def tokens(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, their hashes as Spark longs, and their ending class (numbered from 0)."""
    words = Words(column)
    hashes = words.hashes().view(np.int64)
    if len(words.end) == 0:
        return words, hashes, np.zeros(0, np.int64)
    last = LOWER[words.data[words.end - 1]].astype(np.int64)
    before = np.where(words.end - words.start > 1, LOWER[words.data[np.maximum(words.end - 2, 0)]], 0)
    return words, hashes, _ENDING[last * 256 + before]


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, ending, c) of all words of the texts (t); `END`, of no ending, is counted once a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(0), _CHUNK):
                _, hashes, ending = tokens(batch.column(0)[a:b])
                h, at, c = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(h, END)), pa.array(np.append(ending[at], -1), pa.int32()), pa.array(np.append(c, b - a), pa.int64())],
                    names=["h", "ending", "c"])

    return map_arrow(docs.select("t"), run, "h bigint, ending int, c bigint").groupBy("h", "ending").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Counts of the heavy words, classes, and the totals of each class."""

    def __init__(self, counts: DataFrame):
        self.n, self.types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        # the least level of counts that HEAVY words at most reach, from a table of levels: no sorting of words
        level = F.when(F.col("c") < 4096, F.col("c")).otherwise(4096 + F.floor((F.log2("c") - 12) * 64)).cast("int")
        levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()  # some thousands of rows
        fits = np.cumsum([r["words"] for r in levels]) <= HEAVY
        least = min((r["level"] for r, ok in zip(levels, fits) if ok), default=1 << 30)
        heavy = counts.where(level >= least).toArrow()  # HEAVY rows at most
        h, c = np.asarray(heavy.column("h")), np.asarray(heavy.column("c"), np.int64)
        words = h[np.lexsort((h, -c))]
        self.single = np.sort(words[words != END][:SINGLE])
        order = np.argsort(h)
        self.heavy, self.counts = h[order], c[order]
        rest = counts.where(F.col("h") != int(END)).join(F.broadcast(counts.sparkSession.createDataFrame([(int(x),) for x in self.single], "h bigint")), "h", "left_anti")
        self.class_words = np.zeros(ENDINGS)  # known words of an ending class, and their tokens
        self.class_tokens = np.zeros(ENDINGS)
        for r in rest.groupBy("ending").agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect():  # ENDINGS rows at most
            self.class_words[r["ending"]], self.class_tokens[r["ending"]] = r["v"], r["n"]
        share = np.full(CLASSES, 1.0)
        share[0] += self.count(np.array([END]))[0]
        share[1:1 + len(self.single)] += self.count(self.single)
        share[1 + SINGLE:] += self.class_tokens
        self.noise = share / share.sum()

    def count(self, h: np.ndarray) -> np.ndarray:
        """Counts of heavy words; 0 for others."""
        if len(self.heavy) == 0:
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.heavy, h), len(self.heavy) - 1)
        return np.where(self.heavy[at] == h, self.counts[at], 0)

    def classes(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        if len(self.single) == 0:
            return 1 + SINGLE + ending
        at = np.minimum(np.searchsorted(self.single, h), len(self.single) - 1)
        return np.where(self.single[at] == h, 1 + at, 1 + SINGLE + ending)


def sequences(count: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, context classes, row) of every token of rows of `count` words, the end of each row's text after its words;
    CLASSES: before the text."""
    rows = len(count)
    size = count + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(begin[-1], np.int64)
    row = np.repeat(np.arange(rows), size)
    place = np.arange(len(out)) - begin[row]
    out[place < count[row]] = classes
    context = np.full((len(out), CONTEXT), CLASSES, np.int64)
    for d in range(1, CONTEXT + 1):
        ok = np.flatnonzero(place >= d)
        context[ok, d - 1] = out[ok - d]
    return out, context, row


class Bilinear:
    """Parameters as one vector: context vectors, their weights by distance, class vectors, class biases; and the
    sums of squared gradients that set each one's learning rate."""

    SHAPES = ((CLASSES + 1, DIM), (CONTEXT, DIM), (CLASSES, DIM), (CLASSES,))

    def __init__(self, noise: np.ndarray, values: np.ndarray | None = None, squares: np.ndarray | None = None):
        self.noise = noise
        total = sum(int(np.prod(s)) for s in self.SHAPES)
        rng = np.random.default_rng(SEED)
        self.values = rng.normal(0, 0.1, total).astype(np.float32) if values is None else values.astype(np.float32)
        self.squares = np.full(total, 1e-3, np.float32) if squares is None else squares.astype(np.float32)
        self.before, self.weight, self.after, self.bias = self._parts(self.values)
        if values is None:
            self.weight[:] = 1
            self.bias[:] = np.log(noise)

    @classmethod
    def _parts(cls, x: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for s in cls.SHAPES:
            size = int(np.prod(s))
            out.append(x[at:at + size].reshape(s))
            at += size
        return out

    def weighted(self) -> list[np.ndarray]:
        """The context vectors as they count at each distance."""
        return [self.before * w for w in self.weight]

    @staticmethod
    def predicted(weighted: list[np.ndarray], context: np.ndarray) -> np.ndarray:
        out = weighted[0].take(context[:, 0], 0)
        for d in range(1, CONTEXT):
            out += weighted[d].take(context[:, d], 0)
        return out

    def learn(self, classes: np.ndarray, context: np.ndarray, rate: float, rng: np.random.Generator) -> None:
        """One step on a batch: tell its classes from noise classes that the whole batch shares."""
        k = min(NOISE, 4 * len(classes))
        noise = np.searchsorted(np.cumsum(self.noise), rng.random(k) * 0.999999)
        at = np.ascontiguousarray(context.T)
        vectors = [self.before.take(a, 0) for a in at]
        q = sum(v * w for v, w in zip(vectors, self.weight))
        offset = self.bias - np.log(k * self.noise).astype(np.float32)
        target = self.after.take(classes, 0)
        own = (q * target).sum(1) + offset[classes]
        others = q @ self.after[noise].T
        others += offset[noise]
        g_own = 1 / (1 + np.exp(np.clip(own, -30, 30)))  # towards 1
        np.clip(others, -30, 30, out=others)
        np.negative(others, out=others)
        np.exp(others, out=others)
        others += 1
        g_noise = np.divide(-1, others, out=others)  # towards 0
        g_q = g_own[:, None] * target + g_noise @ self.after[noise]
        gradient = np.zeros_like(self.values)
        before, weight, after, bias = self._parts(gradient)
        after += _scatter(classes, g_own[:, None] * q, CLASSES)
        np.add.at(after, noise, g_noise.T @ q)
        bias += np.bincount(classes, g_own, CLASSES)
        np.add.at(bias, noise, g_noise.sum(0))
        for d in range(CONTEXT):
            weight[d] = (vectors[d] * g_q).sum(0)
            before += _scatter(at[d], g_q * self.weight[d], CLASSES + 1)
        gradient /= len(classes)
        self.squares += gradient * gradient
        self.values += rate * gradient / np.sqrt(self.squares)

    def train(self, classes: np.ndarray, context: np.ndarray, rate: float, rng: np.random.Generator) -> None:
        order = rng.permutation(len(classes))
        for at in range(0, len(order), BATCH):
            some = order[at:at + BATCH]
            self.learn(classes.take(some), context.take(some, 0), rate, rng)

    def log10(self, classes: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each token's class."""
        out = np.empty(len(classes))
        after = np.ascontiguousarray(np.concatenate([self.after, self.bias[:, None]], 1).T)  # the bias as one more dimension
        weighted, ones = self.weighted(), np.ones(CLASSES, np.float32)
        longest, highest = float(np.sqrt((self.after ** 2).sum(1)).max()), float(np.abs(self.bias).max())
        most = min(_SCORED, len(classes))
        vectors, space, first = np.ones((most, DIM + 1), np.float32), np.empty((most, CLASSES), np.float32), np.arange(most) * CLASSES
        for at in range(0, len(classes), _SCORED):
            here = classes[at:at + _SCORED]
            q, scores, top = vectors[:len(here)], space[:len(here)], np.float32(0)
            q[:, :DIM] = self.predicted(weighted, context[at:at + _SCORED])
            # scores that no exponential can overflow or lose need no maximum taken off first
            far = float(np.sqrt(np.einsum("ij,ij->i", q, q).max() - 1)) * longest + highest > 60
            np.matmul(q, after, out=scores)
            own = scores.ravel().take(first[:len(here)] + here)
            if far:
                top = scores.max(1)
                scores -= top[:, None]
            np.exp(scores, out=scores)
            out[at:at + _SCORED] = own - top - np.log(scores @ ones)
        return out / np.log(10)


def _scatter(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by number."""
    return np.bincount(_PLACES.take(at, 0).ravel(), rows.ravel(), n * DIM).reshape(n, DIM)


def _class_sequences(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(mark, classes) of the texts (t, mark): the classes of their words, two bytes each. A task shows equal rows once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b in chunks(batch.column(1), _CHUNK):
                words, h, ending = tokens(batch.column(1)[a:b])
                classes = vocabulary.classes(h, ending).astype(np.int16)
                marks = batch.column(0)[a:b].to_pylist()
                new = [r for r, m in enumerate(marks) if not (m in seen or seen.add(m))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([marks[r] for r in new], pa.int64()), pa.array([classes[words.first[r]:words.first[r + 1]].tobytes() for r in new], pa.binary())],
                    names=["mark", "classes"])

    return map_arrow(docs.select("mark", "t"), run, "mark bigint, classes binary")


def _in_order(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(classes, contexts) of the texts of a shard, each row once, in the order of their marks, some texts at a time."""
    marks, order = np.unique(np.asarray(table.column("mark")), return_index=True)
    rows = [np.frombuffer(x, np.int16) for x in table.column("classes").take(pa.array(order)).to_pylist()]
    size = np.array([len(r) for r in rows], np.int64)
    part = np.cumsum(size) // _STEP
    for p in np.unique(part).tolist():
        at = np.flatnonzero(part == p)
        yield sequences(size[at], np.concatenate([rows[i] for i in at]).astype(np.int64))[:2]


def _trained(docs: DataFrame, vocabulary: Vocabulary) -> Bilinear:
    """The class model of the training texts (t, with mark, a hash of the row).

    Texts are dealt into shards by their marks and trained on in the order of these, and the shards' parameters are added
    up as whole numbers: the model does not depend on partitions. Equal rows are trained on once.
    """
    total = docs.count()
    share, shards = SAMPLE / max(1, total), max(1, -(-total // SHARD))
    dealt = written(_class_sequences(docs, vocabulary), "lm-classes")
    first = dealt if share >= 1 else dealt.where(F.pmod("mark", F.lit(1 << 30)) < int(share * (1 << 30)))

    def start(table: pa.Table) -> pa.Table:
        model, rng = Bilinear(vocabulary.noise), np.random.default_rng(SEED)
        for _ in range(2):
            for classes, context in _in_order(table):
                model.train(classes, context, RATES[0], rng)
        return pa.table({"values": [model.values.tobytes()], "squares": [model.squares.tobytes()]})

    rows = first.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(start, "values binary, squares binary").collect()
    if not rows:
        return Bilinear(vocabulary.noise)
    values, squares = (np.frombuffer(bytes(rows[0][c]), np.float32).copy() for c in ("values", "squares"))

    def run(table: pa.Table) -> pa.Table:
        model, rng, seen = Bilinear(vocabulary.noise, values.copy(), squares.copy()), np.random.default_rng(SEED), 0
        for classes, context in _in_order(table):
            model.train(classes, context, RATES[1], rng)
            seen += len(classes)
        n = len(model.values)
        return pa.table({"i": pa.array(np.arange(n), pa.int32()), "v": pa.array(np.rint(model.values.astype(np.float64) * _WHOLE).astype(np.int64)),
                         "n": pa.array(np.full(n, seen), pa.int64())})

    dealt = dealt.withColumn("shard", F.pmod(F.shiftright("mark", 31), F.lit(shards)))
    weight = F.col("n").cast("decimal(38,0)")
    parts = dealt.groupBy("shard").applyInArrow(run, "i int, v bigint, n bigint").groupBy("i").agg(
        (F.sum(F.col("v") * weight).cast("double") / F.sum(weight).cast("double") / F.lit(float(_WHOLE))).alias("v"))
    means = parts.orderBy("i").toArrow()  # one number for each parameter
    return Bilinear(vocabulary.noise, np.asarray(means.column("v")), squares)


def score_texts(df: DataFrame, key: str = "doc_id", text: str = "text", fold: int = 10) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Rows whose crc32 of the key as text modulo `fold` is 0 are held out of all training. Tokens are words, A-Z
    in lower case, and an end; null and empty texts are the end alone. Words that training does not know share
    one unknown word (in `score`, one for each ending class). Repeated rows are rows of their own; other columns
    are not looked at; an empty table gives an empty one.
    """
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("k"), F.col(text).alias("t"), (remainder(key, fold) == 0).alias("held"))
    known = docs.where(~F.col("held")).select("t", F.xxhash64(F.lit(SEED), "k", "t").alias("mark"))
    counts = written(word_counts(known), "lm-counts")
    vocabulary = Vocabulary(counts)
    model = _trained(known, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.log10(vocabulary.class_tokens + ADD * (vocabulary.class_words + 1))
        whole = len(vocabulary.heavy) == vocabulary.types  # then words that are not heavy are unknown
        for batch in batches:
            for a, b in chunks(batch.column(1), _CHUNK):
                words, h, ending = tokens(batch.column(1)[a:b])
                uniq, at, number = np.unique(h, return_index=True, return_inverse=True)
                c = vocabulary.count(uniq)
                single = vocabulary.classes(uniq, ending[at])
                log_c = np.log10(c + ADD)[number]
                rare = (c == 0)[number] & (not whole)
                log_c[rare] = 0
                n = b - a
                end = vocabulary.count(np.array([END]))[0]
                base = np.bincount(words.row, log_c, n) + np.log10(end + ADD)
                hits = np.bincount(words.row, (c > 0)[number], n).astype(np.int64) + int(end > 0)
                classes, context, row = sequences(words.count, single[number])
                by_class = np.bincount(row, model.log10(classes, context), n)
                tail = single[number] > SINGLE
                in_class = np.bincount(words.row[tail], (log_c - below[ending])[tail], n)
                rows, hashes = words.row[rare], h[rare]
                order = np.lexsort((hashes, rows))
                rows, hashes = rows[order], hashes[order]
                new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])]) if len(rows) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(rows)))
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows[first], minlength=n))]), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[a:b], batch.column(2)[a:b], pa.array(words.count + 1, pa.int64()), pa.array(hits), pa.array(base), pa.array(by_class + in_class),
                    pa.ListArray.from_arrays(ends, pa.array(hashes[first], pa.int64())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))],
                    names=["k", "held", "n", "known", "base", "score", "words", "times"])

    schema = f"k {kind}, held boolean, n bigint, known bigint, base double, score double, words array<bigint>, times array<int>"
    scored = written(map_arrow(docs.select("k", "t", "held"), run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("h"), F.col("w.times").alias("times"))
    met = rare.join(counts.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = met.groupBy("row").agg(
        F.sum(F.log10(F.col("c") + ADD) * F.col("times")).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("hits"))
    out = scored.drop("words", "times").join(sums, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    total = float(np.log10(vocabulary.n + ADD * (vocabulary.types + 1)))
    return out.select(
        F.col("k").alias(key), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("hits", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.n).cast("bigint").alias("train_tokens"), (F.col("base") + more - F.col("n") * total).alias("base_score"), (F.col("score") + more).alias("score"))
