"""Mixing sources to target weights, in DataFrame operations alone.

The words of each source, document after document, are packed into blocks of fixed length: 64 words, or a 32nd
of the target where that is less. Output shards of fixed size hold one block a slot, and a source has the
number of slots whose words come nearest to its target, its last, shorter block counted as what it holds. Source
counts are drawn shard by shard without going over that number: multinomial draws given their sum. Slot i of the source, counted after the slots of the sources before it, stands where a pseudorandom permutation of all slots puts it. Slot r of a source
takes block p(r mod number of blocks), p being a pseudorandom permutation of that source's blocks, so
no block is taken a second time before all are taken once. Slots and blocks meet in a join by index.

Permutations are swap-or-not shuffles: in each round an index and its mirror under the round's key
either swap or stay, by a hash of the greater one. They need no table, work for any length, and run
backwards by taking the keys in reverse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from aislekit.session import written

SEED = 42
#: Words of a block at most, blocks of a target at least, and slots of an output shard.
BLOCK, PARTS, SHARD = 64, 32, 4096
#: Rounds of a permutation.
ROUNDS = 16
#: Buckets of a source in which its documents are put in order.
BUCKETS = 1024
#: Slots that a source's row is unfolded into at once.
_STRIDE = 8192
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def permuted(index: Column, n: Column, keys: Column) -> Column:
    """The place of `index` in a permutation of 0 … n-1; with the keys in reverse, the inverse."""
    def swap(x: Column, key: Column) -> Column:
        mirror = F.pmod(key - x, n)
        return F.when(F.xxhash64(key, F.greatest(x, mirror)).bitwiseAND(1) == 1, mirror).otherwise(x)

    return F.aggregate(keys, index, swap)


def _keys(n: Column, *of: Column) -> Column:
    """Round keys of a permutation of 0 … n-1."""
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.transform(rounds, lambda r: F.pmod(F.xxhash64(*of, r), F.greatest(n, F.lit(1).cast("bigint"))))


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_no, source_size, target) with one row per source.

    Sources in code point order, null last, take the weights in turn. The targets are the level w·weight
    cut off at `most` times the size, where the level meets `share` of all words: the first source in the
    order of cap per weight that the level of the rest does not exceed gives it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source, as below
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("source_no", F.row_number().over(order) - 1)
    each = F.array(*[F.lit(float(w)) for w in weights])
    rows = rows.withColumn("weight", F.element_at(each, F.pmod(F.col("source_no"), F.lit(len(weights))) + 1))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    goal = F.sum("source_size").over(every) * F.lit(float(share))
    rows = rows.withColumn("level", (goal - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    rows = rows.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"])
    return rows.select("source", "source_no", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def block_length(target: Column, block: int) -> Column:
    """The words of a block of a source with this target."""
    return F.greatest(F.lit(1), F.least(F.lit(block), F.floor(target / PARTS))).cast("bigint")


def pieces(placed: DataFrame, block: int) -> DataFrame:
    """(source_no, block, doc, piece_from, piece_words): the part of a document in each block it reaches."""
    placed = placed.where("size > 0").withColumn("long", block_length(F.col("target"), block))
    first, last = F.expr("start div long"), F.expr("(start + size - 1) div long")
    spread = placed.select("source_no", "doc", "start", "size", "long", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * F.col("long"))
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("long"))
    return spread.select("source_no", "block", "doc", (begin - F.col("start")).alias("piece_from"), (end - begin).alias("piece_words"))


def slot_counts(targets: DataFrame, block: int, seed: int) -> DataFrame:
    """The targets with their blocks and `n`, the number of slots whose words come nearest to the target.

    After whole passes over the source, the first blocks of its permutation are taken; where the last, shorter
    block stands in it decides what a number of them holds.
    """
    rows = targets.where("source_size > 0").withColumn("long", block_length(F.col("target"), block))
    rows = rows.withColumn("blocks", F.expr("(source_size + long - 1) div long"))
    rows = rows.withColumns({
        "passes": F.floor(F.col("target") / F.col("source_size")), "lacking": F.expr("blocks * long - source_size"),
        "shorter": permuted(F.col("blocks") - 1, F.col("blocks"), F.reverse(_keys(F.col("blocks"), F.lit(seed), F.col("source_no"))))})
    left = F.col("target") - F.col("passes") * F.col("source_size")

    def held(n: Column) -> Column:
        return n * F.col("long") - F.when(F.col("shorter") < n, F.col("lacking")).otherwise(F.lit(0))

    first = F.floor(left / F.col("long"))
    tried = F.transform(F.sequence(first, first + 2), lambda n: F.least(n, F.col("blocks")))
    best = F.array_min(F.transform(tried, lambda n: F.struct(F.abs(held(n) - left).alias("off"), n.alias("n"))))["n"]
    return rows.withColumn("n", (F.col("passes") * F.col("blocks") + best).cast("bigint"))


def slots(targets: DataFrame, block: int, shard: int, seed: int) -> DataFrame:
    """(source_no, block, epoch, shard, slot): what each slot of the output holds."""
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = slot_counts(targets, block, seed).select("source_no", "n", "blocks")
    rows = rows.withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)), "all": F.sum("n").over(every)}).where("n > 0")
    rows = rows.withColumn("from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(_STRIDE).cast("bigint"))))
    # few rows that unfold into many: a fixed number of tasks, since their size now says nothing
    rows = rows.repartition(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_no", "from")
    rows = rows.withColumns({
        "own": _keys(F.col("blocks"), F.lit(seed), F.col("source_no")),
        "shared": F.reverse(_keys(F.col("all"), F.lit(seed), F.lit("all"))),
        "r": F.sequence(F.col("from"), F.least(F.col("from") + _STRIDE, F.col("n")) - 1),
    })
    rows = rows.withColumn("r", F.explode("r"))
    place = permuted(F.col("base") + F.col("r"), F.col("all"), F.col("shared"))
    rows = rows.select(
        "source_no", permuted(F.pmod("r", "blocks"), F.col("blocks"), F.col("own")).alias("block"),
        F.expr("r div blocks").alias("epoch"), place.alias("place"))
    return rows.select("source_no", "block", "epoch", F.expr(f"place div {shard}").alias("shard"), F.pmod("place", F.lit(shard)).alias("slot"))


class Mixture:
    """The tables of one mix. `documents`: doc, key, source_no, source_size, target, size, start, h (one row per
    row of the input); `pieces` and `slots` as above."""

    def __init__(self, df: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
                 key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shard: int = SHARD, seed: int = SEED):
        """Sizes are words; a null text has none and is not taken. Null keys and sources are values like others.
        Repeated rows are rows of their own. Other columns are not looked at. An empty table mixes to nothing."""
        sized = df.select(
            F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("h"))
        sized = written(sized, "mix-sizes")
        self.targets = written(source_targets(sized, weights, share, most), "mix-targets")
        narrow = self.targets.withColumnRenamed("source", "named")
        # a hot source is spread over buckets of its documents; each bucket starts after those before it
        numbered = sized.join(narrow, F.col("source").eqNullSafe(F.col("named"))).drop("source", "named")
        numbered = numbered.withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(BUCKETS)))
        totals = numbered.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        ahead = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select("source_no", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("words"))
        inside = Window.partitionBy("source_no", "bucket").orderBy("h", "key", "size")
        so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
        placed = numbered.withColumns({"start": F.coalesce(F.sum("size").over(so_far), F.lit(0)), "nth": F.row_number().over(inside)})
        placed = placed.join(totals, ["source_no", "bucket"]).withColumn("start", F.col("start") + F.col("words"))
        # the place in the order names a row, also among repeated ones
        placed = placed.withColumn("doc", F.struct("source_no", "bucket", "nth"))
        self.documents = written(placed.drop("bucket", "nth", "words"), "mix-documents")
        self.pieces = pieces(self.documents, block)
        self.slots = slots(self.targets, block, shard, seed)

    def taken(self) -> DataFrame:
        """(doc, taken): the words that the mix takes of each document it touches, repeats counted."""
        times = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
        # merge joins: slots are unfolded from a table of a few rows, and Spark would take them for as small
        met = self.pieces.join(times.hint("merge"), ["source_no", "block"])
        return met.groupBy("doc").agg(F.sum(F.col("piece_words") * F.col("times")).alias("taken"))

    def passes(self) -> DataFrame:
        """(doc, passes): for each pass over the source that takes words of a document, their ranges (piece_from,
        piece_words) in order. The passes are as many as `most`, rounded up."""
        met = self.pieces.join(self.slots.select("source_no", "block", "epoch").hint("merge"), ["source_no", "block"])
        parts = met.groupBy("doc", "epoch").agg(F.sort_array(F.collect_list(F.struct("piece_from", "piece_words"))).alias("parts"))
        return parts.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("epoch", "parts"))).alias("passes"))


def mixed_texts(df: DataFrame, mixture: Mixture, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """The rows of `df` as the mix takes them: a row for each pass over its source that takes words of it, with
    the words taken as its text (each with the blanks before it, but none before the first) and all other columns kept.

    Rows are known by a 64-bit hash of key and text. Of repeated rows, which share it, one is read and stands
    for all, as often as the mix takes any of them.
    """
    same = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    h, passes, found = ("__" + "_".join([name, *df.columns]) for name in ("h", "passes", "text"))  # names that df does not have
    once = df.withColumn(h, same).dropDuplicates([h])
    rows = mixture.documents.select("doc", F.col("h").alias(h))
    taken = mixture.passes().hint("merge").join(rows.hint("merge"), "doc").select(h, F.col("passes").alias(passes))
    met = once.join(taken.hint("merge"), h)
    words = F.regexp_extract_all(F.col(text), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))

    def cut(words: Column) -> Column:
        def part(p: Column) -> Column:
            return F.array_join(F.slice(words, (p["piece_from"] + 1).cast("int"), p["piece_words"].cast("int")), "")

        return F.transform(passes, lambda one: F.array_join(F.transform(one["parts"], part), ""))

    # in an array of one, so that a text is taken apart once and not for every part
    texts = F.get(F.transform(F.array(words), cut), F.lit(0))
    met = met.withColumn(found, F.explode(texts))
    return met.withColumn(text, F.regexp_replace(found, r"^[\x20\x09-\x0D]+", "")).select(*df.columns)


def mix_sources(df: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, **names) -> DataFrame:
    """(key, size, source_size, target, taken) for every row; see `Mixture`."""
    mixture = Mixture(df, weights, share, most, **names)
    return mixture.documents.join(mixture.taken().hint("merge"), "doc", "left").select(
        F.col("key").alias(names.get("key", "doc_id")), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"))
