"""Seeded draws that do not depend on partitioning.

A draw is the md5 text of `seed:salt:key…`. It is a pure function of the row, so a task
that is run again on another executor makes the same choice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_RANGE = 4294967296.0  # values of eight hexadecimal digits


def digest(seed: int, salt: str, *keys: Column) -> Column:
    """The 32 hexadecimal digits drawn for the keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), *[k.cast("string") for k in keys]))


def unit(drawn: Column) -> Column:
    """The digest as a number in [0, 1)."""
    return F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") / F.lit(_RANGE)


def uniform(drawn: Column, low: float, high: float) -> Column:
    return F.lit(float(low)) + F.lit(float(high) - float(low)) * unit(drawn)


def index(drawn: Column, size: Column) -> Column:
    """A uniform index 0 … size-1."""
    return F.floor(unit(drawn) * size).cast("int")


def pick(values: Column, drawn: Column) -> Column:
    """One element of an array, null if it is empty."""
    return F.get(values, index(drawn, F.size(values)))


def choose(options: list[str], drawn: Column) -> Column:
    """One of a fixed list of texts."""
    return pick(F.array(*[F.lit(o) for o in options]), drawn)


def shuffled(values: Column, seed: int, salt: str, *keys: Column) -> Column:
    """The array in random order."""
    tagged = F.transform(
        values, lambda v, i: F.struct(digest(seed, salt, *keys, i).alias("order"), v.alias("value"))
    )
    return F.transform(F.array_sort(tagged), lambda t: t["value"])


def distinct_positions(size: Column, k: int, seed: int, salt: str, *keys: Column) -> Column:
    """k distinct positions out of 1 … size, each subset equally likely; size must be ≥ k.

    Robert Floyd's sampling: k steps however large `size` is, where hashing every
    position would cost the size of the group for every draw.
    """
    lasts = [size.cast("bigint") - (k - i) for i in range(1, k + 1)]
    # Drawn outside the fold, where the draws are compiled code.
    guesses = F.array(*[
        F.struct(last.alias("last"), (F.floor(unit(digest(seed, salt, *keys, F.lit(i))) * last) + 1).alias("guess"))
        for i, last in enumerate(lasts, 1)
    ])

    def step(chosen: Column, g: Column) -> Column:
        taken = F.array_contains(chosen, g["guess"])
        return F.concat(chosen, F.array(F.when(taken, g["last"]).otherwise(g["guess"])))

    return F.aggregate(guesses, F.array().cast("array<bigint>"), step)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, also inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
