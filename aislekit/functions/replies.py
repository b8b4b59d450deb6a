"""Clean-up of recorded replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from aislekit import vocabulary as V
from aislekit.functions.draws import let
from aislekit.functions.text import BLANK, BLANKS, has_any, literal, squeeze, strip


def _one_of(texts: list[str]) -> str:
    return "|".join(literal(t) for t in texts)


def _remove(text: Column, patterns: list[str]) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, "")
    return text


# Patterns on whole words and sentences.
_ECHO = rf"(?s)Available products:{BLANK}*\[.*?\]{BLANK}*"
_SENTENCES = [
    rf"(?iU)(?:{_one_of(V.FILLER_OPENINGS)})[^.?!]*[.?!]?",
    *[rf"(?iU){literal(opening)}[^.]*\.?" for opening in V.FILLER_SENTENCES],
    V.FINISHED_PATTERN,
]
_DANGLING = rf"(?iU)\b(?:{_one_of(V.DANGLING_WORDS)})\z"


def _caseless(text: Column) -> Column:
    """The text with all case variants of a letter made equal."""
    return F.lower(F.upper(text))


def clean_reply(reply: Column) -> Column:
    """A reply without stop marks, special tokens, echoed products and filler sentences.

    Most replies hold none of these. So each slow pattern is tried only where a plain search
    finds what it needs.
    """
    def without_mark(mark: str):
        return lambda t: F.when(
            t.endswith(mark), F.rtrim(F.left(t, F.length(t) - len(mark)), F.lit(BLANKS))
        ).otherwise(t)

    def without_tokens(t: Column) -> Column:
        return F.when(t.contains("|"), _remove(t, V.TOKEN_PATTERNS)).otherwise(t)

    def without(patterns: list[str], words: list[str]):
        return lambda t: F.when(asks_caseless(t, words), _remove(t, patterns)).otherwise(t)

    def asks_caseless(t: Column, words: list[str]) -> Column:
        return let(_caseless(t), lambda low: has_any(low, words))

    def without_echo(t: Column) -> Column:
        return F.when(t.contains("Available products:"), F.regexp_replace(t, _ECHO, "")).otherwise(t)

    def without_dangling(t: Column) -> Column:
        end = _caseless(F.right(t, F.lit(5)))
        ends = reduce(lambda a, b: a | b, [end.endswith(w.lower()) for w in V.DANGLING_WORDS])
        return F.when(ends, F.regexp_replace(t, _DANGLING, "")).otherwise(t)

    fillers = [w.lower() for w in (*V.FILLER_OPENINGS, *V.FILLER_SENTENCES, "finished")]
    steps = [
        *[without_mark(mark) for mark in V.STOP_MARKS],
        without_tokens,
        without([V.STOP_PATTERN], ["stop"]),
        lambda t: F.translate(t, "|", " "),
        without_echo,
        without(_SENTENCES, fillers),
        lambda t: F.rtrim(t, F.lit(BLANKS)),
        without_dangling,
    ]
    text = strip(F.coalesce(reply, F.lit("")))
    for step in steps:
        text = let(text, step)
    return strip(squeeze(text))


def strip_tool_tags(text: Column) -> Column:
    """The text without `[TOOL:…]` marks."""
    return strip(F.regexp_replace(text, r"\[TOOL:[^\]]*\]", ""))
