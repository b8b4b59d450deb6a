"""Word tests and Python-like text trimming as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# The blanks of Unicode white space and the four separators, as a class and as a list.
BLANK = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def has_any(text: Column, words: list[str]) -> Column:
    """Whether any word is a substring; the text is expected in lower case."""
    test = text.contains(words[0])
    for word in words[1:]:
        test = test | text.contains(word)
    return test


def minimal(words: list[str]) -> list[str]:
    """The words without those that contain another one: the same substring test, done with less."""
    return [w for w in dict.fromkeys(words) if not any(o != w and o in w for o in words)]


def asks(text: Column, words: list[str]) -> Column:
    """`has_any` on the lower-cased text, false for a missing text."""
    return has_any(F.lower(F.coalesce(text, F.lit(""))), minimal(words))


def strip(text: Column) -> Column:
    """The text without blanks at both ends, Unicode ones included."""
    return F.btrim(text, F.lit(BLANKS))


def squeeze(text: Column) -> Column:
    """The text with every run of blanks as one space."""
    spaced = F.translate(text, BLANKS, " " * len(BLANKS))
    return F.regexp_replace(spaced, " {2,}", " ")


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def number_text(value: Column) -> Column:
    """A double in its shortest form: plain digits from 0.0001 up to 1e16, `1.5e-05` and `1e+16` outside."""
    size, shown = F.abs(value), value.cast("string")
    plain = F.call_function("format_number", value, F.lit("0.0" + "#" * 20))
    power = F.substring_index(shown, "E", -1).try_cast("int")
    exponent = F.concat(
        F.regexp_replace(F.substring_index(shown, "E", 1), r"\.0$", ""), F.when(power < 0, "e-").otherwise("e+"),
        F.when(F.abs(power) < 10, F.concat(F.lit("0"), F.abs(power).cast("string"))).otherwise(F.abs(power).cast("string")),
    )
    return (
        F.when(F.isnan(value), "nan").when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), shown)
        .when((size >= 1e-4) & (size < 1e16), plain).otherwise(exponent)
    )


def literal(text: str) -> str:
    """A text as a pattern that matches just it."""
    return re.sub(r"([^\w\s'])", r"\\\1", text)
