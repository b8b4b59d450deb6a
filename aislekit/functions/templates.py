"""Filling one of several fixed templates."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, functions as F

from aislekit.functions.draws import index


def fill(template: str, values: dict[str, Column]) -> Column:
    """The template with its `{names}` replaced; values are never scanned for names."""
    pieces = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            pieces.append(F.lit(text))
        if name:
            pieces.append(values[name])
    return F.concat(*pieces)


def which(templates: list[str], drawn: Column) -> Column:
    """The number of a random template. Make it a column of its own before `fill_one` uses it."""
    return index(drawn, F.lit(len(templates)))


def fill_one(templates: list[str], number: Column, values: dict[str, Column]) -> Column:
    """The template with that number, filled."""
    text = fill(templates[-1], values)
    for i, template in reversed(list(enumerate(templates[:-1]))):
        text = F.when(number == i, fill(template, values)).otherwise(text)
    return text
