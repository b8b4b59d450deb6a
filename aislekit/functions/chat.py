"""The chat row test."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from aislekit import vocabulary as V
from aislekit.functions.draws import let
from aislekit.functions.text import is_blank, strip


_MESSAGE = "array<struct<role: string, content: string>>"


def _last(fields: Column, name: str) -> Column:
    """The last value of a name that a JSON object may repeat."""
    named = F.filter(F.map_entries(fields), lambda entry: entry["key"] == name)
    return F.try_element_at(named, F.lit(-1))["value"]


def _kind(json: Column) -> Column:
    return F.substring(F.ltrim(json, F.lit(" \t\r\n")), 1, 1)


def chat_fault(line: Column) -> Column:
    """The first reason for a chat line to fail, null for a good one.

    Lines are read as typed values where that works; a number is then told from the text of
    that number. Lines with a repeated key, with a value that is not a number, or too long to
    be typed are read as texts instead; the last of repeated keys counts.
    """
    def message_fault(m: Column, i: Column) -> Column:
        return (
            F.when(m["role"].isNull() | m["content"].isNull(), F.replace(F.lit(V.NOT_STRING), F.lit("{i}"), i.cast("string")))
            .when(is_blank(m["content"]), F.replace(F.lit(V.EMPTY_CONTENT), F.lit("{i}"), i.cast("string")))
        )

    def fault(row: Column) -> Column:
        messages = row["messages"]

        def role_is(i: int, role: str) -> Column:
            return F.coalesce(F.get(messages, F.lit(i))["role"] == role, F.lit(False))

        ordered = role_is(0, "system") & role_is(1, "user") & role_is(2, "assistant")
        faults = F.filter(F.transform(messages, message_fault), lambda f: f.isNotNull())
        return (
            F.when(row["kind"].isNull(), F.lit(V.BAD_JSON))
            .when(row["kind"] != "OBJECT", F.lit(V.NOT_OBJECT))
            .when(messages.isNull(), F.lit(V.NO_MESSAGES))
            .when(F.size(messages) < 3, F.lit(V.TOO_SHORT))
            .when(~ordered, F.lit(V.WRONG_ROLES))
            .otherwise(F.get(faults, F.lit(0)))
        )

    def message(m: Column) -> Column:
        def text(name: str) -> Column:
            value = F.try_variant_get(m, f"$.{name}", "variant")
            return F.when(F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False)), F.try_variant_get(value, "$", "string"))

        return F.struct(text("role").alias("role"), text("content").alias("content"))

    def typed(parsed: Column) -> Column:
        messages = F.transform(F.try_variant_get(parsed, "$.messages", "array<variant>"), message)
        kind = F.schema_of_variant(parsed)
        return F.struct(F.when(kind.startswith("OBJECT"), "OBJECT").otherwise(kind).alias("kind"), messages.alias("messages"))

    def as_texts(line: Column) -> Column:
        """The same from the texts of the parts; a line that is no JSON value gives nothing."""
        def parts(keys: Column) -> Column:
            listed = _last(keys, "messages")
            raw = F.when(_kind(listed) == "[", F.from_json(listed, "array<string>"))
            messages = F.transform(raw, lambda m: let(F.try_parse_json(m), lambda v: F.when(v.isNotNull(), message(v)).otherwise(
                let(F.from_json(m, "map<string,string>"), lambda f: F.struct(_last(f, "role").alias("role"), _last(f, "content").alias("content")))
            ))).cast(_MESSAGE)
            bare = strip(line).isin("NaN", "Infinity", "-Infinity")
            other = (_kind(line) == "[") & F.from_json(line, "array<string>").isNotNull()
            kind = F.when(keys.isNotNull(), "OBJECT").when(bare | other, "OTHER")
            return F.struct(kind.alias("kind"), messages.alias("messages"))

        return let(F.when(_kind(line) == "{", F.from_json(line, "map<string,string>")), parts)

    return let(F.try_parse_json(line), lambda parsed: let(
        F.when(parsed.isNotNull(), typed(parsed)).otherwise(as_texts(line)), fault
    ))
