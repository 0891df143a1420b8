"""Chat message content: a string, a list of typed blocks or null, kept as VARIANT."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGE_TYPE = "struct<role:string,content:variant,name:string>"


def _kind(content: Column) -> Column:
    return F.coalesce(F.schema_of_variant(content), F.lit("VOID"))


def _is_list(content: Column) -> Column:
    return F.startswith(_kind(content), F.lit("ARRAY"))


def _blocks(content: Column) -> Column:
    return F.try_variant_get(content, "$", "array<map<string,variant>>")


def _block_type(block: Column) -> Column:
    return F.try_variant_get(block["type"], "$", "string")


def _is_text(block: Column) -> Column:
    return F.coalesce(_block_type(block) == "text", F.lit(False))


def _block_text(block: Column) -> Column:
    return F.coalesce(F.try_variant_get(block["text"], "$", "string"), F.lit(""))


def _variant_string(text: Column) -> Column:
    return text.cast("variant")


def _with_text(block: Column, text: Column) -> Column:
    others = F.map_filter(block, lambda key, _: key != "text")
    return F.map_concat(others, F.create_map(F.lit("text"), _variant_string(text)))


def message_text(content: Column) -> Column:
    """Null is empty, a string is itself, text blocks are joined by one blank."""
    joined = F.array_join(
        F.transform(F.filter(_blocks(content), _is_text), _block_text), " "
    )
    return (
        F.when(_kind(content) == "VOID", F.lit(""))
        .when(_is_list(content), joined)
        .otherwise(content.cast("string"))
    )


def replace_message_text(content: Column, new: Column) -> Column:
    """Write text back: a list gets it in its first text block, or as a new block."""
    blocks = _blocks(content)
    first = F.array_position(F.transform(blocks, _is_text), True) - 1
    replaced = F.transform(
        blocks, lambda b, i: F.when(i == first, _with_text(b, new)).otherwise(b)
    )
    appended = F.array_append(
        blocks,
        F.create_map(
            F.lit("type"), _variant_string(F.lit("text")), F.lit("text"), _variant_string(new)
        ),
    )
    listed = F.when(first >= 0, replaced).otherwise(appended)
    return F.when(_is_list(content), F.to_variant_object(listed)).otherwise(_variant_string(new))


def map_message_text(content: Column, change: Callable[[Column], Column]) -> Column:
    """Apply a text function to a string content or to each of its text blocks."""
    changed = F.transform(
        _blocks(content),
        lambda b: F.when(_is_text(b), _with_text(b, change(_block_text(b)))).otherwise(b),
    )
    return (
        F.when(_kind(content) == "VOID", content)
        .when(_is_list(content), F.to_variant_object(changed))
        .otherwise(_variant_string(change(content.cast("string"))))
    )


def redact_conversation(messages: Column, redact: Callable[[Column], Column] | None = None) -> Column:
    """Redact every message of the history, each text block on its own."""
    if redact is None:
        from gatelens.functions.pii import redact_pii as redact

    return F.transform(
        messages,
        lambda m: F.struct(
            m["role"].alias("role"),
            map_message_text(m["content"], redact).alias("content"),
            m["name"].alias("name"),
        ),
    )


def last_message(messages: Column) -> Column:
    return F.try_element_at(messages, F.lit(-1))
