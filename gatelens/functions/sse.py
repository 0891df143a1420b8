"""Server-sent event lines of streamed completions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatelens.functions.strict import strict_json

DONE = "data: [DONE]"
_PREFIX = "data: "


def _payload(line: Column) -> Column:
    """The JSON of a data line; NULL for other lines and for what is not JSON throughout."""
    return strict_json(
        F.when(F.startswith(line, F.lit(_PREFIX)) & (line != DONE), F.substr(line, F.lit(len(_PREFIX) + 1)))
    )


def _text(event: Column, path: str) -> Column:
    return F.try_variant_get(event, path, "string")


def sse_delta(line: Column) -> Column:
    """Delta text of one line; NULL for other lines, bad JSON and empty deltas."""
    delta = _text(_payload(line), "$.choices[0].delta.content")
    return F.when(delta != "", delta)


def provider_event_delta(line: Column) -> Column:
    """The same from the typed event format."""
    event = _payload(line)
    text = _text(event, "$.delta.text")
    return F.when((_text(event, "$.type") == "content_block_delta") & (text != ""), text)


def provider_event_done(line: Column) -> Column:
    return F.coalesce(_text(_payload(line), "$.type") == "message_stop", F.lit(False))
