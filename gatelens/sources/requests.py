"""Parsing of raw chat request bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.functions.messages import MESSAGE_TYPE
from gatelens.functions.once import compute_once
from gatelens.functions.strict import strict_json


def raw_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Request bodies out of line-delimited JSON files, as text in column ``json``.

    Read as text, so that a malformed body is a reject with a reason and not a
    lost row.
    """
    reader = spark.readStream if stream else spark.read
    return reader.text(path).withColumnRenamed("value", "json")


_NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")
_TRUE, _FALSE = ("true", "t", "yes", "y", "on", "1"), ("false", "f", "no", "n", "off", "0")


def _kind(value: Column) -> Column:
    """Type name of a variant, VOID for a JSON null, NULL where it is missing."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _number(value: Column) -> Column:
    text = F.try_variant_get(value, "$", "string")
    usual = F.when(_kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
    return usual.when(_kind(value).isin(*_NUMBERS, "STRING"), F.trim(text).try_cast("double"))


def _whole(value: Column) -> Column:
    number = _number(value)
    return F.when(number == F.floor(number), number.try_cast("int"))


def _truth(value: Column) -> Column:
    text = F.lower(F.try_variant_get(value, "$", "string"))
    word = F.when(text.isin(*_TRUE), F.lit(True)).when(text.isin(*_FALSE), F.lit(False))
    number = F.when(_number(value).isin(0.0, 1.0), _number(value) == 1)
    return F.when(_kind(value).isin("STRING", "BOOLEAN"), word).otherwise(number)


def _string(value: Column) -> Column:
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _stop(value: Column) -> Column:
    """A string, or a list of strings."""
    items = F.try_variant_get(value, "$", "array<variant>")
    strings = (_kind(value) == "ARRAY") & F.forall(items, lambda v: F.coalesce(_kind(v) == "STRING", F.lit(False)))
    return F.when((_kind(value) == "STRING") | strings, value)


#: Field -> how it is read (NULL if it can't be) and its value where it is missing.
_FIELDS = {
    "model": (_string, "auto"),
    "temperature": (_number, 1.0),
    "top_p": (_number, 1.0),
    "n": (_whole, 1),
    "stream": (_truth, False),
    "stop": (_stop, None),
    "max_tokens": (_whole, None),
    "presence_penalty": (_number, 0.0),
    "frequency_penalty": (_number, 0.0),
    "user": (_string, None),
}


def _given(value: Column) -> Column:
    """Present and not null."""
    return F.coalesce(_kind(value) != "VOID", F.lit(False))


def _bad_content(message: Column) -> Column:
    """Neither missing, null, a string, nor a list of objects."""
    content = F.try_variant_get(message, "$.content", "variant")
    blocks = F.try_variant_get(content, "$", "array<variant>")
    objects = F.forall(blocks, lambda b: F.coalesce(F.startswith(_kind(b), F.lit("OBJECT")), F.lit(False)))
    fine = (_kind(content) == "STRING") | ((_kind(content) == "ARRAY") & objects)
    return _given(content) & ~F.coalesce(fine, F.lit(False))


def parse_all(raw: DataFrame, col: str = "json") -> DataFrame:
    """Add ``request`` (defaults for missing fields) and ``reason`` (NULL when valid).

    Numbers and truth values may come as text, as usual in such bodies; what can't
    be read as the field's type is a reject that names the field.  An explicit null
    of an optional field stays null.
    """
    body = F.col("__body")

    def field(name: str, kind: str = "variant"):
        return F.try_variant_get(body, f"$.{name}", kind)

    rows, items = F.col("__rows"), F.col("__items")
    values = []
    for name, (read, default) in _FIELDS.items():
        value = F.col("__fields")[name]
        values.append(F.when(_kind(field(name)).isNull(), F.lit(default)).otherwise(value).alias(name))
    request = F.struct(values[0], rows.alias("messages"), *values[1:])
    role = lambda m: F.try_variant_get(m, "$.role", "variant")
    wrong = F.lit(": wrong type")
    # Every message needs a role, and a request needs a last message.
    reason = (
        F.when(body.isNull(), "malformed json")
        .when(~_given(field("messages")), "messages missing")
        .when(items.isNull() | F.exists(items, lambda m: ~F.startswith(_kind(m), F.lit("OBJECT"))), "messages: wrong type")
        .when(F.size(items) == 0, "messages empty")
        .when(F.exists(items, lambda m: ~_given(role(m))), "role missing")
        .when(F.exists(items, lambda m: _kind(role(m)) != "STRING"), "role: wrong type")
        .when(F.exists(items, _bad_content), "content: wrong type")
        .when(
            F.exists(
                items,
                lambda m: _given(F.try_variant_get(m, "$.name", "variant"))
                & (_kind(F.try_variant_get(m, "$.name", "variant")) != "STRING"),
            ),
            "name: wrong type",
        )
    )
    for name in _FIELDS:
        reason = reason.when(_given(field(name)) & F.col("__fields")[name].isNull(), F.concat(F.lit(name), wrong))
    parsed = compute_once(raw, __body=strict_json(F.col(col)))
    listed = compute_once(
        parsed,
        __items=field("messages", "array<variant>"),
        __rows=field("messages", f"array<{MESSAGE_TYPE}>"),
        __fields=F.struct(*[read(field(name)).alias(name) for name, (read, _) in _FIELDS.items()]),
    )
    return (
        compute_once(listed, reason=reason)
        .withColumn("request", F.when(F.col("reason").isNull(), request))
        .drop("__body", "__rows", "__items", "__fields")
    )


def parse_requests(raw: DataFrame, col: str = "json") -> tuple[DataFrame, DataFrame]:
    """Split raw bodies into typed requests and rejects with their reason."""
    parsed = parse_all(raw, col)
    others = [c for c in raw.columns if c != col]
    good = parsed.filter(F.col("reason").isNull()).select(*others, "request.*")
    bad = parsed.filter(F.col("reason").isNotNull()).select(*raw.columns, "reason")
    return good, bad
