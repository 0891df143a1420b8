"""Words, batches and written tables shared by the operators of this package.

Texts are handled as UTF-8 bytes: the word classes of these operators only name
ASCII separators, so a byte translation and ``bytes.split`` find the same words
as the patterns do on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructField, StructType

from gatelens.session import fresh_path

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z; everything else becomes a space.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as they stand."""
    return utf8(text).split()


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased."""
    return utf8(text).translate(_LOWER).split()


def alnum_words(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, with A-Z lower-cased."""
    return utf8(text).translate(_ALNUM).split()


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, read from a table in the shared folder: what follows is cut off from their lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_rows(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` for a function from one record batch to one list of columns.

    The fields of ``schema`` name the columns in their order.
    """
    names, arrow = arrow_fields(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = function(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) if not isinstance(c, pa.Array) else c.cast(t) for c, t in zip(columns, arrow, strict=True)],
                    names,
                )

    return df.mapInArrow(run, schema)


def arrow_fields(schema: str) -> tuple[list[str], list[pa.DataType]]:
    """Names and Arrow types of a DDL schema."""
    fields = StructType.fromDDL(schema).fields
    return [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]


def with_struct(df: DataFrame, name: str, fields: str, function) -> DataFrame:
    """All rows and columns, and a struct column ``name`` with what ``function`` finds per batch.

    ``function`` gets a record batch and returns one list per field.  A column that
    has this name already is replaced.
    """
    df = df.drop(name)
    names, arrow = arrow_fields(fields)
    schema = StructType([*df.schema, StructField(name, StructType.fromDDL(fields))])
    whole = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = zip(function(batch), arrow, strict=True)
                found = [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in columns]
                struct = pa.StructArray.from_arrays(found, names)
                yield pa.RecordBatch.from_arrays([*batch.columns, struct], schema=whole)

    return df.mapInArrow(run, schema)
