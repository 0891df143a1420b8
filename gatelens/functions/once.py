"""Evaluating dear expressions once per row, and tables made of literals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters use as values.

    A filter over a projected column is pushed below the projection with the
    column's whole expression in it, once per mention; for a parse or a regular
    expression over a long text that multiplies the work.  A one-row generator
    yields the same columns, and filters stay above it.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` mentions it, also per element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A few fixed rows as a table, made in the JVM without a Python stage."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
