"""From raw documents to packed training windows, in five stages.

Each stage reads what its predecessor kept, as a written table, and all but the last
return the columns of documents:

1. quality classifier: documents that are more likely junk than not go;
2. near duplicates: of each SimHash component the document with the least id stays;
3. decontamination: documents with a twentieth of their words in benchmark passages go;
4. secrets: every document stays, its secrets masked and ``n_chars`` counted anew;
5. packing: token pieces in windows of 2048.

Rows: null and empty texts pass through the stages like others, and so do rows without
an id, which stay only if their group has no other.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm import decontaminate, ordinal, queries, secret_scan, simhash
from gatelens.llm.common import documents, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ordinal.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates_removed(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.overlap(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "__overlap")
    hit = decontaminate.contaminated(F.col("__overlap.n_hit"), F.col("__overlap.n_words"))
    return found.filter(~hit).select(*docs.columns)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.packed_pieces(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_masking),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each is written and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # fitted weights, 64-bit fingerprints and a tokenizer are beyond SQL

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
