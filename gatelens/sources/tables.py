"""Request-log and security-event tables: schemas, scans and appends."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUEST_LOGS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("model", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("cost", T.DoubleType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("cached", T.BooleanType()),
        T.StructField("optimized", T.BooleanType()),
    ]
)
SECURITY_EVENTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("pattern_matched", T.StringType()),
        T.StructField("prompt_preview", T.StringType()),
        T.StructField("source_ip", T.StringType()),
    ]
)
_LOG_DATE = T.StructField("log_date", T.DateType())


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to the columns of a schema, each cast to its type."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def between(df: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows with ``since <= timestamp < until``.

    On a table partitioned by ``log_date`` the same bounds also prune folders.
    """
    has_date = "log_date" in df.columns
    if since is not None:
        df = df.filter(F.col("timestamp") >= F.lit(since).cast("timestamp_ntz"))
        if has_date:
            df = df.filter(F.col("log_date") >= F.to_date(F.lit(since)))
    if until is not None:
        df = df.filter(F.col("timestamp") < F.lit(until).cast("timestamp_ntz"))
        if has_date:
            df = df.filter(F.col("log_date") <= F.to_date(F.lit(until)))
    return df


def request_logs(spark: SparkSession, path: str, since: str | None = None,
                 until: str | None = None) -> DataFrame:
    """Typed scan of a request log, partitioned by ``log_date`` when written here."""
    return _scan(spark, path, REQUEST_LOGS, since, until)


def security_events(spark: SparkSession, path: str, since: str | None = None,
                    until: str | None = None) -> DataFrame:
    return _scan(spark, path, SECURITY_EVENTS, since, until)


def _scan(spark, path, schema, since, until) -> DataFrame:
    with_date = T.StructType([*schema.fields, _LOG_DATE])
    rows = between(spark.read.schema(with_date).parquet(path), since, until)
    return rows.select(*schema.fieldNames())


def request_logs_jdbc(spark: SparkSession, url: str, since: str, until: str,
                      partitions: int = 64, **options: str) -> DataFrame:
    """The log out of a relational database, read in parallel over time ranges."""
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable="request_logs",
        partitionColumn="timestamp",
        lowerBound=since,
        upperBound=until,
        numPartitions=str(partitions),
        **options,
    )
    # The range is on the column as it is stored, so that the database applies it.
    rows = reader.load().filter((F.col("timestamp") >= F.lit(since).cast("timestamp")) & (F.col("timestamp") < F.lit(until).cast("timestamp")))
    return typed(rows, REQUEST_LOGS)


def append_jdbc(df: DataFrame, url: str, table: str, writers: int = 16, **options: str) -> None:
    """Append rows to a relational table over at most ``writers`` connections."""
    df.coalesce(writers).write.format("jdbc").options(url=url, dbtable=table, **options).mode(
        "append"
    ).save()


def append(df: DataFrame, path: str) -> None:
    """Append log or event rows under a folder per day.

    The adaptive planner sizes the writers by the days' rows: a busy day is split
    over many tasks, quiet days share one.
    """
    dated = df.withColumn("log_date", F.to_date("timestamp"))
    dated.hint("rebalance", "log_date").write.mode("append").partitionBy("log_date").parquet(path)


ID_BUCKETS = 64


def id_table(spark: SparkSession, path: str, buckets: int = ID_BUCKETS) -> DataFrame:
    """The ids logged so far, bucketed by hash, so that joins on them do not shuffle them.

    ``path`` names the table, and ``buckets`` has to stay what it was at first: about
    a hundred million ids each.  The table is declared anew in every session.
    """
    name = _id_table_name(path)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (id STRING) USING parquet "
        f"CLUSTERED BY (id) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def _id_table_name(path: str) -> str:
    return f"logged_ids_{hashlib.md5(path.encode()).hexdigest()}"


def append_batch(rows: DataFrame, path: str, ids_path: str, batch_id: int, buckets: int = ID_BUCKETS) -> DataFrame:
    """Append log rows as one batch and note their ids; returns the rows as written.

    A batch has folders of its own under its days, so a repeated batch replaces what
    it wrote before; ids follow the rows, and noting an id twice changes nothing.
    """
    spark = rows.sparkSession
    dated = rows.withColumn("log_date", F.to_date("timestamp")).withColumn("batch", F.lit(batch_id))
    writer = dated.hint("rebalance", "log_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("log_date", "batch").parquet(path)
    whole = T.StructType([*REQUEST_LOGS.fields, _LOG_DATE, T.StructField("batch", T.IntegerType())])
    done = spark.read.schema(whole).parquet(path).filter(F.col("batch") == batch_id).select(*REQUEST_LOGS.fieldNames())
    id_table(spark, ids_path, buckets)
    done.select("id").repartition(buckets, "id").write.insertInto(_id_table_name(ids_path))
    return done
