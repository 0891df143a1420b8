"""Idempotent appends out of streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.operators.logs import security_event_rows
from gatelens.operators.security import flag_injection
from gatelens.operators.semantic import semantic_top1


def stream_log_dedup(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Log rows with every id once, as long as copies arrive within ``late``."""
    return log.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["id"])


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per micro-batch: a repeated batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def security_sink(events_path: str, clean_path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: blocked requests to events, the rest onwards.

    The check runs once per batch; both writes read the kept result.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        flagged = flag_injection(batch, "text").persist()
        try:
            blocked = flagged.filter(F.col("pattern").isNotNull())
            write_batch(security_event_rows(blocked), events_path, batch_id)
            clean = flagged.filter(F.col("pattern").isNull()).drop("pattern")
            write_batch(clean, clean_path, batch_id)
        finally:
            flagged.unpersist()

    return write


def semantic_sink(snapshot: Callable[[], DataFrame], path: str, **search) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: semantic lookup against the index as it is now.

    ``snapshot`` is called per micro-batch and returns the current index table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(semantic_top1(batch, snapshot(), **search), path, batch_id)

    return write


def latest_windows(path_df: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of every updated row, by batch."""
    rest = [c for c in path_df.columns if c not in (*keys, "batch_id")]
    last = F.max_by(F.struct(*rest), F.col("batch_id"))
    return path_df.groupBy(*keys).agg(last.alias("r")).select(*keys, "r.*")
