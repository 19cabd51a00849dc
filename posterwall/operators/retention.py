"""Removal of old staged events of runs that are done."""

from pyspark.sql import Column, DataFrame, functions as F

from posterwall.constants import DEFAULT_RETENTION_DAYS
from posterwall.functions.dates import retention_cutoff
from posterwall.session import broadcast_if_small


def expired_runs(operations: DataFrame, cutoff: Column) -> DataFrame:
    """(operation) of the successful, processed runs that finished before the cutoff."""
    done = (F.col("status") == "success") & F.col("is_processed") & (F.col("finish_time") < cutoff)
    ids = operations.where(done).select(F.col("_id").alias("operation"))
    return broadcast_if_small(ids, F.length(F.col("operation").cast("string")))


def deleted_rows(staged: DataFrame, operations: DataFrame, as_of, days: int = DEFAULT_RETENTION_DAYS) -> DataFrame:
    """Rows older than the cutoff whose run is older too."""
    cutoff = retention_cutoff(as_of, days)
    return staged.where(F.col("created_at") < cutoff).join(
        expired_runs(operations, cutoff), "operation", "left_semi"
    )


def survivors(staged: DataFrame, operations: DataFrame, as_of, days: int = DEFAULT_RETENTION_DAYS) -> DataFrame:
    cutoff = retention_cutoff(as_of, days)
    expired = expired_runs(operations, cutoff)
    gone = (staged["operation"] == expired["operation"]) & (staged["created_at"] < cutoff)
    return staged.join(expired, gone, "left_anti")
