"""Consecutive row numbers within groups of any size."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from posterwall.constants import BATCH_SIZE
from posterwall.session import materialize

# Groups up to this many rows are numbered by one task each.
MAX_WINDOW_ROWS = 1_000_000
# A slice of a bigger group has about this many rows at most.
SLICE_ROWS = 1_000_000


def number_rows(
    df: DataFrame, groups, order, out: str = "seq", max_window_rows: int = MAX_WINDOW_ROWS
) -> DataFrame:
    """Add the 1-based position of each row in its group; `order` must leave no ties.

    A count checks the largest group first. If every group is small, a window per group does.
    Otherwise the rows are range partitioned by group and order, so that a big group spreads
    over many slices, and each slice is numbered on its own on top of the rows before it.
    """
    groups, order = list(groups), list(order)
    largest, total = df.groupBy(*groups).count().agg(F.max("count"), F.sum("count")).first()
    if (largest or 0) <= max_window_rows:
        position = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
        return df.withColumn(out, position.cast("bigint"))
    at_once = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _number_slices(df, groups, order, out, max(at_once, -(-total // SLICE_ROWS)))


def _number_slices(df: DataFrame, groups: list, order: list, out: str, slices: int) -> DataFrame:
    # Written once: the slice bounds are sampled and must be the same for all that follows.
    sliced = materialize(
        df.repartitionByRange(slices, *groups, *order).withColumn("_slice", F.spark_partition_id()),
        "slices",
    )
    sizes = sliced.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # Only the first group of a slice can have rows in earlier slices, so this table has at most
    # one row per slice, however many groups there are. That bound makes the broadcast safe.
    # A NULL group is a group like others, so its rows are matched null-safe.
    before = (
        sizes.withColumn("_before", F.sum("_rows").over(earlier))
        .where(F.col("_before") > 0)
        .select(*[F.col(g).alias(f"_of_{i}") for i, g in enumerate(groups)], F.col("_slice").alias("_in"), "_before")
    )
    same = F.col("_slice") == F.col("_in")
    for i, group in enumerate(groups):
        same = same & F.col(group).eqNullSafe(F.col(f"_of_{i}"))
    in_slice = Window.partitionBy(*groups, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_pos", F.row_number().over(in_slice))
        .join(F.broadcast(before), same, "left")
        .withColumn(out, F.coalesce(F.col("_before"), F.lit(0)) + F.col("_pos"))
        .drop("_slice", "_pos", "_before", "_in", *[f"_of_{i}" for i in range(len(groups))])
    )


def batch_of(seq, batch_size: int = BATCH_SIZE) -> Column:
    """1-based batch of a 1-based position."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.ceil(seq / F.lit(batch_size)).cast("bigint")


def assign_batches(
    df: DataFrame,
    order,
    operation: str = "operation",
    batch_size: int = BATCH_SIZE,
    max_window_rows: int = MAX_WINDOW_ROWS,
) -> DataFrame:
    """Add `seq` and `batch_number` per run."""
    numbered = number_rows(df, [operation], order, "seq", max_window_rows)
    return numbered.withColumn("batch_number", batch_of("seq", batch_size))
