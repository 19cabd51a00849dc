"""Session settings and the shared folder for written intermediate tables."""

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A side is broadcast only after a count has shown that it stays below these.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_CHARS = 16_000_000


def build_session(app_name: str = "posterwall", **conf) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Day arithmetic needs UTC. AQE splits skewed join partitions and picks the number of
    reduce tasks. Pages go to Python in small batches, since each may be large. Recording the
    Python call site of every column, meant for debugging, makes wide plans slow to build.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="posterwall-")


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder below spark.checkpoint.dir, the storage that every executor can reach.

    A local session without that setting falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, kind: str) -> DataFrame:
    """Write df once and go on from the written table.

    Cuts the lineage, survives lost executors and, unlike a cache, keeps column pruning.
    """
    spark = df.sparkSession
    path = shared_dir(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_rows(df: DataFrame) -> DataFrame:
    """Deal the rows of a few files over all cores, for work that is hard on each row.

    A file is read by as many tasks as it has row groups, at most. More tasks than cores are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(
    df: DataFrame,
    size: Column | None = None,
    max_rows: int = BROADCAST_MAX_ROWS,
    max_chars: int = BROADCAST_MAX_CHARS,
) -> DataFrame:
    """Hint a broadcast when a count proves df small, else leave the join to shuffle.

    size is the width of a row in characters; its sum is checked along with the row count.
    """
    measured = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(size if size is not None else F.lit(0)), F.lit(0)).alias("chars"),
    ).first()
    if measured["n"] <= max_rows and measured["chars"] <= max_chars:
        return F.broadcast(df)
    return df
