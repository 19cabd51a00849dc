"""Written intermediate tables whose shuffle files go as soon as the table stands."""

from contextlib import contextmanager

from pyspark.sql import DataFrame

from posterwall.session import shared_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _setting(spark, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, kind: str, files: int | None = None) -> DataFrame:
    """Write df once into the shared folder and go on from the written table, in at most `files` files.

    A limit of files comes from the number of rows, never of cores: partitions that hold next to nothing
    are written one after the other by one task. A file costs more than the rows of a tiny partition do.

    The lineage ends there, so a lost executor costs a retry of what follows only. The shuffle
    files behind the table are deleted when it is written: nothing reads them again.
    """
    spark = df.sparkSession
    path = shared_dir(spark, kind)
    if files:
        df = df.coalesce(files)
    with _setting(spark, _CLEANUP, "true"):
        df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
