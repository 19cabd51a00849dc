"""The nested feed: series with their events, as (gzipped) JSON."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from posterwall.schemas import FEED


def read_feed(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Feed documents with their file name and a digest of what they hold.

    File and digest order the documents alike in every run, also those that share a file.

    A gzipped file, and a multi-line file, is read by one task each. Deliver a big feed as many
    files, or as one document per line (multi_line=False) in a splittable codec.
    """
    reader = spark.read.schema(FEED).option("multiLine", multi_line)
    documents = reader.json(path)
    digest = F.sha2(F.to_json(F.struct(*documents.columns)), 256)
    return documents.withColumns({"file": F.input_file_name(), "document": digest})


def order_keys(df: DataFrame, keys) -> tuple:
    """keys, and the document's digest if df has it: what orders documents that share their keys."""
    return (*keys, *(c for c in ("document",) if c in df.columns and c not in keys))


def explode_feed(documents: DataFrame, keys=("file",)) -> DataFrame:
    """One row per event with the fields of its series; keys, series_pos and event_pos keep the
    order. Missing arrays count as empty."""
    keys = order_keys(documents, keys)
    series = documents.select(*keys, F.posexplode("eventserie").alias("series_pos", "s"))
    return series.select(
        *keys,
        "series_pos",
        F.col("s.esName").alias("esName"),
        F.col("s.esText").alias("esText"),
        F.col("s.esLink").alias("esLink"),
        F.col("s.esPictureBig").alias("esPictureBig"),
        F.col("s.esPicture").alias("esPicture"),
        F.col("s.esPictureSmall").alias("esPictureSmall"),
        F.posexplode("s.events").alias("event_pos", "e"),
    ).select("*", "e.*").drop("e")
