"""Dimension sync: insert what is new, or replace everything."""

from pyspark.sql import DataFrame, functions as F

from posterwall.constants import DEFAULT_CITY_SORT, UNKNOWN_COORDINATE
from posterwall.operators.numbering import number_rows


def first_per_id(incoming: DataFrame, order: str = "input_ord") -> DataFrame:
    """Of rows with the same _id the first one counts."""
    return (
        incoming.groupBy("_id")
        .agg(F.min_by(F.struct(*[c for c in incoming.columns if c != "_id"]), order).alias("_row"))
        .select("_id", "_row.*")
    )


def rows_to_insert(incoming: DataFrame, existing: DataFrame, order: str = "input_ord") -> DataFrame:
    return first_per_id(incoming, order).join(existing.select("_id"), "_id", "left_anti")


def country_defaults(countries: DataFrame) -> DataFrame:
    return countries.withColumn("flag_url", F.coalesce("flag_url", F.lit("")))


def city_defaults(cities: DataFrame) -> DataFrame:
    unknown = F.struct(F.lit(UNKNOWN_COORDINATE).alias("lat"), F.lit(UNKNOWN_COORDINATE).alias("lon"))
    return cities.withColumn(
        "sort", F.coalesce(F.nullif("sort", F.lit(0)), F.lit(DEFAULT_CITY_SORT))
    ).withColumn("coordinates", F.coalesce("coordinates", unknown))


def number_cities(new: DataFrame, existing: DataFrame, order: str = "input_ord") -> DataFrame:
    """Continue city_ord after the existing cities, in input order."""
    last = existing.agg(F.max("city_ord")).first()[0] or 0
    numbered = number_rows(new, [], [order, "_id"], "_seq")
    return numbered.withColumn("city_ord", F.col("_seq") + F.lit(last)).drop("_seq")


def sync_statistics(incoming: DataFrame, existing: DataFrame, replace_all: bool) -> DataFrame:
    """One row: rows really created and deleted."""
    ids = incoming.select("_id").distinct()
    if not replace_all:
        created = ids.join(existing.select("_id"), "_id", "left_anti")
        return created.agg(F.count(F.lit(1)).alias("created")).withColumn("deleted", F.lit(0).cast("bigint"))
    both = ids.withColumn("_new", F.lit(1)).unionByName(
        existing.select("_id").withColumn("_new", F.lit(0))
    )
    return both.agg(
        F.count_if(F.col("_new") == 1).alias("created"), F.count_if(F.col("_new") == 0).alias("deleted")
    )
