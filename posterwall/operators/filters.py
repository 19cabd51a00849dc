"""Filters, the card classifier, and the reasons for which rows are left out."""

from pyspark.sql import Column, DataFrame, functions as F

from posterwall.constants import (
    EXCLUDED_CITY_PHRASES,
    MANY_VENUES_PHRASE,
    MORE_DATES_PHRASES,
    ONLINE_PHRASE,
    RUN_TYPES,
    SERIES_PATH,
    SOLD_OUT_AVAILABILITY,
    SOLD_OUT_TEXT,
)
from posterwall.functions.text import _col, contains_any, falsy_to_null
from posterwall.session import broadcast_if_small


# Cities

def _place(name) -> Column:
    return ~contains_any(name, EXCLUDED_CITY_PHRASES)


def _has_original_name(name) -> Column:
    return F.coalesce(_col(name), F.lit("")).contains("|")


def eligible_cities(cities: DataFrame) -> DataFrame:
    """Cities that are places and carry an original name after '|'."""
    return cities.where(_place("name") & _has_original_name("name"))


def city_funnel(cities: DataFrame) -> DataFrame:
    """One row with the counts of eligible_cities at each step."""
    return cities.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~_place("name")).alias("excluded_phrase"),
        F.count_if(_place("name") & ~_has_original_name("name")).alias("excluded_no_original"),
        F.count_if(_place("name") & _has_original_name("name")).alias("eligible"),
    )


def cities_with_ids(cities: DataFrame, ids: DataFrame) -> DataFrame:
    return cities.join(broadcast_if_small(ids.select("_id").distinct(), F.length("_id")), "_id", "left_semi")


def choose_cities(
    cities: DataFrame, city_id: str | None = None, city_name: str | None = None, first: int | None = None
) -> DataFrame:
    """By id, else by a part of the name in any case; then the first ones in table order."""
    if city_id:
        cities = cities.where(F.col("_id") == city_id)
    elif city_name:
        cities = cities.where(contains_any("name", [city_name]))
    if first and first > 0:
        cities = cities.orderBy("city_ord").limit(first)
    return cities


# Cards, links, slots, runs

def card_type(venue, date, href) -> Column:
    """1 single date, 2 one venue with more dates, 3 many venues or a series; NULL if online."""
    return (
        F.when(contains_any(venue, [ONLINE_PHRASE]), F.lit(None).cast("int"))
        .when(contains_any(venue, [MANY_VENUES_PHRASE]), 3)
        .when(contains_any(date, MORE_DATES_PHRASES), 2)
        .when(_col(href).contains(SERIES_PATH), 3)
        .otherwise(1)
    )


def classify_cards(cards: DataFrame) -> DataFrame:
    """Add type, and reason='online' for the cards that are skipped."""
    typed = cards.withColumn("type", card_type("venue_text", "date_text", "href"))
    return typed.withColumn("reason", F.when(F.col("type").isNull(), ONLINE_PHRASE))


def card_class_counts(classified: DataFrame) -> DataFrame:
    return classified.agg(
        *[F.count_if(F.col("type") == t).alias(f"type{t}") for t in (1, 2, 3)],
        F.count_if(F.col("type").isNull()).alias("skipped"),
    )


def is_series_link(href) -> Column:
    return _col(href).contains(SERIES_PATH)


def is_sold_out(availability, action_text) -> Column:
    return contains_any(availability, [SOLD_OUT_AVAILABILITY]) | contains_any(action_text, [SOLD_OUT_TEXT])


def is_run_type(c) -> Column:
    return F.coalesce(_col(c).isin(*RUN_TYPES), F.lit(False))


# Rejects

NO_CITY_OR_COUNTRY = "city/country id missing"


def missing_ids_reason(city_id, country_id) -> Column:
    missing = falsy_to_null(city_id).isNull() | falsy_to_null(country_id).isNull()
    return F.when(missing, NO_CITY_OR_COUNTRY)


def detail_reason(found, name, has_date, city_id) -> Column:
    """Why a detail page gives no event; the first shortcoming counts."""
    return (
        F.when(~_col(found), "no page")
        .when(falsy_to_null(name).isNull(), "no name")
        .when(~_col(has_date), "no date")
        .when(_col(city_id).isNull(), "no city")
    )


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason, rows with one)."""
    return df.where(F.col("reason").isNull()).drop("reason"), df.where(F.col("reason").isNotNull())
