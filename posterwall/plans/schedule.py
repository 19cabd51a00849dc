"""Schedule run: city pages to tour pages to slots to merged events."""

from pyspark.sql import DataFrame, functions as F

from posterwall.constants import SCHEDULE_HOST, SOURCE_SCHEDULE
from posterwall.functions.dates import parse_iso
from posterwall.functions.numbers import coordinates_from_struct, pick_coordinates, price_from_attribute
from posterwall.functions.text import (
    absolutize_link, absolutize_photo, city_slug, first_filled, join_filled, wrap_photo, wrap_website,
)
from posterwall.operators.citymatch import resolve_city
from posterwall.operators.filters import choose_cities, is_sold_out, missing_ids_reason, split_rejects
from posterwall.operators.grouping import group_slots, merge_duplicates
from posterwall.plans.common import RunParameters, to_events
from posterwall.session import materialize
from posterwall.sources.html import read_schedule_slots, read_tour_cards, rows_of_pages
from posterwall.sources.tables import parsed_pages

SLOT_KEEP = ("city_id", "country_id", "coordinates", "description", "photo_url", "tour_url")
EVENT_KEEP = tuple(c for c in SLOT_KEEP if c != "city_id")


def schedule_cards(cities: DataFrame, city_pages: DataFrame) -> DataFrame:
    """Tour cards of the pages of the given cities, links made absolute, cards without dropped."""
    wanted = cities.select(
        F.concat(F.lit(f"{SCHEDULE_HOST}/city/"), city_slug("name"), F.lit("/")).alias("url"),
        F.col("_id").alias("page_city"),
        F.col("name").alias("page_city_name"),
        F.col("city_ord").alias("page_city_ord"),
    )
    cards = rows_of_pages(parsed_pages(city_pages, wanted, read_tour_cards)).join(wanted, "url")
    cards = cards.withColumn("tour_url", absolutize_link("link")).where(F.col("tour_url") != "")
    return cards.withColumn("photo_url", absolutize_photo("photo")).withColumnRenamed("pos", "card_pos")


def schedule_slots(cards: DataFrame, tour_pages: DataFrame) -> DataFrame:
    """Open slots of each card's tour page. A page is parsed once however many cards link to it."""
    linked = cards.select(F.col("tour_url").alias("url"))
    slots = rows_of_pages(parsed_pages(tour_pages, linked, read_schedule_slots)).where(~is_sold_out("availability", "action_text"))
    slots = slots.select(
        F.col("url").alias("tour_url"),
        F.col("pos").alias("slot_pos"),
        parse_iso("startIso").alias("start"),
        "cityName",
        "place",
        first_filled("address", "place").alias("slot_address"),
        price_from_attribute("price").alias("price"),
        "image",
        F.col("description").alias("slot_description"),
    )
    joined = cards.join(slots, "tour_url")
    return joined.withColumns(
        {
            "tour": F.struct("page_city_ord", "card_pos"),
            "target_city": first_filled("cityName", "page_city_name"),
            "address": join_filled(
                first_filled("place", "venue"),
                first_filled("slot_address", F.substring_index("page_city_name", "|", 1)),
            ),
            "description": first_filled("slot_description", "title"),
            "photo_url": first_filled("image", "photo_url"),
        }
    )


def resolve_slots(slots: DataFrame, dimension: DataFrame, params: RunParameters) -> DataFrame:
    """Slots with ids and coordinates of their city, and a reason where an id is missing."""
    matched = resolve_city(slots, dimension, F.col("target_city")).withColumns(
        {
            "city_id": first_filled(F.lit(params.city_id), F.col("city._id")),
            "country_id": first_filled(F.lit(params.country_id), F.col("city.country_id")),
            "coordinates": F.col("city.coordinates"),
        }
    )
    return matched.withColumn("reason", missing_ids_reason("city_id", "country_id"))


def slots_to_events(slots: DataFrame, params: RunParameters) -> DataFrame:
    """Group the slots of each tour, then merge duplicates over all tours.

    slots has tour, title, address, start, price, SLOT_KEEP and page_city_ord, card_pos, slot_pos.
    """
    return merged_to_events(merge_duplicates(grouped_slots(slots), F.col("ord"), EVENT_KEEP), params)


def grouped_slots(slots: DataFrame) -> DataFrame:
    """The slots of each tour in groups, as events to be merged."""
    order = F.struct("page_city_ord", "card_pos", "slot_pos")
    return group_slots(slots, order, SLOT_KEEP).withColumnRenamed("title", "name")


def merged_to_events(merged: DataFrame, params: RunParameters) -> DataFrame:
    """Merged groups in the shape of events."""
    none = F.lit(None).cast("double")
    point = pick_coordinates(none, none, coordinates_from_struct("coordinates"))
    shaped = merged.withColumn("point", point).withColumns(
        {
            "specialization": F.lit(params.specialization),
            "contacts": wrap_website("tour_url"),
            "photos": wrap_photo("photo_url"),
            "lat": F.col("point.lat"),
            "lon": F.col("point.lon"),
            "is_special_point_on_map": F.col("point.is_special_point_on_map"),
        }
    )
    return to_events(shaped, params, SOURCE_SCHEDULE)


def schedule_events(
    cities: DataFrame, city_pages: DataFrame, tour_pages: DataFrame, params: RunParameters
) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of a run over the chosen cities. Slots match against those cities only."""
    # The limit is for runs over all cities; a named city is never cut off by it.
    limit = None if params.city_name else params.max_cities
    chosen = choose_cities(cities, city_name=params.city_name, first=limit)
    cards = schedule_cards(chosen, city_pages)
    # Written once: matching reads the slots twice, and parsing pages is the costly part.
    # So are the cards, which tell the tour pages that are worth parsing.
    cards = materialize(cards, "cards")
    slots = materialize(schedule_slots(cards, tour_pages), "slots")
    ok, rejects = split_rejects(resolve_slots(slots, chosen, params))
    return slots_to_events(ok, params), rejects.select(
        "page_city", "title", "target_city", "reason"
    )
