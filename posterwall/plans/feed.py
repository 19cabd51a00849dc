"""Feed run: nested JSON documents to events."""

from pyspark.sql import DataFrame, functions as F

from posterwall.constants import DEFAULT_SPECIALIZATION, SOURCE_FEED
from posterwall.functions.dates import parse_iso, to_iso
from posterwall.functions.numbers import coordinates_from_struct, pick_coordinates
from posterwall.functions.text import falsy_to_null, first_filled, join_filled, wrap_photo, wrap_website
from posterwall.operators.citymatch import resolve_city
from posterwall.operators.filters import missing_ids_reason, split_rejects
from posterwall.plans.common import RunParameters, to_events
from posterwall.sources.feed import order_keys


def feed_events(rows: DataFrame, cities: DataFrame, params: RunParameters, keys=("file",)) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of exploded feed rows.

    The parameters' ids come before those of the matched city. A date that does not parse rejects
    its event only.
    """
    target = first_filled("eventCity", F.lit(params.city_name))
    # Not written in between: matching reads the rows once for their cities, and parsing them again costs
    # less than writing every column, whether it is wanted or not.
    matched = resolve_city(rows, cities, target)
    # A column of its own, so that the numbers of a city are read once for each row.
    matched = matched.withColumn("city_point", coordinates_from_struct("city.coordinates"))
    point = pick_coordinates("venueLatitude", "venueLongitude", "city_point")
    event = matched.withColumns(
        {
            "city_id": first_filled(F.lit(params.city_id), F.col("city._id")),
            "country_id": first_filled(F.lit(params.country_id), F.col("city.country_id")),
            "date_start": parse_iso("eventDateIso8601"),
            "name": first_filled("eventName", "esName"),
            "point": point,
            "ord": F.struct(*order_keys(rows, keys), "series_pos", "event_pos"),
        }
    )
    bad_date = falsy_to_null("eventDateIso8601").isNotNull() & F.col("date_start").isNull()
    event = event.withColumn(
        "reason", F.coalesce(missing_ids_reason("city_id", "country_id"), F.when(bad_date, "bad date"))
    )
    ok, rejects = split_rejects(event)
    shaped = ok.withColumns(
        {
            "description": F.coalesce(first_filled("esText", "eventName"), F.lit("")),
            "specialization": F.lit(DEFAULT_SPECIALIZATION),
            "contacts": wrap_website(F.coalesce(first_filled("eventLink", "esLink"), F.lit(""))),
            "photos": wrap_photo(first_filled("esPictureBig", "esPicture", "esPictureSmall")),
            "holding_date": to_iso("date_start"),
            "date_end": F.col("date_start"),
            "address": join_filled("eventVenue", "eventStreet", "eventZip", "eventCity"),
            "lat": F.col("point.lat"),
            "lon": F.col("point.lon"),
            "is_special_point_on_map": F.col("point.is_special_point_on_map"),
            "min_price": F.col("minPrice"),
            "max_price": F.col("maxPrice"),
        }
    )
    return to_events(shaped, params, SOURCE_FEED), rejects.select("ord", "name", "eventCity", "reason")
