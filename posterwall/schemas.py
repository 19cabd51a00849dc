"""Table and relation schemas. JSON and Parquet are always read with one of these."""

COUNTRIES = "_id STRING, name STRING, flag_url STRING, created_at TIMESTAMP, updated_at TIMESTAMP"

CITIES = (
    "_id STRING, country_id STRING, name STRING, sort INT, "
    "coordinates STRUCT<lat: STRING, lon: STRING>, city_ord BIGINT"
)

OPERATIONS = (
    "_id STRING, type STRING, admin STRING, status STRING, statistics STRING, errorText STRING, "
    "infoText STRING, finish_time TIMESTAMP, is_processed BOOLEAN, is_taken BOOLEAN, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)

# The payload of a staged event; a plan ends with exactly these columns.
EVENT_FIELDS = {
    "name": "STRING",
    "description": "STRING",
    "specialization": "STRING",
    "admin_id": "STRING",
    "country_id": "STRING",
    "city_id": "STRING",
    "operationId": "STRING",
    "contacts": "STRUCT<website: STRING>",
    "photos": "ARRAY<STRUCT<full_url: STRING>>",
    "holding_date": "STRING",
    "date_start": "TIMESTAMP",
    "date_end": "TIMESTAMP",
    "source": "STRING",
    "address": "STRING",
    "lat": "DOUBLE",
    "lon": "DOUBLE",
    "is_special_point_on_map": "BOOLEAN",
    "min_price": "DOUBLE",
    "max_price": "DOUBLE",
}
EVENT_DATA = "STRUCT<" + ", ".join(f"{name}: {kind}" for name, kind in EVENT_FIELDS.items()) + ">"

STAGED_EVENTS = (
    f"operation STRING, batch_number BIGINT, seq BIGINT, event_data {EVENT_DATA}, "
    "created_at TIMESTAMP"
)

RAW_PAGES = (
    "_id STRING, data STRING, is_processed BOOLEAN, processed_at TIMESTAMP, "
    "error_message STRING, created_at TIMESTAMP"
)

LISTING_CARDS = "ARRAY<STRUCT<href: STRING, title: STRING, date: STRING, venue: STRING>>"

# Numbers stay DOUBLE: the JSON reader turns a quoted number or a boolean into NULL,
# so only true JSON numbers count as a coordinate or a price.
FEED = (
    "eventserie ARRAY<STRUCT<esName: STRING, esText: STRING, esLink: STRING, "
    "esPictureBig: STRING, esPicture: STRING, esPictureSmall: STRING, "
    "events: ARRAY<STRUCT<eventName: STRING, eventDateIso8601: STRING, eventVenue: STRING, "
    "eventStreet: STRING, eventZip: STRING, eventCity: STRING, eventLink: STRING, "
    "venueLatitude: DOUBLE, venueLongitude: DOUBLE, minPrice: DOUBLE, maxPrice: DOUBLE>>>>"
)

RUN_LOG = "operation STRING, part BIGINT, line BIGINT, ts TIMESTAMP, message STRING"
