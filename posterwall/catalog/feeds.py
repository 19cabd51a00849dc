"""Nested feed and inbox: scan, explode, run, drain."""

from pyspark.sql import functions as F

from posterwall.catalog import fixtures as fx
from posterwall.catalog.registry import query
from posterwall.catalog.slots import merged_events
from posterwall.constants import SOURCE_FEED, SOURCE_SCHEDULE
from posterwall.operators.filters import classify_cards, card_class_counts
from posterwall.plans.common import RunParameters, union_events
from posterwall.plans.feed import feed_events
from posterwall.session import shared_dir
from posterwall.sources import inbox
from posterwall.sources.feed import explode_feed, read_feed
from posterwall.streaming import drain

PARAMS = RunParameters(run_id="run-2", admin_id="admin-1")


def _json_text(*parts):
    """Concatenated JSON; '~' in literals stands for a double quote."""
    return F.concat(*[F.lit(p.replace("~", '"')) if isinstance(p, str) else p for p in parts])


def _feed(spark, sf_dir):
    """Orders as series with an event for each line item, written as gzipped JSON and read back.

    Latitudes are numbers, quoted numbers or missing; an order without line items has no events.
    """
    key = F.col("o_orderkey")
    lat = F.when(key % 4 == 0, F.lit("48.5")).when(key % 4 == 1, F.lit('"48.5"')).otherwise("null")
    city = F.when(key % 6 == 0, "").otherwise(F.concat(F.lit("Nation_"), F.col("o_custkey") % 30))
    # What events share is put together once per order, what a line item brings before lines are grouped.
    place = _json_text(
        "~,~eventVenue~:~Hall ", key % 5, "~,~eventStreet~:~~,~eventZip~:~", key % 100, "~,~eventCity~:~", city,
        "~,~eventLink~:~~,~venueLatitude~:", lat, ",~venueLongitude~:9.25,~minPrice~:",
    )
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", place.alias("place"))
    line = F.col("l_orderkey")
    when = F.when(line % 13 == 0, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd'T'19:30:00'+01:00'"))
    price = F.when(line % 2 == 0, F.col("l_extendedprice").cast("string")).otherwise('"1"')
    lines = fx.table(spark, sf_dir, "lineitem").select(line, F.struct(*fx.K5, when.alias("starts"), price.alias("price")).alias("line"))
    lines = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))

    def event(row, number):
        return _json_text(
            "{~eventName~:~", F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("Event "), number, F.lit(" of "), key)),
            "~,~eventDateIso8601~:~", row["starts"], F.col("place"), row["price"], ",~maxPrice~:", number.cast("string"), "}",
        )

    events = F.concat(F.lit("["), F.concat_ws(",", F.transform("lines", event)), F.lit("]"))
    document = _json_text(
        "{~eventserie~:[{~esName~:~Series ", key, "~,~esText~:~", F.when(key % 7 == 0, "").otherwise("About"),
        "~,~esLink~:~https://example.org/", key, "~,~esPictureSmall~:~p", key, "~,~events~:",
        F.when(F.col("lines").isNull(), "null").otherwise(events), "}]}",
    )
    path = shared_dir(spark, "feed")
    series = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    # The join deals the orders out.
    series.select(document.alias("value")).write.option("compression", "gzip").text(path)
    documents = read_feed(spark, path, multi_line=False).withColumn(
        "o_orderkey", F.expr("try_cast(substring(eventserie[0].esName, 8) AS BIGINT)")
    )
    return explode_feed(documents, keys=("o_orderkey",))


_FEED = f"""feed AS (
  SELECT o_orderkey AS k, o_custkey, cast(row_number() OVER (PARTITION BY o_orderkey ORDER BY {fx.K5_SQL}) - 1 AS INTEGER) AS e,
         l_shipdate AS event_day, l_extendedprice AS price,
         CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'Nation_' || (o_custkey % 30) END AS event_city
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


@query(
    "explode_feed",
    f"""WITH {_FEED} SELECT k AS o_orderkey, e AS event_pos, 'Series ' || k AS "esName", event_city AS "eventCity",
               CASE WHEN k % 4 = 0 THEN cast(48.5 AS DOUBLE) END AS lat, CASE WHEN k % 2 = 0 THEN price END AS min_price, cast(e AS DOUBLE) AS max_price
        FROM feed""",
)
def exploded(spark, sf_dir):
    return _feed(spark, sf_dir).select(
        "o_orderkey", "event_pos", "esName", "eventCity", F.col("venueLatitude").alias("lat"),
        F.col("minPrice").alias("min_price"), F.col("maxPrice").alias("max_price"),
    )


_FEED_RUN = f"""{fx.CITIES}, {_FEED}, {fx.city_lookup_sql("city_of", "feed", "event_city")},
feed_rows AS (
  SELECT f.*, c._id AS city_id, c.country_id, c.lat AS city_lat, c.lon AS city_lon,
         CASE WHEN k % 3 = 0 THEN 'Series ' || k ELSE 'Event ' || e || ' of ' || k END AS name,
         CASE WHEN c._id IS NULL THEN 'city/country id missing' WHEN k % 13 = 0 THEN 'bad date' END AS reason
  FROM feed f LEFT JOIN city_of c ON c.target = event_city)"""
_ADDRESS = "concat_ws(', ', 'Hall ' || (k % 5), cast(k % 100 AS VARCHAR), nullif(event_city, ''))"


@query(
    "feed_run",
    f"""WITH {_FEED_RUN}
        SELECT name, CASE WHEN k % 7 <> 0 THEN 'About' WHEN k % 3 = 0 THEN '' ELSE name END AS description, {_ADDRESS} AS address,
               city_id, country_id, 'https://example.org/' || k AS website, 'p' || k AS photo,
               strftime(event_day, '%Y-%m-%d') || 'T18:30:00.000Z' AS holding_date,
               {fx.sql_text_of("event_day + INTERVAL 1110 MINUTE")} AS date_start,
               CASE WHEN k % 4 = 0 THEN cast(48.5 AS DOUBLE) ELSE city_lat END AS lat, CASE WHEN k % 4 = 0 THEN cast(9.25 AS DOUBLE) ELSE city_lon END AS lon,
               CASE WHEN k % 2 = 0 THEN price END AS min_price, cast(e AS DOUBLE) AS max_price, 'run-2' AS "operationId"
        FROM feed_rows WHERE reason IS NULL""",
)
def feed_run(spark, sf_dir):
    events, _ = feed_events(_feed(spark, sf_dir), fx.cities(spark, sf_dir), PARAMS, keys=("o_orderkey",))
    return events.select(
        "name", "description", "address", "city_id", "country_id", F.col("contacts.website").alias("website"),
        F.col("photos")[0]["full_url"].alias("photo"), "holding_date", fx.text_of("date_start").alias("date_start"),
        "lat", "lon", "min_price", "max_price", "operationId",
    )


@query("feed_rejects", f"WITH {_FEED_RUN} SELECT name, event_city AS \"eventCity\", reason FROM feed_rows WHERE reason IS NOT NULL")
def feed_rejects(spark, sf_dir):
    _, rejects = feed_events(_feed(spark, sf_dir), fx.cities(spark, sf_dir), PARAMS, keys=("o_orderkey",))
    return rejects.select("name", "eventCity", "reason")


@query(
    "union_sources",
    f"""WITH {_FEED_RUN}, {fx.SLOTS}, {fx.city_lookup_sql("slot_city", "slots", "target_city")}
        SELECT name, {_ADDRESS} AS address, city_id, '{SOURCE_FEED}' AS source FROM feed_rows WHERE reason IS NULL
        UNION ALL
        SELECT title, address, _id, '{SOURCE_SCHEDULE}' FROM slots JOIN slot_city ON target = target_city WHERE NOT sold GROUP BY ALL""",
)
def union_sources(spark, sf_dir):
    feed, _ = feed_events(_feed(spark, sf_dir), fx.cities(spark, sf_dir), PARAMS, keys=("o_orderkey",))
    both = union_events(feed, merged_events(spark, sf_dir))
    return both.select("name", "address", "city_id", "source")


# Inbox

def _submissions(spark, sf_dir):
    key = F.col("event_id")
    data = (
        F.when(key % 13 == 0, F.concat("props", F.lit("{"))).when(key % 13 == 1, F.concat(F.lit("["), "props", F.lit("]")))
        .when(key % 13 == 2, "").when(key % 13 == 3, F.concat("props", F.lit(","), "props")).otherwise(F.col("props"))
    )
    return fx.spread(fx.table(spark, sf_dir, "events"), "event_id").select(
        key.alias("_id"), data.alias("data"), (F.col("event_type") != "signup").alias("is_processed"), F.col("ts").alias("created_at")
    )


@query(
    "json_inbox_validation",
    """SELECT event_id AS _id, CASE WHEN event_id % 13 = 2 THEN 'Data content is required and must be a string'
                                    WHEN event_id % 13 IN (0, 3) THEN 'Data must be a valid JSON string' END AS reason,
              CASE WHEN event_id % 13 <> 1 THEN 'Invalid JSON data: Data must be an array' END AS error FROM events""",
)
def json_inbox_validation(spark, sf_dir):
    validated = inbox.validate_submissions(_submissions(spark, sf_dir))
    return inbox.check_dumps(validated).select("_id", "reason", "error")


@query(
    "newest_pending_page",
    "SELECT event_id AS _id FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC LIMIT 1",
)
def newest_pending_page(spark, sf_dir):
    return inbox.newest_pending(_submissions(spark, sf_dir)).select("_id")


def _dumps(events):
    """A dump of three cards per event, the last one without a title; some dumps are broken."""
    key = F.col("event_id")
    venue = F.when(key % 5 == 0, "Online event").when(key % 5 == 1, "Multiple Venues, Online").when(
        key % 5 == 2, "multiple venues").otherwise("Hall ")
    date = F.when(key % 7 == 0, "Mon, 5 Jan and few more").when(key % 7 == 1, "and one more").otherwise(" 5 May ")
    path = F.when(key % 3 == 0, "/s/").otherwise("/")
    card = _json_text("{~href~:~https://example.org", path, key, "#top~,~title~:~ T", key, " ~,~date~:~", date, "~,~venue~:~", venue, "~}")
    second = _json_text("{~href~:~ https://example.org/b", key, "~,~title~:~B~,~date~:null}")
    data = F.when(key % 17 == 0, F.concat(F.lit("{}"), card)).otherwise(
        F.concat(F.lit("["), card, F.lit(","), second, F.lit(',{"href":"x"}]'))
    )
    return events.select(
        key.cast("string").alias("_id"), data.alias("data"), F.lit(False).alias("is_processed"),
        F.lit(None).cast("timestamp").alias("processed_at"), F.lit("").alias("error_message"), F.col("ts").cast("timestamp").alias("created_at"),
    )


_CARDS = """cards AS (
  SELECT event_id AS k, 0 AS pos, 'https://example.org' || CASE WHEN event_id % 3 = 0 THEN '/s/' ELSE '/' END || event_id AS href, 'T' || event_id AS title,
         CASE WHEN event_id % 5 IN (0, 1) THEN NULL WHEN event_id % 5 = 2 THEN 3 WHEN event_id % 7 IN (0, 1) THEN 2 WHEN event_id % 3 = 0 THEN 3 ELSE 1 END AS type
  FROM events WHERE event_id % 17 <> 0
  UNION ALL SELECT event_id, 1, 'https://example.org/b' || event_id, 'B', 1 FROM events WHERE event_id % 17 <> 0)"""


@query("classify_cards", f"WITH {_CARDS} SELECT cast(k AS VARCHAR) AS page_id, pos, href, title, type, CASE WHEN type IS NULL THEN 'online' END AS reason FROM cards")
def classified(spark, sf_dir):
    return _classified(spark, sf_dir).select("page_id", "pos", "href", "title", "type", "reason")


def _classified(spark, sf_dir):
    dumps = _dumps(fx.table(spark, sf_dir, "events"))
    return classify_cards(inbox.project_cards(inbox.explode_dumps(inbox.pending(dumps))))


@query(
    "card_class_counts",
    f"""WITH {_CARDS} SELECT count(*) FILTER (WHERE type = 1) AS type1, count(*) FILTER (WHERE type = 2) AS type2,
               count(*) FILTER (WHERE type = 3) AS type3, count(*) FILTER (WHERE type IS NULL) AS skipped FROM cards""",
)
def class_counts(spark, sf_dir):
    return card_class_counts(_classified(spark, sf_dir))


def _drained(spark, sf_dir):
    """Drain the events table as a file stream and return the output folder."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = drain.read_inbox_stream(spark, sf_dir, schema, pathGlobFilter="events.parquet")
    out, checkpoint = shared_dir(spark, "drained"), shared_dir(spark, "drain-checkpoint")
    drain.drain(_dumps(stream), out, checkpoint).awaitTermination()
    return out


@query(
    "stream_inbox_drain",
    f"WITH {_CARDS} SELECT cast(k AS VARCHAR) AS page_id, pos, href, title, type FROM cards",
)
def stream_inbox_drain(spark, sf_dir):
    return drain.drained_cards(spark, _drained(spark, sf_dir)).select("page_id", "pos", "href", "title", "type")


@query(
    "stream_processed_pages",
    """SELECT cast(event_id AS VARCHAR) AS _id, TRUE AS is_processed,
              CASE WHEN event_id % 17 = 0 THEN 'Invalid JSON data: Data must be an array' ELSE '' END AS error_message FROM events""",
)
def stream_processed_pages(spark, sf_dir):
    pages = _dumps(fx.table(spark, sf_dir, "events"))
    processed = drain.processed_pages(spark, _drained(spark, sf_dir))
    return drain.mark_processed(pages, processed, F.lit(fx.AS_OF)).select("_id", "is_processed", "error_message")
