"""Schedule slots: filter, resolve, group, merge, batch."""

from pyspark.sql import functions as F

from posterwall.catalog import fixtures as fx
from posterwall.catalog.registry import query
from posterwall.catalog.texts import holding_sql
from posterwall.constants import LISTING_HOST, SOURCE_SCHEDULE
from posterwall.operators.filters import choose_cities, is_sold_out, split_rejects
from posterwall.operators.grouping import event_states, group_slots
from posterwall.operators.numbering import assign_batches, number_rows
from posterwall.operators.series import group_series_rows
from posterwall.operators.stats import city_scrape_stats
from posterwall.plans.common import RunParameters
from posterwall.plans.schedule import EVENT_KEEP, SLOT_KEEP, grouped_slots, merged_to_events, resolve_slots, slots_to_events
from posterwall.session import materialize, shared_dir
from posterwall.sinks.merging import MergeTable

PARAMS = RunParameters(run_id="run-1", admin_id="admin-1")


def _open_slots(spark, sf_dir, cities):
    slots = fx.slots(spark, sf_dir).where(~is_sold_out("availability", "action_text"))
    return split_rejects(resolve_slots(slots, cities, PARAMS))


_OPEN = f"""{fx.CITIES},
{fx.SLOTS},
{fx.city_lookup_sql("city_of", "slots", "target_city")},
open_slots AS (SELECT s.*, c._id AS city_id, c.country_id, c.lat, c.lon FROM slots s JOIN city_of c ON c.target = s.target_city WHERE NOT sold)"""

_GROUPS = f"""{_OPEN},
groups AS (
  SELECT tour, trim(title) AS t, trim(address) AS a, arg_min(row(title, address, city_id, country_id, description, tour_url, lat, lon), slot_ord) AS f,
         min(start) AS date_start, max(start) AS date_end, min(price) AS min_price, max(price) AS max_price
  FROM open_slots GROUP BY ALL)"""


@query(
    "group_schedule_slots",
    f"""WITH {_OPEN}
        SELECT tour, min(title) AS title, min(address) AS address, arg_min(city_id, slot_ord) AS city_id,
               arg_min(description, slot_ord) AS description, count(DISTINCT start) AS n_days,
               {fx.sql_text_of("min(start)")} AS date_start, {fx.sql_text_of("max(start)")} AS date_end,
               min(price) AS min_price, max(price) AS max_price
        FROM open_slots GROUP BY tour, trim(title), trim(address)""",
)
def group_schedule_slots(spark, sf_dir):
    slots, _ = _open_slots(spark, sf_dir, fx.cities(spark, sf_dir))
    groups = group_slots(slots, F.col("slot_pos"), SLOT_KEEP)
    return groups.select(
        "tour", "title", "address", "city_id", "description",
        F.size("days").cast("bigint").alias("n_days"),
        fx.text_of("date_start").alias("date_start"), fx.text_of("date_end").alias("date_end"),
        "min_price", "max_price",
    )


def merged_events(spark, sf_dir):
    slots, _ = _open_slots(spark, sf_dir, fx.cities(spark, sf_dir))
    return slots_to_events(slots, PARAMS)


def flat_events(events):
    """The event columns of the merge queries with plain types."""
    return events.select(
        "name", "description", "address", "city_id", "country_id", F.col("contacts.website").alias("website"),
        "holding_date", fx.text_of("date_start").alias("date_start"), fx.text_of("date_end").alias("date_end"),
        "lat", "lon", "min_price", "max_price", "source", "operationId",
    )


_MERGED = f"""{_OPEN},
{holding_sql("h", "open_slots", "title address city_id", "start")},
merged AS (
  SELECT title AS name, arg_min(description, ord) AS description, address, city_id, arg_min(country_id, ord) AS country_id,
         arg_min(tour_url, ord) AS website, min(start) AS date_start, max(start) AS date_end, min(lat) AS lat, min(lon) AS lon,
         min(price) AS min_price, max(price) AS max_price, min(ord) AS ord
  FROM open_slots GROUP BY title, address, city_id)"""
_MERGED_COLUMNS = f"""name, description, address, city_id, country_id, website, holding_date,
  {fx.sql_text_of("date_start")} AS date_start, {fx.sql_text_of("date_end")} AS date_end, lat, lon, min_price, max_price,
  '{SOURCE_SCHEDULE}' AS source, 'run-1' AS "operationId\""""


_MERGED_SQL = f"""WITH {_MERGED} SELECT {_MERGED_COLUMNS}
        FROM merged JOIN h ON h.title = name AND h.address = merged.address AND h.city_id = merged.city_id""".replace(
    "address, city_id, country_id, website", "merged.address, merged.city_id, country_id, website"
)


@query("merge_duplicate_events", _MERGED_SQL)
def merge_duplicate_events(spark, sf_dir):
    return flat_events(merged_events(spark, sf_dir))


@query("merge_events_in_batches", _MERGED_SQL)
def merge_events_in_batches(spark, sf_dir):
    """The same events from three batches of tours, one of them repeated, compacted in between."""
    slots, _ = _open_slots(spark, sf_dir, fx.cities(spark, sf_dir))
    groups = materialize(grouped_slots(slots).withColumn("batch", F.pmod(F.xxhash64("tour"), F.lit(3))), "groups")
    states = [event_states(groups.where(F.col("batch") == i), F.col("ord"), EVENT_KEEP) for i in range(3)]
    # Batch 0 comes twice, so its states are written once.
    states[0] = materialize(states[0], "states")
    table = MergeTable(shared_dir(spark, "merging"), states[0].schema)
    table.add_batch(states[2], 2)
    table.add_batch(states[0], 0)
    table.compact(spark)
    table.add_batch(states[0], 0)
    table.add_batch(states[1], 1)
    return flat_events(merged_to_events(table.merged(spark), PARAMS))


@query(
    "staged_schedule_events",
    f"""WITH {_MERGED}, numbered AS (SELECT *, row_number() OVER (ORDER BY ord) AS seq FROM merged)
        SELECT name, address, city_id, seq, cast(ceil(seq / 10.0) AS BIGINT) AS batch_number FROM numbered""",
)
def staged_schedule_events(spark, sf_dir):
    """The flagship: slots to merged events in numbered batches of one run."""
    # Written once, as the sink does it: numbering reads its input more than once.
    events = materialize(merged_events(spark, sf_dir).withColumn("operation", F.lit("run-1")), "events")
    # Numbering moves its rows, so it gets the columns that are read.
    wanted = events.select("operation", "ord", "name", "address", "city_id")
    return assign_batches(wanted, ["ord"]).select("name", "address", "city_id", "seq", "batch_number")


@query(
    "assign_batches",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, seq, cast(ceil(seq / 10.0) AS BIGINT) AS batch_number
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {fx.K5_SQL}) AS seq FROM lineitem)""",
)
def batches(spark, sf_dir):
    lineitem = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", *fx.K5)
    numbered = assign_batches(lineitem, fx.K5, operation="l_orderkey")
    return numbered.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "seq", "batch_number")


@query(
    "assign_batches_big_run",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, seq, cast(ceil(seq / 10.0) AS BIGINT) AS batch_number
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey % 3 = 0 ORDER BY l_orderkey, {fx.K5_SQL}) AS seq FROM lineitem)""",
)
def big_run(spark, sf_dir):
    """Two runs hold everything; numbered in slices, as runs too big for one task are."""
    lineitem = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", *fx.K5)
    runs = lineitem.withColumn("operation", F.col("l_orderkey") % 3 == 0)
    numbered = assign_batches(runs, ["l_orderkey", *fx.K5], max_window_rows=1000)
    return numbered.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "seq", "batch_number")


@query(
    "reject_reasons",
    f"""WITH {fx.CITIES}, narrow AS (SELECT * FROM cities WHERE contains(lower(name), 'nation_1')),
        narrow_tokens AS (SELECT * FROM tokens WHERE city_ord IN (SELECT city_ord FROM narrow)), {fx.SLOTS},
        {fx.city_lookup_sql("city_of", "slots", "target_city", "narrow", "narrow_tokens")}
        SELECT s.target_city, 'city/country id missing' AS reason, count(*) AS n
        FROM slots s LEFT JOIN city_of c ON c.target = s.target_city WHERE NOT sold AND c._id IS NULL GROUP BY ALL""",
)
def reject_reasons(spark, sf_dir):
    narrow = choose_cities(fx.cities(spark, sf_dir), city_name="Nation_1")
    _, rejects = _open_slots(spark, sf_dir, narrow)
    return rejects.groupBy("target_city", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "city_scrape_stats",
    f"""WITH {fx.CITIES},
        cards AS (SELECT cast(c_nationkey AS VARCHAR) AS c, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
        slot_counts AS (SELECT cast(s_nationkey AS VARCHAR) AS c, count(*) FILTER (WHERE l_linenumber = 1) AS skipped,
                         count(*) FILTER (WHERE l_linenumber > 1) AS added
                  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
        SELECT _id AS page_city, name, coalesce(cards.n, 0) AS scraped, coalesce(skipped, 0) AS skipped_missing_ids,
               coalesce(added, 0) AS added, CASE WHEN cards.n IS NULL THEN 'No events found on page for city ' || name END AS note
        FROM (SELECT _id, name FROM cities UNION ALL SELECT 'region ' || r_regionkey, r_name FROM region)
        LEFT JOIN cards ON cards.c = _id LEFT JOIN slot_counts ON slot_counts.c = _id""",
)
def scrape_stats(spark, sf_dir):
    """Over all customers, orders and slots; regions are cities whose page shows nothing."""
    orders = fx.table(spark, sf_dir, "orders").select("o_custkey")
    customer = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    cards = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").cast("string").alias("page_city")
    )
    supplier = fx.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("page_city"))
    slots = (
        fx.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .withColumn("reason", F.when(F.col("l_linenumber") == 1, "city/country id missing"))
    )
    ok, _ = split_rejects(slots)
    empty = fx.table(spark, sf_dir, "region").select(F.concat(F.lit("region "), "r_regionkey").alias("_id"), F.col("r_name").alias("name"))
    cities = fx.cities(spark, sf_dir).select("_id", "name").unionByName(empty)
    return city_scrape_stats(cities, cards, slots, ok)


@query(
    "series_groups",
    f"""WITH series AS (
          SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {fx.K5_SQL}) AS pos, l_linenumber % 4 = 0 AS is_series,
                 l_partkey || '-' || l_suppkey AS tail, l_shipdate + INTERVAL 570 MINUTE AS starts
          FROM lineitem)
        SELECT l_orderkey AS card, arg_min('https://{LISTING_HOST}/' || tail, pos) FILTER (WHERE NOT is_series) AS first_link,
               count(*) FILTER (WHERE NOT is_series) AS n_links, count(*) FILTER (WHERE is_series) AS n_skipped,
               count(DISTINCT cast(starts AS DATE)) FILTER (WHERE NOT is_series) AS n_days,
               {fx.sql_text_of("min(starts) FILTER (WHERE NOT is_series)")} AS date_start,
               {fx.sql_text_of("max(starts) FILTER (WHERE NOT is_series)")} AS date_end
        FROM series GROUP BY l_orderkey HAVING count(*) FILTER (WHERE NOT is_series) > 0""",
)
def series_groups(spark, sf_dir):
    lineitem = fx.table(spark, sf_dir, "lineitem")
    tail = F.concat_ws("-", "l_partkey", "l_suppkey")
    path = F.when(F.col("l_linenumber") % 4 == 0, f"https://{LISTING_HOST}/s/").otherwise(f"https://{LISTING_HOST}/")
    series = number_rows(
        lineitem.select(
            F.col("l_orderkey").alias("card"), *fx.K5, F.concat(path, tail).alias("href"),
            F.date_format("l_shipdate", "d MMM yyyy").alias("date"), F.lit("09:30").alias("time"),
        ),
        ["card"], fx.K5, "pos",
    )
    grouped = group_series_rows(series, "card", fx.AS_OF)
    return grouped.select(
        "card", "first_link", "n_links", "n_skipped", F.size("days").cast("bigint").alias("n_days"),
        fx.text_of("date_start").alias("date_start"), fx.text_of("date_end").alias("date_end"),
    )
