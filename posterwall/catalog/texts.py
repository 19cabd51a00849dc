"""Scalar columns: text, links, prices, dates, holding texts."""

import datetime as dt

from pyspark.sql import functions as F

from posterwall.catalog.fixtures import spread, sql_text_of, table, text_of
from posterwall.catalog.registry import query
from posterwall.constants import MONTHS_RU_GENITIVE, MONTHS_RU_NOMINATIVE, SCHEDULE_HOST
from posterwall.functions import dates, holding, numbers, text

_WS = r"[\t\n\x{0b}\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


@query(
    "normalize_text",
    f"""SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '{_WS}+', ' ', 'g')) AS normalized,
               trim(regexp_replace(text, '{_WS}+', ' ', 'g')) AS cleaned
        FROM documents""",
)
def normalize_text(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", text.normalize("text").alias("normalized"), text.clean_address("text").alias("cleaned")
    )


@query(
    "link_columns",
    f"""SELECT page_id, trim(split_part(url, '#', 1)) AS bare,
              CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '{SCHEDULE_HOST}/tour/' || page_id
                               WHEN 2 THEN '' ELSE '{SCHEDULE_HOST}x' || page_id END AS link,
              CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '{SCHEDULE_HOST}/tour/' || page_id
                               WHEN 2 THEN NULL ELSE '{SCHEDULE_HOST}/x' || page_id END AS photo,
              CASE WHEN page_id % 4 = 2 THEN 0 ELSE 1 END AS n_photos,
              left(CASE WHEN page_id % 3 = 0 THEN url ELSE url || html END, 100) AS label
       FROM pages""",
)
def link_columns(spark, sf_dir):
    key = F.col("page_id")
    raw = (
        F.when(key % 4 == 0, F.col("url")).when(key % 4 == 1, F.concat(F.lit("/tour/"), key))
        .when(key % 4 == 2, F.lit("")).otherwise(F.concat(F.lit("x"), key))
    )
    raw_photo = F.when(key % 4 == 1, F.concat(F.lit("./tour/"), key)).otherwise(raw)
    title = F.when(key % 3 == 0, F.lit("")).otherwise(F.concat("url", "html"))
    photo = text.absolutize_photo(raw_photo)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        text.strip_fragment("url").alias("bare"),
        text.absolutize_link(raw).alias("link"),
        photo.alias("photo"),
        F.size(text.wrap_photo(photo)).alias("n_photos"),
        text.label(title, "url").alias("label"),
    )


@query(
    "city_slug",
    """SELECT c_custkey, replace(replace(replace(replace(url_encode(replace(lower(
                CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ' hall' ELSE c_name || ' (' || c_mktsegment || ')!' END), ' ', '-')),
                '%21', '!'), '%28', '('), '%29', ')'), '%27', '''') AS slug
       FROM customer""",
)
def city_slug(spark, sf_dir):
    plain = F.concat("c_mktsegment", F.lit("  hall"))
    marked = F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")!"))
    name = (
        F.when(F.col("c_custkey") % 3 == 0, plain)
        .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("Город | "), marked, F.lit(" ")))
        .otherwise(F.concat(F.lit(" | "), marked))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", text.city_slug(name).alias("slug"))


@query(
    "merge_location",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || ', ' || c_mktsegment WHEN 1 THEN c_name || ', ' || c_mktsegment
                                            WHEN 2 THEN c_name ELSE c_name || ' hall, ' || c_mktsegment END AS location,
              concat_ws(', ', c_name, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END) AS address
       FROM customer""",
)
def merge_location(spark, sf_dir):
    key = F.col("c_custkey")
    full = F.concat_ws(", ", "c_name", "c_mktsegment")
    header = F.when(key % 4 == 0, F.col("c_name")).when(key % 4 == 3, F.concat("c_name", F.lit(" hall"))).when(
        key % 4 == 1, full).otherwise(F.lit(""))
    on_map = F.when(key % 4 == 0, full).when(key % 4 == 1, F.col("c_mktsegment")).when(
        key % 4 == 2, F.col("c_name")).otherwise(F.col("c_mktsegment"))
    second = F.when(key % 2 == 0, F.lit("")).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        text.merge_locations(header, on_map).alias("location"),
        text.join_filled("c_name", second, F.lit(None).cast("string")).alias("address"),
    )


@query(
    "price_from_text",
    r"""SELECT doc_id, CASE WHEN price > 0 THEN price END AS price FROM (
          SELECT doc_id, try_cast(replace(regexp_extract(text, '(\d+(?:[.,]\d+)?)', 1), ',', '.') AS DOUBLE) AS price
          FROM documents)""",
)
def price_from_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", numbers.price_from_text("text").alias("price"))


@query(
    "ticket_price_bounds",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS attribute,
              CASE WHEN l_quantity > 0 THEN least(l_quantity, l_extendedprice) ELSE l_extendedprice END AS min_price,
              greatest(l_quantity, l_extendedprice) AS max_price
       FROM lineitem""",
)
def ticket_price_bounds(spark, sf_dir):
    euro = F.replace(F.col("l_extendedprice").cast("string"), F.lit("."), F.lit(","))
    texts = F.array(
        F.concat(F.lit("от €"), euro, F.lit(" / 7")), F.concat("l_quantity", F.lit(" EUR")), F.lit("free"), F.lit("0")
    )
    prices = numbers.prices_from_texts(texts)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        numbers.price_from_attribute(F.concat(F.lit(" "), euro, F.lit("€"))).alias("attribute"),
        F.array_min(prices).alias("min_price"),
        F.array_max(prices).alias("max_price"),
    )


# Free-form dates: every order date written in one of twelve ways. as_of is New Year of the same
# year, except for the short forms that have to roll over from the last day of the year before.

_TEXTS = (
    # (Spark pattern or None, DuckDB pattern, suffix, minutes after midnight)
    ("EEEE d. MMMM", "%A %-d. %B", " at 10:30 - 17:00", 630),
    ("EEE, d MMM", "%a, %-d %b", "", 0),
    ("EEEE d. MMMM", "%A %-d. %B", " at 09:00 - Friday 30. January at 18:00", 540),
    ("d MMM yyyy", "%-d %b %Y", " 08:05", 485),
    ("MMMM d", "%B %-d", "", 0),
    ("EEE, d MMM", "%a, %-d %b", " 19:45", 1185),
    ("MMMM d, yyyy", "%B %-d, %Y", "", 0),
    ("d. MMMM", "%-d. %B", " at 24:00", 1440),
    ("EEEE, d. MMMM", "%A, %-d. %B", " at 10:30 - 17:00", 1020),
    ("EEE d MMM", "%a %-d %b", " 07:15", 435),
    ("d MMMM", "%-d %B", " at 9:30", None),
    ("EEEE dd MMMM", "%A %d %B", " in town", None),
)
_ROLLING = (1, 5, 9)


def _dates_sql() -> str:
    written = " ".join(
        f"WHEN {i} THEN strftime(o_orderdate, '{fmt}') || '{suffix}'" for i, (_, fmt, suffix, _) in enumerate(_TEXTS)
    )
    # A short form on 29 February has no date in the year of as_of, so it does not roll over.
    leap = "strftime(o_orderdate, '%m-%d') = '02-29'"
    parsed = " ".join(
        f"WHEN {i} THEN " + ("NULL" if minutes is None else sql_text_of(f"o_orderdate + INTERVAL {minutes} MINUTE"))
        if i not in _ROLLING
        else f"WHEN {i} THEN CASE WHEN NOT {leap} THEN " + sql_text_of(f"o_orderdate + INTERVAL {minutes} MINUTE") + " END"
        for i, (_, _, _, minutes) in enumerate(_TEXTS)
    )
    return f"""SELECT o_orderkey, CASE o_orderkey % {len(_TEXTS)} {written} END AS date_text,
                      CASE o_orderkey % {len(_TEXTS)} {parsed} END AS parsed FROM orders"""


@query("parse_event_dates", _dates_sql())
def parse_event_dates(spark, sf_dir):
    key, day = F.col("o_orderkey") % len(_TEXTS), F.col("o_orderdate")
    written = F.lit(None).cast("string")
    for i, (pattern, _, suffix, _) in enumerate(_TEXTS):
        written = F.when(key == i, F.concat(F.date_format(day, pattern), F.lit(suffix))).otherwise(written)
    new_year = F.trunc(day, "year")
    rolls = key.isin(*_ROLLING)
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey").select(
        "o_orderkey", written.alias("date_text"), F.when(rolls, F.date_sub(new_year, 1)).otherwise(new_year).alias("as_of"),
        F.when(rolls & (F.month(day) == 12) & (F.dayofmonth(day) == 31), day).alias("stays"),
    )
    as_of = F.coalesce(F.col("stays").cast("date"), F.col("as_of"))
    return orders.select("o_orderkey", "date_text", text_of(dates.parse_event_date("date_text", as_of)).alias("parsed"))


@query(
    "iso_instants",
    f"""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE {sql_text_of("ts - INTERVAL 2 HOUR")} END AS parsed,
               CASE WHEN event_id % 9 = 0 THEN '' ELSE strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.000Z') END AS iso
        FROM events""",
)
def iso_instants(spark, sf_dir):
    junk = F.col("event_id") % 9 == 0
    written = F.when(junk, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
    parsed = dates.parse_iso(written)
    return table(spark, sf_dir, "events").select(
        "event_id", text_of(parsed).alias("parsed"), dates.to_iso(parsed).alias("iso")
    )


# Holding texts of all days a supplier ships on.

_GENITIVE = "[" + ", ".join(f"'{m}'" for m in MONTHS_RU_GENITIVE) + "]"
_NOMINATIVE = "[" + ", ".join(f"'{m}'" for m in MONTHS_RU_NOMINATIVE) + "]"


def holding_sql(name: str, source: str, keys: str, day: str, runs: bool = False) -> str:
    """CTEs that end in name(keys, holding_date) for the distinct days of source."""
    key_list = ", ".join(keys.split())
    listed = "array_to_string(numbers, ', ')"
    if runs:
        end = "list_min(list_filter(numbers, lambda e: e >= s AND NOT list_contains(numbers, e + 1)))"
        listed = f"""array_to_string(list_transform(list_filter(numbers, lambda x: NOT list_contains(numbers, x - 1)), lambda s:
            CASE WHEN {end} - s >= 3 THEN s || '–' || {end} ELSE array_to_string(generate_series(s, {end}), ', ') END), ', ')"""
    return f"""{name}_days AS (SELECT DISTINCT {key_list}, cast({day} AS DATE) AS d FROM {source} WHERE {day} IS NOT NULL),
{name}_months AS (SELECT {key_list}, year(d) AS y, month(d) AS m, list(day(d) ORDER BY d) AS numbers FROM {name}_days GROUP BY ALL),
{name}_years AS (SELECT {key_list}, min(y) AS y0, max(y) AS y1 FROM {name}_months GROUP BY ALL),
{name}_parts AS (
  SELECT a.*, y0, y1, CASE len(numbers) WHEN 1 THEN numbers[1] || ' ' || {_GENITIVE}[m]
     WHEN 2 THEN numbers[1] || '–' || numbers[2] || ' ' || {_NOMINATIVE}[m]
     ELSE {listed} || ' ' || {_NOMINATIVE}[m] END || CASE WHEN y0 <> y1 THEN ' ' || y ELSE '' END AS part
  FROM {name}_months a JOIN {name}_years b USING ({key_list})),
{name} AS (
  SELECT {key_list}, string_agg(part, ', ' ORDER BY y || '-' || (m - 1)) || CASE WHEN min(y0) = max(y1) THEN ' ' || min(y0) ELSE '' END AS holding_date
  FROM {name}_parts GROUP BY ALL)"""


def _days_per_supplier(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.groupBy("l_suppkey").agg(F.collect_set(F.to_date("l_shipdate")).alias("days"))


@query(
    "holding_date_text",
    f"WITH {holding_sql('h', 'lineitem', 'l_suppkey', 'l_shipdate')} SELECT l_suppkey, holding_date FROM h",
)
def holding_date_text(spark, sf_dir):
    text_column = holding.format_holding_date("days", False)
    return _days_per_supplier(spark, sf_dir).select("l_suppkey", text_column.alias("holding_date"))


@query(
    "holding_date_runs",
    f"WITH {holding_sql('h', 'lineitem', 'l_suppkey', 'l_shipdate', runs=True)} SELECT l_suppkey, holding_date FROM h",
)
def holding_date_runs(spark, sf_dir):
    text_column = holding.format_holding_date("days", True)
    return _days_per_supplier(spark, sf_dir).select("l_suppkey", text_column.alias("holding_date"))


@query(
    "retention_cutoff",
    f"""SELECT o_orderkey, {sql_text_of("o_orderdate - INTERVAL 30 DAY")} AS cutoff FROM orders""",
)
def cutoffs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text_of(dates.retention_cutoff("o_orderdate", 30)).alias("cutoff")
    )
