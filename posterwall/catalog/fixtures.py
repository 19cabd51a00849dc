"""Event-listing inputs derived from the driver's tables, and the same inputs as SQL.

Each fixture covers its whole source table, so the work of a query grows with the tables.
"""

import datetime as dt
import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from posterwall.constants import RUN_TYPES
from posterwall.sources.tables import read_table

# A total order of the line items of an order.
K5 = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
K5_SQL = ", ".join(K5)
AS_OF = dt.datetime(1999, 1, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash the rows of a table that is read by fewer tasks than there are cores over all cores,
    for queries that work hard on each row. A big table is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


# Rows that a task of `dealt` works on, at most and about.
DEALT_ROWS = 50_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Hash the rows of a table over all cores, and over more tasks as it grows. However the files of a
    table are cut, a task reads whole row groups, so neither their number nor their size deals out the work."""
    tasks = -(-df.count() // DEALT_ROWS)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, tasks), *keys)


def text_of(ts) -> Column:
    """Timestamps leave a query as text, the same in every engine and time zone."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def sql_text_of(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


# Cities: one per nation. 'NATION_1' is part of 'NATION_10', so the order of cities decides.

def cities(spark, sf_dir) -> DataFrame:
    key = F.col("n_nationkey")
    unknown = key % 5 == 0
    return table(spark, sf_dir, "nation").select(
        key.cast("string").alias("_id"),
        F.col("n_regionkey").cast("string").alias("country_id"),
        F.concat(F.lit("Город "), key, F.lit(" | "), "n_name").alias("name"),
        key.alias("sort"),
        F.struct(
            F.when(unknown, "0").otherwise(F.concat(key + 30, F.lit(".5"))).alias("lat"),
            F.when(unknown, "0").otherwise(F.concat(key + 10, F.lit(".25"))).alias("lon"),
        ).alias("coordinates"),
        key.cast("bigint").alias("city_ord"),
    )


CITIES = """cities AS (
  SELECT cast(n_nationkey AS VARCHAR) AS _id, cast(n_regionkey AS VARCHAR) AS country_id,
         'Город ' || n_nationkey || ' | ' || n_name AS name,
         CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE cast(n_nationkey + 30.5 AS DOUBLE) END AS lat,
         CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE cast(n_nationkey + 10.25 AS DOUBLE) END AS lon,
         cast(n_nationkey AS BIGINT) AS city_ord
  FROM nation),
tokens AS (
  SELECT DISTINCT city_ord, trim(lower(part)) AS tok
  FROM (SELECT city_ord, unnest(string_split(name, '|')) AS part FROM cities))"""


def city_lookup_sql(name: str, source: str, target: str, cities: str = "cities", tokens: str = "tokens") -> str:
    """CTE name(target, _id, country_id, city_ord, lat, lon): first city per distinct target."""
    return f"""{name} AS (
  SELECT m.target, c._id, c.country_id, c.city_ord, c.lat, c.lon FROM (
    SELECT x.target, min(t.city_ord) AS city_ord
    FROM (SELECT DISTINCT {target} AS target FROM {source}) x
    JOIN {tokens} t ON contains(lower(x.target), t.tok) OR contains(t.tok, lower(x.target))
    WHERE x.target <> '' GROUP BY 1) m
  JOIN {cities} c ON c.city_ord = m.city_ord)"""


# Schedule slots: one per line item, the order is the tour.

def slots(spark, sf_dir) -> DataFrame:
    lineitem = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    return joined.select(
        F.col("l_orderkey").alias("tour"),
        F.col("p_name").alias("title"),
        F.concat_ws(", ", "s_name", "n_name").alias("address"),
        F.col("n_name").alias("target_city"),
        F.col("l_shipdate").alias("start"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_returnflag") == "R", "http://schema.org/SoldOut")
        .otherwise("http://schema.org/InStock").alias("availability"),
        F.lit("Билеты").alias("action_text"),
        F.concat_ws("-", F.lit("slot"), "l_linenumber", "l_partkey", "l_suppkey").alias("description"),
        F.lit(None).cast("string").alias("photo_url"),
        F.concat(F.lit("https://example.org/tour/"), "l_orderkey").alias("tour_url"),
        F.col("l_orderkey").alias("page_city_ord"),
        F.lit(0).alias("card_pos"),
        F.struct(*K5).alias("slot_pos"),
    )


SLOTS = f"""slots AS (
  SELECT l_orderkey AS tour, p_name AS title, s_name || ', ' || n_name AS address,
         n_name AS target_city, l_shipdate AS start, l_extendedprice AS price,
         'slot-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS description,
         'https://example.org/tour/' || l_orderkey AS tour_url, row({K5_SQL}) AS slot_ord,
         row(l_orderkey, {K5_SQL}) AS ord, l_returnflag = 'R' AS sold
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey)"""


# Runs: one per order.

def operations(spark, sf_dir) -> DataFrame:
    kind = F.col("o_custkey") % 3
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("_id"),
        F.when(kind == 0, RUN_TYPES[0]).when(kind == 1, RUN_TYPES[1]).otherwise(RUN_TYPES[2]).alias("type"),
        F.when(status == "F", "success").when(status == "O", "processing").otherwise("error").alias("status"),
        (F.col("o_orderdate") + F.expr("INTERVAL 5 MINUTES")).alias("finish_time"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("is_processed"),
        (F.col("o_orderkey") % 2 == 1).alias("is_taken"),
        F.col("o_orderdate").alias("created_at"),
    )


OPERATIONS = f"""operations AS (
  SELECT cast(o_orderkey AS VARCHAR) AS _id,
         CASE o_custkey % 3 WHEN 0 THEN '{RUN_TYPES[0]}' WHEN 1 THEN '{RUN_TYPES[1]}' ELSE '{RUN_TYPES[2]}' END AS type,
         CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'processing' ELSE 'error' END AS status,
         o_orderdate + INTERVAL 5 MINUTE AS finish_time,
         o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_processed,
         o_orderkey % 2 = 1 AS is_taken, o_orderdate AS created_at
  FROM orders)"""


def unnumbered_events(spark, sf_dir) -> DataFrame:
    """Events of runs: one per line item; half of the payloads do not name their run."""
    run_id = F.col("l_orderkey").cast("string")
    return table(spark, sf_dir, "lineitem").select(
        run_id.alias("operation"),
        F.struct(
            F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("name"),
            F.when(F.col("l_linenumber") % 2 == 0, run_id).alias("operationId"),
        ).alias("event_data"),
        F.col("l_shipdate").alias("created_at"),
        *K5,
    )


STAGED = f"""staged AS (
  SELECT cast(l_orderkey AS VARCHAR) AS operation, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS name,
         cast(l_orderkey AS VARCHAR) AS run_id, l_shipdate AS created_at,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY {K5_SQL}) AS seq
  FROM lineitem)"""
