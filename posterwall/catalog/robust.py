"""Queries over rows that break shortcuts: NULL keys, repeated pages, absent tables, runs without events."""

from pyspark.sql import functions as F

from posterwall import versions
from posterwall.catalog import fixtures as fx
from posterwall.catalog.feeds import _submissions
from posterwall.catalog.pages import _TITLE
from posterwall.catalog.registry import query
from posterwall.operators import stats
from posterwall.operators.numbering import assign_batches
from posterwall.operators.runs import run_results as results_of_run
from posterwall.session import shared_dir
from posterwall.sinks import tables
from posterwall.sources import html
from posterwall.sources.tables import pages_of, read_cities, read_countries

_NULL_RUNS = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, seq, cast(ceil(seq / 10.0) AS BIGINT) AS batch_number
    FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN l_orderkey % 3 > 0 THEN l_orderkey % 3 END
                                       ORDER BY l_orderkey, {fx.K5_SQL}) AS seq FROM lineitem)"""


def _null_runs(spark, sf_dir, **limits):
    lineitem = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", *fx.K5)
    runs = lineitem.withColumn("operation", F.when(F.col("l_orderkey") % 3 > 0, F.col("l_orderkey") % 3))
    numbered = assign_batches(runs, ["l_orderkey", *fx.K5], **limits)
    return numbered.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "seq", "batch_number")


@query("assign_batches_null_run", _NULL_RUNS)
def null_run(spark, sf_dir):
    """A third of all rows has no run; every group is numbered by one task."""
    return _null_runs(spark, sf_dir)


@query("assign_batches_null_run_slices", _NULL_RUNS)
def null_run_slices(spark, sf_dir):
    """The same numbers from slices."""
    return _null_runs(spark, sf_dir, max_window_rows=1000)


@query(
    "linked_page_titles",
    f"""SELECT url, {_TITLE} AS text FROM pages WHERE page_id % 7 = 0""",
)
def linked_page_titles(spark, sf_dir):
    """Few pages are linked, some of them twice; many were crawled twice."""
    pages = fx.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    again = pages.where("page_id % 2 = 0").withColumn("html", F.concat("html", F.lit("<!-- again -->")))
    links = pages.where("page_id % 7 = 0").select("url")
    linked = pages_of(pages.unionByName(again), links.unionByName(links))
    return html.extract_field(linked, "article h1", keys=("url",))


@query(
    "run_statistics_of_all_runs",
    """SELECT cast(o_orderkey AS VARCHAR) AS operation,
              '{"total":' || count(l_orderkey) || ',"batches":' || cast(ceil(count(l_orderkey) / 10.0) AS BIGINT)
              || ',"errors":' || (CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) || '}' AS statistics
       FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def run_statistics_of_all_runs(spark, sf_dir):
    """Runs without events, with errors only, or with neither have a row as well."""
    orders = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    known = fx.unnumbered_events(spark, sf_dir).join(orders.select(F.col("key").cast("string").alias("operation")), "operation", "left_semi")
    errors = orders.where("key % 5 = 0").select(F.col("key").cast("string").alias("operation"))
    return stats.run_statistics(known, errors, orders.select(F.col("key").cast("string").alias("_id")))


@query(
    "final_run_states",
    """SELECT event_id, CASE WHEN event_id % 3 = 1 AND user_id % 2 = 1 THEN 'error' ELSE 'success' END AS status FROM events""",
)
def final_run_states(spark, sf_dir):
    source = F.element_at(F.array(F.lit("eventim"), F.lit("fienta"), F.lit("kontramarka")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = fx.table(spark, sf_dir, "events").select("event_id", source.alias("source"), (F.col("user_id") % 2).alias("errors"))
    return rows.select("event_id", stats.final_status("source", F.col("errors")).alias("status"))


@query(
    "inbox_append",
    """SELECT event_id AS _id, event_id % 13 NOT IN (0, 2, 3) AS accepted FROM events""",
)
def inbox_append(spark, sf_dir):
    path = shared_dir(spark, "inbox")
    tables.append_submissions(_submissions(spark, sf_dir), f"{path}/pages", f"{path}/rejected", F.current_timestamp())
    pages = spark.read.parquet(f"{path}/pages").where("not is_processed").select("_id", F.lit(True).alias("accepted"))
    return pages.unionByName(spark.read.parquet(f"{path}/rejected").select("_id", F.lit(False).alias("accepted")))


@query(
    "sync_absent_tables",
    """SELECT 'city ' || n_nationkey AS _id, CAST(n_nationkey + 1 AS BIGINT) AS city_ord FROM nation
       UNION ALL SELECT 'country ' || r_regionkey, NULL FROM region""",
)
def sync_absent_tables(spark, sf_dir):
    """Both syncs into tables that do not exist, twice, so that the second inserts nothing."""
    path = shared_dir(spark, "sync")
    nation, region = fx.table(spark, sf_dir, "nation"), fx.table(spark, sf_dir, "region")
    none = F.lit(None)
    cities = nation.select(
        F.concat(F.lit("city "), "n_nationkey").alias("_id"), F.col("n_regionkey").cast("string").alias("country_id"),
        F.col("n_name").alias("name"), none.cast("int").alias("sort"),
        none.cast("struct<lat: string, lon: string>").alias("coordinates"), F.col("n_nationkey").cast("bigint").alias("input_ord"),
    )
    countries = region.select(
        F.concat(F.lit("country "), "r_regionkey").alias("_id"), F.col("r_name").alias("name"), none.cast("string").alias("flag_url"),
        F.col("r_regionkey").cast("bigint").alias("input_ord"),
    )
    for _ in range(2):
        tables.sync_cities(spark, cities, f"{path}/cities")
        tables.sync_countries(spark, countries, f"{path}/countries", F.current_timestamp())
    synced = read_cities(spark, f"{path}/cities").select("_id", "city_ord")
    return synced.unionByName(read_countries(spark, f"{path}/countries").select("_id", F.lit(None).cast("bigint").alias("city_ord")))


@query(
    "replace_and_read_run",
    f"""SELECT l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, {fx.K5_SQL}) AS seq FROM lineitem""",
)
def replace_and_read_run(spark, sf_dir):
    """A staged table replaced by itself through the sink, and a run read back in order."""
    lineitem = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", *fx.K5)
    path = shared_dir(spark, "replace")
    numbered = assign_batches(lineitem.withColumn("operation", F.lit("run")), ["l_orderkey", *fx.K5])
    first = tables.replace_table(numbered, path)
    tables.replace_table(versions.read(spark, path, numbered.schema), path, first)
    return results_of_run(versions.read(spark, path, numbered.schema), "run").select("l_linenumber", "l_partkey", F.col("seq"))
