"""Runs: the read side, retention, statistics, log."""

from pyspark.sql import functions as F

from posterwall.catalog import fixtures as fx
from posterwall.catalog.registry import query
from posterwall.operators import retention, runs, stats
from posterwall.operators.filters import is_run_type
from posterwall.operators.numbering import assign_batches
from posterwall.plans.common import RunParameters, to_events
from posterwall.session import materialize, shared_dir
from posterwall.sinks import tables


def _staged(spark, sf_dir):
    return assign_batches(fx.unnumbered_events(spark, sf_dir), fx.K5).drop(*fx.K5)


_LATEST = f"""{fx.OPERATIONS},
latest AS (SELECT * FROM operations WHERE NOT is_taken
           QUALIFY row_number() OVER (PARTITION BY type ORDER BY created_at DESC, _id DESC) = 1)"""


@query("latest_untaken_run", f"WITH {_LATEST} SELECT _id, type, status, is_processed, {fx.sql_text_of('created_at')} AS created_at FROM latest")
def latest_untaken_run(spark, sf_dir):
    latest = runs.latest_untaken(fx.operations(spark, sf_dir))
    return latest.select("_id", "type", "status", "is_processed", fx.text_of("created_at").alias("created_at"))


@query(
    "page_of_events",
    f"""WITH {_LATEST}, {fx.STAGED}
        SELECT operation, seq, cast(ceil(seq / 10.0) AS BIGINT) AS batch_number, name, run_id AS "operationId"
        FROM staged WHERE operation IN (SELECT _id FROM latest) AND seq > 2 AND seq <= 4""",
)
def page_of_events(spark, sf_dir):
    latest = runs.latest_untaken(fx.operations(spark, sf_dir))
    page = runs.page_of_events(_staged(spark, sf_dir), latest, page="2", per_page="2x")
    return runs.with_operation_id(page).select("operation", "seq", "batch_number", "event_data.name", "event_data.operationId")


@query(
    "page_summary",
    f"""WITH {_LATEST}, {fx.STAGED}, counted AS (SELECT _id, type, count(s.seq) AS n FROM latest LEFT JOIN staged s ON s.operation = _id GROUP BY ALL)
        SELECT _id AS operation, type, n AS total_events, greatest(1, cast(ceil(n / 2.0) AS BIGINT)) AS total_pages, 2 AS page, 2 AS per_page,
               2 >= greatest(1, ceil(n / 2.0)) AS is_last_page FROM counted""",
)
def page_summary(spark, sf_dir):
    latest = runs.latest_untaken(fx.operations(spark, sf_dir))
    return runs.page_summary(_staged(spark, sf_dir), latest, page=2, per_page=2)


@query(
    "take_runs",
    f"""WITH {_LATEST}, {fx.STAGED}, counted AS (SELECT _id, count(s.seq) AS n FROM latest LEFT JOIN staged s ON s.operation = _id GROUP BY ALL)
        SELECT _id, type, is_taken OR _id IN (SELECT _id FROM counted WHERE n <= 4) AS is_taken FROM operations""",
)
def take_runs(spark, sf_dir):
    operations = fx.operations(spark, sf_dir)
    summary = runs.page_summary(_staged(spark, sf_dir), runs.latest_untaken(operations), page=1, per_page=4)
    return runs.mark_taken(operations, summary).select("_id", "type", "is_taken")


@query(
    "run_results",
    f"""WITH {_LATEST}, {fx.STAGED} SELECT operation, type, seq, cast(ceil(seq / 10.0) AS BIGINT) AS batch_number, name
        FROM staged JOIN latest ON _id = operation""",
)
def run_results(spark, sf_dir):
    latest = runs.latest_untaken(fx.operations(spark, sf_dir))
    events = runs.events_of(_staged(spark, sf_dir), latest)
    return events.join(latest.select(F.col("_id").alias("operation"), "type"), "operation").select(
        "operation", "type", "seq", "batch_number", "event_data.name"
    )


_CUTOFF = "(timestamp '1999-01-01' - INTERVAL 30 DAY)"
_EXPIRED = f"""{fx.OPERATIONS}, {fx.STAGED},
judged AS (SELECT s.*, EXISTS (SELECT 1 FROM operations o WHERE o._id = s.operation AND status = 'success' AND is_processed
             AND finish_time < {_CUTOFF}) AND created_at < {_CUTOFF} AS gone FROM staged s)"""


@query("retention_deleted", f"WITH {_EXPIRED} SELECT operation, name, {fx.sql_text_of('created_at')} AS created_at FROM judged WHERE gone")
def retention_deleted(spark, sf_dir):
    staged = fx.unnumbered_events(spark, sf_dir)
    gone = retention.deleted_rows(staged, fx.operations(spark, sf_dir), fx.AS_OF)
    return gone.select("operation", "event_data.name", fx.text_of("created_at").alias("created_at"))


@query("retention_survivors", f"WITH {_EXPIRED} SELECT operation, name, {fx.sql_text_of('created_at')} AS created_at FROM judged WHERE NOT gone")
def retention_survivors(spark, sf_dir):
    staged = fx.unnumbered_events(spark, sf_dir)
    kept = retention.survivors(staged, fx.operations(spark, sf_dir), fx.AS_OF)
    return kept.select("operation", "event_data.name", fx.text_of("created_at").alias("created_at"))


@query("retention_deleted_count", f"WITH {_EXPIRED} SELECT count(*) AS deleted FROM judged WHERE gone")
def retention_deleted_count(spark, sf_dir):
    staged = fx.unnumbered_events(spark, sf_dir)
    return retention.deleted_rows(staged, fx.operations(spark, sf_dir), fx.AS_OF).agg(F.count(F.lit(1)).alias("deleted"))


@query(
    "run_statistics",
    """SELECT cast(l_orderkey AS VARCHAR) AS operation,
              '{"total":' || count(*) || ',"batches":' || cast(ceil(count(*) / 10.0) AS BIGINT) || ',"errors":' || count(*) FILTER (WHERE l_returnflag = 'R') || '}' AS statistics
       FROM lineitem GROUP BY l_orderkey""",
)
def run_statistics(spark, sf_dir):
    failed = fx.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    errors = failed.select(F.col("l_orderkey").cast("string").alias("operation"))
    return stats.run_statistics(fx.unnumbered_events(spark, sf_dir), errors)


@query(
    "listing_statistics",
    """SELECT event_id, '{"page_id":' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE '"' || event_id || '"' END || ',"total_cards":' || user_id || ',"total_events":0}' AS statistics
       FROM events""",
)
def listing_statistics(spark, sf_dir):
    key = F.col("event_id")
    page = F.when(key % 5 != 0, key.cast("string"))
    return fx.table(spark, sf_dir, "events").select(
        "event_id", stats.listing_statistics(page, F.col("user_id"), F.lit(0)).alias("statistics")
    )


@query(
    "run_log_text",
    """WITH lines AS (
         SELECT event_type AS operation, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n,
                '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z] user ' || user_id || ': ' || props AS line FROM events)
       SELECT operation, cast(ceil(n / 1000.0) AS BIGINT) AS chunk, string_agg(line, chr(10) ORDER BY n) AS text FROM lines GROUP BY ALL""",
)
def run_log_text(spark, sf_dir):
    log = fx.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("operation"), "ts", F.concat(F.lit("user "), "user_id", F.lit(": "), "props").alias("message"), "event_id"
    )
    return stats.log_text(log, ["ts", "event_id"])


@query(
    "run_life_cycle",
    f"""WITH {fx.OPERATIONS}
        SELECT _id, CASE WHEN status = 'processing' THEN 'processing' ELSE status END AS status,
               CASE WHEN status = 'processing' THEN NULL ELSE {fx.sql_text_of('finish_time')} END AS finish_time FROM operations""",
)
def run_life_cycle(spark, sf_dir):
    """The present state of runs that append pending, processing and their final state."""
    operations = fx.operations(spark, sf_dir)

    def state(status, updated_at, finish_time):
        return F.struct(
            status.cast("string").alias("status"), updated_at.alias("updated_at"), finish_time.alias("finish_time")
        )

    none = F.lit(None).cast("timestamp")
    started = F.col("created_at") + F.expr("INTERVAL 1 MINUTE")
    final = state(F.col("status"), F.col("finish_time"), F.col("finish_time"))
    states = F.array(
        state(F.lit("pending"), F.col("created_at"), none),
        state(F.lit("processing"), started, none),
        F.when(F.col("status") != "processing", final),
    )
    log = operations.select("_id", F.explode(F.filter(states, lambda s: s.isNotNull())).alias("s")).select("_id", "s.*")
    return stats.current_runs(log).select("_id", "status", fx.text_of("finish_time").alias("finish_time"))


@query(
    "run_type_check",
    f"""WITH {fx.OPERATIONS} SELECT _id, _id NOT LIKE '%7' AS valid FROM operations""",
)
def run_type_check(spark, sf_dir):
    wrong = F.when(F.col("_id").endswith("7"), F.lower("type")).otherwise(F.col("type"))
    return fx.operations(spark, sf_dir).select("_id", is_run_type(wrong).alias("valid"))


# Sinks: orders as events of runs, written to and read from a staged table

def _order_events(spark, sf_dir, run_id, orders=None):
    orders = fx.table(spark, sf_dir, "orders") if orders is None else orders
    rows = orders.select(
        F.concat(F.lit("order "), "o_orderkey").alias("name"), F.col("o_orderdate").alias("date_start"),
        F.col("o_totalprice").alias("min_price"), F.col("o_orderkey").alias("ord"),
    )
    return to_events(rows, RunParameters(run_id), "orders")


@query(
    "stage_and_page",
    """SELECT 'run-1' AS operation, seq, cast(ceil(seq / 10.0) AS BIGINT) AS batch_number, 'order ' || o_orderkey AS name, o_totalprice AS min_price
       FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS seq FROM orders) WHERE seq > 100 AND seq <= 150""",
)
def stage_and_page(spark, sf_dir):
    """Stage all orders as one run, then read its third page of fifty."""
    path = shared_dir(spark, "staged")
    tables.stage_events(_order_events(spark, sf_dir, "run-1"), "run-1", ["ord"], F.col("date_start"), path)
    page = tables.open_page(spark, path, "run-1", page=3, per_page=50)
    return page.select("operation", "seq", "batch_number", "event_data.name", "event_data.min_price")


def _thinned(spark, sf_dir):
    """Three staged runs after retention; the first is done and old, the second failed, the third ended late."""
    path = shared_dir(spark, "staged")
    orders = fx.table(spark, sf_dir, "orders").withColumn("run", F.col("o_orderkey") % 3)
    for number in range(3):
        events = _order_events(spark, sf_dir, f"run-{number}", orders.where(F.col("run") == number))
        tables.stage_events(events, f"run-{number}", ["ord"], F.col("date_start"), path)
    ended = F.when(F.col("run") == 2, F.max("o_orderdate")).otherwise(F.min("o_orderdate"))
    operations = orders.groupBy("run").agg(ended.alias("finish_time")).select(
        F.concat(F.lit("run-"), "run").alias("_id"), "finish_time", F.lit(True).alias("is_processed"),
        F.when(F.col("run") == 1, "error").otherwise("success").alias("status"),
    )
    tables.delete_expired(spark, path, operations, fx.AS_OF)
    return path


_LEFT = f"""SELECT 'run-' || (o_orderkey % 3) AS operation, count(*) AS n, {fx.sql_text_of("min(o_orderdate)")} AS oldest
        FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderdate < {_CUTOFF}) GROUP BY 1"""


def _left(spark, path):
    left = tables.read_staged(spark, path).groupBy("operation")
    return left.agg(F.count(F.lit(1)).alias("n"), fx.text_of(F.min("created_at")).alias("oldest"))


@query("retention_delete", _LEFT)
def retention_delete(spark, sf_dir):
    return _left(spark, _thinned(spark, sf_dir))


@query("retention_compact", _LEFT)
def retention_compact(spark, sf_dir):
    """The same after the thinned runs are rewritten and the old folders are gone."""
    path = _thinned(spark, sf_dir)
    tables.compact(spark, path, rows_per_file=1000)
    tables.drop_stale(spark, path)
    return _left(spark, path)


@query(
    "retention_pages",
    f"""WITH kept AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE o_orderkey % 3 = 0 AND o_orderdate >= {_CUTOFF}),
        runs AS (SELECT o_orderkey % 3 AS run, count(*) FILTER (WHERE o_orderkey % 3 > 0 OR o_orderdate >= {_CUTOFF}) AS n FROM orders GROUP BY 1),
        states AS (SELECT unnest(['before', 'after']) AS state)
        SELECT state, 'order ' || o_orderkey AS name, NULL::BIGINT AS total_events FROM kept, states WHERE place > 10 AND place <= 20
        UNION ALL SELECT state, 'run-' || run, n FROM runs, states""",
)
def retention_pages(spark, sf_dir):
    """The second page of a thinned run and the counts of all runs, before and after compaction."""
    path = _thinned(spark, sf_dir)

    def seen(state):
        page = tables.open_page(spark, path, "run-0", page=2, per_page=10).select(F.col("event_data.name").alias("name"))
        counts = tables.staged_counts(spark, path).select(F.col("operation").alias("name"), "total_events")
        rows = page.withColumn("total_events", F.lit(None).cast("bigint")).unionByName(counts)
        return rows.select(F.lit(state).alias("state"), "name", "total_events")

    before = materialize(seen("before"), "pages")
    tables.compact(spark, path, rows_per_file=1000)
    tables.drop_stale(spark, path)
    return before.unionByName(seen("after"))
