"""The read side: pick a run, page through its staged events."""

from pyspark.sql import Column, DataFrame, functions as F

from posterwall.constants import DEFAULT_PER_PAGE, MAX_PER_PAGE
from posterwall.functions.text import falsy_to_null
from posterwall.operators.numbering import number_rows


def latest_untaken(operations: DataFrame, run_type: str | None = None, status: str | None = None) -> DataFrame:
    """The newest run not yet taken, of one type or of each. Any status counts unless given.

    A maximum per type needs no window: each map task sends one row per type.
    """
    open_runs = operations.where(~F.coalesce("is_taken", F.lit(False)))
    if run_type is not None:
        open_runs = open_runs.where(F.col("type") == run_type)
    if status is not None:
        open_runs = open_runs.where(F.col("status") == status)
    newest = F.max_by(F.struct(*operations.columns), F.struct("created_at", "_id"))
    return open_runs.groupBy("type").agg(newest.alias("run")).select("run.*")


def _whole_number(value, default: int) -> int:
    """The integer a text starts with; the default for none and for 0."""
    text = str(value if value is not None else default).strip()
    digits = text[1:] if text[:1] in "+-" else text
    length = next((i for i, c in enumerate(digits) if c not in "0123456789"), len(digits))
    number = int(digits[:length] or 0) * (-1 if text[:1] == "-" else 1)
    return number or default


def page_bounds(page=None, per_page=None) -> tuple[int, int]:
    """(page, per_page) as served: page from 1, per_page from 1 to the maximum."""
    size = min(MAX_PER_PAGE, _whole_number(per_page, DEFAULT_PER_PAGE))
    return max(1, _whole_number(page, 1)), max(1, size)


def events_of(staged: DataFrame, runs: DataFrame) -> DataFrame:
    """Staged events of the given runs. On a table partitioned by operation the join becomes a
    dynamic partition filter."""
    return staged.join(runs.select(F.col("_id").alias("operation")).distinct(), "operation", "left_semi")


def run_results(staged: DataFrame, run_id: str) -> DataFrame:
    """All events of a run in order."""
    return staged.where(F.col("operation") == run_id).orderBy("batch_number", "seq")


def total_pages(total: Column, per_page: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / F.lit(per_page))).cast("bigint")


def page_summary(staged: DataFrame | None, runs: DataFrame, page=None, per_page=None, counts: DataFrame | None = None) -> DataFrame:
    """Per run its events, pages, and whether this page is the last; runs without events have
    one empty page. counts (operation, total_events), if known, saves counting the staged events."""
    page, per_page = page_bounds(page, per_page)
    if counts is None:
        counts = events_of(staged, runs).groupBy("operation").agg(F.count(F.lit(1)).alias("total_events"))
    return (
        runs.select(F.col("_id").alias("operation"), "type")
        .join(counts, "operation", "left")
        .withColumn("total_events", F.coalesce("total_events", F.lit(0)).cast("bigint"))
        .withColumn("total_pages", total_pages(F.col("total_events"), per_page))
        .withColumn("page", F.lit(page))
        .withColumn("per_page", F.lit(per_page))
        .withColumn("is_last_page", F.col("page") >= F.col("total_pages"))
    )


def answered(summary: DataFrame, page=None, per_page=None) -> DataFrame:
    """The summary, or one row of zeros when there is no run to answer with."""
    page, per_page = page_bounds(page, per_page)
    spark = summary.sparkSession
    zeros = {"total_events": 0, "total_pages": 0, "page": page, "per_page": per_page, "is_last_page": True}
    row = spark.range(1).select(
        *[F.lit(zeros.get(f.name)).cast(f.dataType).alias(f.name) for f in summary.schema.fields]
    )
    found = summary.limit(1).select(F.lit(1).alias("_found"))
    return summary.unionByName(row.join(found, F.lit(True), "left_anti"))


def page_of_events(staged: DataFrame, runs: DataFrame, page=None, per_page=None) -> DataFrame:
    """One page of the events of each given run.

    While a run is whole its `seq` is the position, so a page is a range of seq: a filter that
    reaches the scan however deep the page is. Rows that retention has removed leave gaps; then
    the remaining rows are numbered anew.
    """
    page, per_page = page_bounds(page, per_page)
    events = events_of(staged, runs)
    gaps = (
        events.groupBy("operation")
        .agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"))
        .where((F.col("low") != 1) | (F.col("high") != F.col("n")))
    )
    position = "seq"
    if not gaps.isEmpty():
        events = number_rows(events, ["operation"], ["batch_number", "seq"], "_position")
        position = "_position"
    skip = (page - 1) * per_page
    return events.where(F.col(position).between(skip + 1, skip + per_page)).drop("_position")


def with_operation_id(staged: DataFrame) -> DataFrame:
    """Payloads that do not name their run get its id."""
    run_id = F.coalesce(falsy_to_null(F.col("event_data.operationId")), F.col("operation"))
    return staged.withColumn("event_data", F.col("event_data").withField("operationId", run_id))


def mark_taken(operations: DataFrame, summaries: DataFrame) -> DataFrame:
    """The runs table with is_taken set where page_summary says that the last page was read."""
    taken = summaries.where("is_last_page").select(F.col("operation").alias("_id"), F.lit(True).alias("_taken"))
    return (
        operations.join(taken, "_id", "left")
        .withColumn("is_taken", F.coalesce("_taken", "is_taken", F.lit(False)))
        .drop("_taken")
        .select(*operations.columns)
    )
