"""Read side, sync, retention and sinks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from posterwall import versions
from posterwall.operators import runs, stats, sync
from posterwall.schemas import CITIES, COUNTRIES, EVENT_FIELDS, OPERATIONS
from posterwall.sinks import tables
from posterwall.sources.tables import read_cities, read_countries

T = dt.datetime
RUN = "_id string, type string, status string, is_processed boolean, is_taken boolean, finish_time timestamp, created_at timestamp"


@pytest.mark.parametrize(
    "page, size, want",
    [(None, None, (1, 20)), ("0", "0", (1, 20)), ("-5", "-5", (1, 1)), ("3", "500", (3, 100)), ("2abc", "7.9", (2, 7)), ("x", "", (1, 20)), (4, 1, (4, 1))],
)
def test_page_bounds(page, size, want):
    assert runs.page_bounds(page, size) == want


def operations(spark):
    old, new = T(2025, 1, 1), T(2025, 3, 1)
    return spark.createDataFrame(
        [
            ("a", "t1", "success", True, False, old, old), ("b", "t1", "processing", False, None, None, new),
            ("c", "t1", "success", True, True, new, T(2025, 4, 1)), ("d", "t2", "error", True, False, old, old),
            ("e", "t2", "success", False, False, old, T(2024, 1, 1)),
        ],
        RUN,
    )


def test_latest_untaken(spark):
    latest = lambda **k: {r["_id"] for r in runs.latest_untaken(operations(spark), **k).collect()}
    assert latest() == {"b", "d"}
    assert latest(run_type="t1", status="success") == {"a"}
    assert latest(run_type="none") == set()


def events_frame(spark, n):
    columns = [F.lit(None).cast(kind).alias(c) for c, kind in EVENT_FIELDS.items() if c != "name"]
    return spark.range(n).select("id", F.concat(F.lit("e"), "id").alias("name"), *columns)


def test_stage_page_take_and_retention(spark, tmp_path):
    path = str(tmp_path / "staged")
    for run, n, created in (("a", 25, T(2025, 1, 1)), ("b", 45, T(2025, 3, 1)), ("d", 3, T(2025, 1, 1))):
        staged = tables.stage_events(events_frame(spark, n), run, ["id"], F.lit(created), path)
        assert staged.count() == n
    # A rerun overwrites its own run only.
    assert tables.stage_events(events_frame(spark, 25), "a", ["id"], F.lit(T(2025, 1, 1)), path).count() == 25
    staged = tables.read_staged(spark, path)
    assert staged.count() == 73

    ops = operations(spark)
    latest = runs.latest_untaken(ops, "t1")
    summary = runs.page_summary(staged, latest, 3, 20).first()
    assert (summary["total_events"], summary["total_pages"], summary["is_last_page"]) == (45, 3, True)
    pages = [
        [r["event_data"]["name"] for r in runs.page_of_events(staged, latest, p, 20).orderBy("seq").collect()] for p in (1, 2, 3, 4)
    ]
    assert [len(p) for p in pages] == [20, 20, 5, 0]
    assert sum(pages, []) == [f"e{i}" for i in range(45)]
    assert [r["seq"] for r in runs.run_results(staged, "b").collect()] == list(range(1, 46))
    assert runs.with_operation_id(staged.where("operation = 'd'")).select("event_data.operationId").distinct().first()[0] == "d"

    taken = runs.mark_taken(ops, runs.page_summary(staged, latest, 3, 20))
    assert {r["_id"] for r in taken.where("is_taken").collect()} == {"b", "c"}
    not_last = runs.mark_taken(ops, runs.page_summary(staged, latest, 1, 20))
    assert {r["_id"] for r in not_last.where("is_taken").collect()} == {"c"}

    deleted = tables.delete_expired(spark, path, ops, T(2025, 2, 15), 30)
    assert deleted == 25
    left = {r["operation"]: r["count"] for r in tables.read_staged(spark, path).groupBy("operation").count().collect()}
    assert left == {"b": 45, "d": 3}
    assert tables.delete_expired(spark, path, ops, T(2025, 2, 15), 30) == 0


def test_pages_after_partial_removal(spark, tmp_path):
    path = str(tmp_path / "staged")
    tables.stage_events(events_frame(spark, 30), "b", ["id"], F.lit(T(2025, 3, 1)), path)
    gaps = tables.read_staged(spark, path).where(F.col("seq") % 2 == 0)
    latest = runs.latest_untaken(operations(spark), "t1")
    page = runs.page_of_events(gaps, latest, 2, 10).orderBy("seq").collect()
    assert [r["seq"] for r in page] == [22, 24, 26, 28, 30]


def test_empty_run_has_one_page(spark, tmp_path):
    path = str(tmp_path / "staged")
    tables.stage_events(events_frame(spark, 1), "z", ["id"], F.lit(T(2025, 3, 1)), path)
    summary = runs.page_summary(tables.read_staged(spark, path), runs.latest_untaken(operations(spark), "t1")).first()
    assert (summary["total_events"], summary["total_pages"], summary["is_last_page"]) == (0, 1, True)


def test_sync_cities(spark, tmp_path):
    path = str(tmp_path / "cities")
    spark.createDataFrame([], CITIES).write.parquet(path)
    incoming = lambda rows: spark.createDataFrame(rows, "_id string, country_id string, name string, sort int, coordinates struct<lat:string,lon:string>, input_ord int")
    first = incoming([("1", "r", "A", 0, None, 0), ("2", "r", "B", 5, ("1", "2"), 1), ("1", "r", "again", 1, None, 2)])
    assert tuple(tables.sync_cities(spark, first, path).first()) == (2, 0)
    assert tuple(tables.sync_cities(spark, first, path).first()) == (0, 0)
    second = incoming([("3", "r", "C", None, None, 0), ("2", "r", "changed", 1, None, 1)])
    assert tuple(tables.sync_cities(spark, second, path).first()) == (1, 0)
    rows = {r["_id"]: r for r in read_cities(spark, path).collect()}
    assert {i: (r["name"], r["sort"], r["city_ord"]) for i, r in rows.items()} == {"1": ("A", 999, 1), "2": ("B", 5, 2), "3": ("C", 999, 3)}
    assert rows["1"]["coordinates"]["lat"] == "0"
    assert tuple(tables.sync_cities(spark, second, path, replace_all=True).first()) == (2, 3)
    assert read_cities(spark, path).count() == 2
    assert tuple(tables.sync_cities(spark, second.limit(0), path, replace_all=True).first()) == (0, 2)
    assert read_cities(spark, path).count() == 0


def test_sync_countries(spark, tmp_path):
    path = str(tmp_path / "countries")
    spark.createDataFrame([], COUNTRIES).write.parquet(path)
    incoming = spark.createDataFrame([("1", "R", None, 0), ("2", "S", "u", 1)], "_id string, name string, flag_url string, input_ord int")
    assert tuple(tables.sync_countries(spark, incoming, path, F.lit(T(2025, 1, 1))).first()) == (2, 0)
    assert {(r["_id"], r["flag_url"]) for r in read_countries(spark, path).collect()} == {("1", ""), ("2", "u")}


def test_run_states_and_log(spark, tmp_path):
    path = str(tmp_path / "operations")
    template = {c.split()[0]: None for c in OPERATIONS.split(", ")}
    for status, at, end in (("pending", 1, None), ("processing", 2, None), ("success", 3, T(2025, 1, 3))):
        row = {**template, "_id": "r", "type": "t", "status": status, "created_at": T(2025, 1, 1), "updated_at": T(2025, 1, at), "finish_time": end}
        tables.append_run_state(spark.createDataFrame([tuple(row.values())], OPERATIONS), path)
    current = stats.current_runs(spark.read.schema(OPERATIONS).parquet(path)).collect()
    assert [(r["_id"], r["status"]) for r in current] == [("r", "success")]

    log = spark.range(25).select(F.lit("r").alias("operation"), F.lit(T(2025, 1, 1)).alias("ts"), F.col("id").cast("string").alias("message"), "id")
    chunks = stats.log_text(log, ["id"], chunk_lines=10).orderBy("chunk").collect()
    assert [len(c["text"].split("\n")) for c in chunks] == [10, 10, 5]
    assert chunks[2]["text"].split("\n")[0] == "[2025-01-01T00:00:00.000Z] 20"


def test_replace_table_over_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    for at_least in (2, 4):
        tables.replace_table(versions.read(spark, path, "id BIGINT").where(f"id >= {at_least}"), path)
        assert versions.read(spark, path, "id BIGINT").count() == 5 - at_least


def test_first_per_id(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "_id string, input_ord int, v string")
    assert {(r["_id"], r["v"]) for r in sync.first_per_id(df).collect()} == {("a", "y"), ("b", "z")}
