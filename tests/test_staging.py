"""Crashes, repeats and conflicts: versions, staged parts, retention, pages, life cycle, log, the listing stream."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from posterwall import versions
from posterwall.operators import lifecycle, stats
from posterwall.plans.common import RunParameters
from posterwall.schemas import CITIES, EVENT_FIELDS, OPERATIONS, RAW_PAGES
from posterwall.sinks import staging, tables
from posterwall.sources.tables import read_cities
from posterwall.streaming import drain, listing

OLD, NEW = dt.datetime(2025, 1, 1), dt.datetime(2025, 3, 1)


class Crash(Exception):
    pass


def crash(*_args, **_more):
    raise Crash


def events_frame(spark, first, last):
    columns = [F.lit(None).cast(kind).alias(c) for c, kind in EVENT_FIELDS.items() if c != "name"]
    return spark.range(first, last).select("id", F.concat(F.lit("e"), "id").alias("name"), *columns)


def names(rows):
    return [r["event_data"]["name"] for r in rows.orderBy("seq").collect()]


# Versioned tables

def test_crash_before_the_rename_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(3), path)
    with monkeypatch.context() as patched:
        patched.setattr(versions, "rename", crash)
        with pytest.raises(Crash):
            tables.replace_table(spark.range(9), path)
    assert versions.read(spark, path, "id BIGINT").count() == 3
    tables.replace_table(spark.range(9), path)
    assert versions.read(spark, path, "id BIGINT").count() == 9
    assert versions.read(spark, path, "id BIGINT", at=1).count() == 3


def test_two_writers_are_told_apart(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.version(spark, path) == 0 and versions.read(spark, path, "id BIGINT").count() == 0
    base = tables.replace_table(spark.range(3), path)
    tables.replace_table(spark.range(4), path, base)
    with pytest.raises(versions.WriteConflict):
        tables.replace_table(spark.range(5), path, base)
    assert versions.read(spark, path, "id BIGINT").count() == 4
    versions.forget(spark, path, keep=1)
    assert versions.version(spark, path) == 2 and versions.read(spark, path, "id BIGINT").count() == 4


def test_sync_survives_a_crash(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cities")
    kind = "_id string, country_id string, name string, sort int, coordinates struct<lat:string,lon:string>, input_ord int"
    first = spark.createDataFrame([("1", "r", "A", 1, None, 0)], kind)
    second = spark.createDataFrame([("2", "r", "B", 1, None, 0)], kind)
    tables.sync_cities(spark, first, path)
    for replace_all in (False, True):
        with monkeypatch.context() as patched:
            patched.setattr(versions, "rename", crash)
            with pytest.raises(Crash):
                tables.sync_cities(spark, second, path, replace_all)
        assert [r["_id"] for r in read_cities(spark, path).collect()] == ["1"]
    tables.sync_cities(spark, second, path)
    assert {r["_id"]: r["city_ord"] for r in versions.read(spark, path, CITIES).collect()} == {"1": 1, "2": 2}


# Staged parts

def test_parts_replace_themselves_and_number_on(spark, tmp_path):
    path = str(tmp_path / "staged")
    stage = lambda a, b, part: tables.stage_events(events_frame(spark, a, b), "r/1", ["id"], F.lit(NEW), path, part=part)
    stage(0, 13, 0)
    stage(13, 20, 1)
    stage(20, 20, 2)
    stage(13, 20, 1)
    rows = stage(20, 25, 3)
    assert names(rows) == [f"e{i}" for i in range(25)]
    assert [r["seq"] for r in rows.orderBy("seq").collect()] == list(range(1, 26))
    assert {r["batch_number"] for r in rows.collect()} == {1, 2, 3}
    assert [(r["operation"], r["total_events"]) for r in tables.staged_counts(spark, path).collect()] == [("r/1", 25)]
    assert names(tables.open_page(spark, path, "r/1", 2, 8)) == [f"e{i}" for i in range(8, 16)]
    # The whole run again replaces all its parts.
    assert names(stage(100, 103, None)) == ["e100", "e101", "e102"]
    assert tables.drop_stale(spark, path) >= 4
    assert names(tables.read_staged(spark, path)) == ["e100", "e101", "e102"]


def test_crash_before_the_manifest_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "staged")
    tables.stage_events(events_frame(spark, 0, 5), "r", ["id"], F.lit(NEW), path)
    with monkeypatch.context() as patched:
        patched.setattr(staging, "_measured", crash)
        with pytest.raises(Crash):
            tables.stage_events(events_frame(spark, 0, 50), "r", ["id"], F.lit(NEW), path)
    assert names(tables.read_staged(spark, path)) == [f"e{i}" for i in range(5)]
    assert names(tables.stage_events(events_frame(spark, 0, 7), "r", ["id"], F.lit(NEW), path)) == [f"e{i}" for i in range(7)]


def test_a_page_opens_its_own_file_only(spark, tmp_path):
    path = str(tmp_path / "staged")
    for part in range(4):
        tables.stage_events(events_frame(spark, 10 * part, 10 * part + 10), "r", ["id"], F.lit(NEW), path, part=part)
    page = tables.open_page(spark, path, "r", 3, 5)
    assert names(page) == [f"e{i}" for i in range(10, 15)]
    assert len(page.inputFiles()) == 1 and "part=1" in page.inputFiles()[0]
    assert len(tables.open_page(spark, path, "r", 2, 8).inputFiles()) == 2
    assert tables.open_page(spark, path, "r", 50, 8).count() == tables.open_page(spark, path, "none").count() == 0


def test_retention_tombstones_pages_and_compaction(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "staged")
    created = F.when(F.col("seq") % 3 == 0, F.lit(NEW)).otherwise(F.lit(OLD))
    tables.stage_events(events_frame(spark, 1, 31), "a", ["id"], created, path)
    tables.stage_events(events_frame(spark, 1, 6), "b", ["id"], F.lit(OLD), path)
    tables.stage_events(events_frame(spark, 1, 6), "open", ["id"], F.lit(OLD), path)
    done = [("a", "success", True, OLD), ("b", "success", True, OLD), ("open", "processing", False, None)]
    ops = spark.createDataFrame(done, "_id string, status string, is_processed boolean, finish_time timestamp")
    with monkeypatch.context() as patched:
        patched.setattr(versions, "rename", crash)
        with pytest.raises(Crash):
            tables.delete_expired(spark, path, ops, dt.datetime(2025, 2, 15), 30)
    assert tables.read_staged(spark, path).count() == 40
    assert tables.delete_expired(spark, path, ops, dt.datetime(2025, 2, 15), 30) == 25
    assert tables.delete_expired(spark, path, ops, dt.datetime(2025, 2, 15), 30) == 0
    left = [f"e{i}" for i in range(3, 31, 3)]

    def check():
        staged = tables.read_staged(spark, path)
        assert names(staged.where("operation = 'a'")) == left and staged.where("operation = 'b'").count() == 0
        assert staged.where("operation = 'open'").count() == 5
        assert names(tables.open_page(spark, path, "a", 2, 4)) == left[4:8]
        assert names(tables.open_page(spark, path, "a", 3, 4)) == left[8:]
        assert tables.open_page(spark, path, "b").count() == 0
        counts = {r["operation"]: r["total_events"] for r in tables.staged_counts(spark, path).collect()}
        assert counts == {"a": 10, "b": 0, "open": 5}

    check()
    assert tables.compact(spark, path, rows_per_file=4) == 10
    check()
    assert len(staging.file_index(spark, path, "a").collect()) <= 3
    assert tables.drop_stale(spark, path) == 2
    check()
    assert tables.compact(spark, path) == 0
    # A compacted run is thinned out again later, and staged again.
    assert tables.delete_expired(spark, path, ops, dt.datetime(2025, 6, 1), 30) == 10
    assert names(tables.stage_events(events_frame(spark, 1, 4), "a", ["id"], F.lit(NEW), path)) == ["e1", "e2", "e3"]


# Life cycle and log

def requests(spark, *rows):
    return spark.createDataFrame([(i, s, dt.datetime(2025, 1, 1, 0, minute)) for i, s, minute in rows], "_id string, status string, updated_at timestamp")


def test_life_cycle_refuses_illegal_steps(spark, tmp_path):
    path = str(tmp_path / "states")
    ask = lambda *rows: {r["_id"]: (r["taken"], r["reason"] is None) for r in tables.advance_runs(requests(spark, *rows), path).collect()}
    assert ask(("a", "pending", 0), ("b", "processing", 0), ("c", "pending", 0), ("d", "pending", 0), ("d", "pending", 1)) == {
        "a": (True, True), "b": (False, False), "c": (True, True), "d": (False, False)
    }
    # At the same minute as before, and asked for twice: the order of the life cycle decides.
    assert ask(("a", "processing", 0), ("c", "success", 0)) == {"a": (True, True), "c": (False, False)}
    assert ask(("a", "processing", 9)) == {"a": (False, True)}
    assert ask(("a", "success", 9)) == {"a": (True, True)}
    for status in ("pending", "processing", "error", None, "unheard of"):
        assert ask(("a", status, 10)) == {"a": (False, False)}
    current = {r["_id"]: r for r in stats.current_runs(tables.read_run_states(spark, path)).collect()}
    assert {i: r["status"] for i, r in current.items()} == {"a": "success", "c": "pending"}
    assert current["a"]["finish_time"] == dt.datetime(2025, 1, 1, 0, 9) and current["c"]["finish_time"] is None

    dead = lifecycle.dead_runs(stats.current_runs(tables.read_run_states(spark, path)), F.lit(dt.datetime(2025, 1, 1, 1)), 30)
    tables.advance_runs(dead, path)
    closed = stats.current_runs(tables.read_run_states(spark, path)).where("_id = 'c'").first()
    assert (closed["status"], closed["errorText"]) == ("error", lifecycle.DIED)


def test_log_keeps_its_order_and_repeats_replace(spark, tmp_path):
    path = str(tmp_path / "log")
    lines = lambda a, b: spark.range(a, b).select("id", F.lit(OLD).alias("ts"), F.col("id").cast("string").alias("message"))
    for part, (a, b) in ((1, (10, 30)), (0, (0, 10)), (1, (10, 25)), (1, (10, 25))):
        tables.append_log(lines(a, b).repartition(3), path, "r 1", part, ["id"])
    text = "\n".join(r["text"] for r in stats.log_text(tables.read_log(spark, path), ["part", "line"], chunk_lines=7).orderBy("chunk").collect())
    assert [line.split("] ")[1] for line in text.split("\n")] == [str(i) for i in range(25)]


# The listing stream

def inbox_and_pages(spark, path):
    html = "<div id='event-header'><h1>E{0}</h1><p class='location'>Hall, Berlin</p><p class='time'>5 May 2026 18:00</p></div>"
    for part in range(3):
        rows = []
        for i in range(4 * part, 4 * part + 4):
            card = json.dumps([{"href": f"https://fienta.com/{i}", "title": "T", "date": "", "venue": "Hall"}])
            rows.append((str(i), "{" if i == 5 else card, False, None, "", None))
        spark.createDataFrame(rows, RAW_PAGES).coalesce(1).write.mode("append").parquet(path)
    return spark.createDataFrame([(f"https://fienta.com/{i}", html.format(i)) for i in range(12) if i != 7], "url string, html string")


@pytest.mark.parametrize("place", ["stage", "log"])
def test_a_killed_batch_leaves_no_trace(spark, tmp_path, monkeypatch, place):
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "run")
    html = inbox_and_pages(spark, inbox)
    cities = spark.createDataFrame([("c1", "k1", "Берлин | Berlin", 1, None, 1)], CITIES)
    places = listing.Places(root, f"{root}/checkpoint")

    def run():
        pages = drain.read_inbox_stream(spark, inbox, RAW_PAGES, max_files=1)
        return listing.run_listing(pages, html, cities, RunParameters("r"), dt.datetime(2026, 1, 1), places, F.lit(NEW))

    module, name = (staging, "_measured") if place == "stage" else (tables, "append_log")
    whole, calls = getattr(module, name), []

    def second_time_fails(*args, **more):
        calls.append(1)
        return crash() if len(calls) == 2 else whole(*args, **more)

    with monkeypatch.context() as patched:
        patched.setattr(module, name, second_time_fails)
        with pytest.raises(Exception, match="Crash"):
            run()
    assert stats.current_runs(tables.read_run_states(spark, places.of("states"))).first()["status"] == "processing"
    state = run().first()
    assert (state["status"], json.loads(state["statistics"])) == ("error", {"page_id": None, "total_cards": 11, "total_events": 10})
    rows = tables.read_staged(spark, places.of("staged")).orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(1, 11))
    assert sorted(r["event_data"]["name"] for r in rows) == sorted(f"E{i}" for i in range(12) if i not in (5, 7))
    assert [r["href"] for r in listing.rejects(spark, "r", places).collect()] == ["https://fienta.com/7"]
    pages = listing.processed_pages(spark, "r", places).collect()
    assert sorted(int(r["page_id"]) for r in pages) == list(range(12)) and [r["page_id"] for r in pages if r["error_message"]] == ["5"]
    log = tables.read_log(spark, places.of("log")).orderBy("part", "line").collect()
    assert len(log) == 7 and log[1]["message"].startswith("Saved 4")
    with pytest.raises(listing.IllegalStep):
        run()


def test_states_table_has_all_columns(spark, tmp_path):
    assert tables.read_run_states(spark, str(tmp_path / "none")).columns == [c.split()[0] for c in OPERATIONS.split(", ")]
