"""First-wins grouping, merging, numbering."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from posterwall.operators import numbering
from posterwall.operators.grouping import event_states, group_slots, merge_duplicates
from posterwall.sinks.merging import MergeTable

T = dt.datetime
SLOT = "tour int, ord int, title string, address string, start timestamp, price double, city string"
EVENT = "ord int, name string, address string, city_id string, days array<date>, date_start timestamp, date_end timestamp, min_price double, max_price double, site string"


def test_group_slots_first_wins(spark):
    slots = spark.createDataFrame(
        [
            (1, 2, "Show", "Hall", T(2025, 1, 2, 20), 5.0, "later"),
            (1, 1, "Show ", " Hall", T(2025, 1, 3, 19), None, "first"),
            (1, 3, "Show", "Other", None, None, "x"),
            (2, 1, "Show", "Hall", T(2025, 1, 3), 9.0, "y"),
        ],
        SLOT,
    )
    rows = {(r["tour"], r["address"]): r for r in group_slots(slots, F.struct("ord"), ["city"]).collect()}
    assert len(rows) == 3
    first = rows[1, " Hall"]
    assert (first["city"], first["title"], first["ord"]["ord"]) == ("first", "Show ", 1)
    assert (first["date_start"], first["date_end"]) == (T(2025, 1, 2, 20), T(2025, 1, 3, 19))
    assert first["days"] == [dt.date(2025, 1, 2), dt.date(2025, 1, 3)]
    assert (first["min_price"], first["max_price"]) == (5.0, 5.0)
    assert rows[1, "Other"]["days"] == [] and rows[1, "Other"]["date_start"] is None


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def test_slots_are_shuffled_once_and_frequent_titles_are_dealt_by_tour(spark, monkeypatch):
    rows = [
        (tour, o, f" {name}" if tour % 2 else name, place, T(2025, 1, 1 + o), None if tour % 3 else float(o), f"c{o}")
        for tour in range(400) for o in range(2) for name, place in ((None if tour % 5 == 0 else "Show", "Hall"), (f"n{tour}", ""))
    ]
    slots = spark.createDataFrame(rows, SLOT)
    order = F.struct("tour", "ord")
    at_once = group_slots(slots, order, ["city"])
    plan = at_once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "hashpartitioning(_title" in plan
    dealt = group_slots(slots, order, ["city"], hot_rows=64)
    assert "_deal" in dealt._jdf.queryExecution().executedPlan().toString()
    assert at_once.count() == 800
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, at_once.collect()))


def test_merge_duplicates(spark):
    d = dt.date
    merged = merge_duplicates(
        events(
            spark,
            [
                (2, "A", "x", "1", [d(2025, 2, 1), d(2025, 2, 3)], T(2025, 2, 1, 9), T(2025, 2, 3, 9), 3.0, 8.0, "second"),
                (1, " A", "x ", "1", [d(2025, 2, 2)], T(2025, 2, 2, 9), T(2025, 2, 2, 9), None, None, "first"),
                (3, "A", "x", "2", None, T(2025, 2, 5, 9), T(2025, 2, 7, 9), 1.0, 1.0, "other city"),
                (4, "A", "x", None, [], None, None, None, 2.0, "no city"),
            ],
        ),
        F.col("ord"),
        ["site"],
    )
    rows = {r["site"]: r for r in merged.collect()}
    assert set(rows) == {"first", "other city", "no city"}
    first = rows["first"]
    assert first["holding_date"] == "1, 2, 3 февраль 2025" and first["name"] == " A"
    assert (first["date_start"], first["date_end"]) == (T(2025, 2, 1, 9), T(2025, 2, 3, 9))
    assert (first["min_price"], first["max_price"]) == (3.0, 8.0)
    # Without a list of days only the start counts.
    other = rows["other city"]
    assert (other["holding_date"], other["date_end"]) == ("5 февраля 2025", T(2025, 2, 5, 9))
    none = rows["no city"]
    assert (none["holding_date"], none["date_start"], none["min_price"], none["max_price"]) == ("", None, 2.0, 2.0)


def test_merge_is_idempotent_and_keeps_every_key(spark):
    rows = [
        (i, f"n{i % 3}", "a", str(i % 2), [dt.date(2025, 1, 1 + i % 9)], T(2025, 1, 1 + i % 9), T(2025, 1, 1 + i % 9), float(i), float(i), f"s{i}")
        for i in range(200)
    ]
    once = merge_duplicates(events(spark, rows), F.col("ord"), ["site"])
    twice = merge_duplicates(once, F.col("ord"), ["site"])
    assert once.count() == 6
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_merging_in_batches_equals_merging_at_once(spark, tmp_path):
    day = lambda i: dt.date(2025, 1 + i % 3, 1 + i % 9)
    rows = [
        (i, f"n{i % 4} ", "a", None if i % 7 == 0 else str(i % 2), None if i % 5 == 0 else [day(i), day(i + 1)] if i % 5 > 1 else [],
         None if i % 11 == 0 else T(2025, 1, 1 + i % 9), T(2025, 2, 1 + i % 9), None if i % 3 == 0 else float(i), float(i % 6), f"s{i}")
        for i in range(120)
    ]
    whole = events(spark, rows)
    want = sorted(map(repr, merge_duplicates(whole, F.col("ord"), ["site"]).collect()))
    part = lambda i: event_states(whole.where(F.col("ord") % 3 == i), F.col("ord"), ["site"])
    table = MergeTable(str(tmp_path / "merging"), part(0).schema)
    assert table.merged(spark).count() == 0
    table.compact(spark)
    assert table.add_batch(part(2), 2) and table.add_batch(part(1), 1)
    assert not table.add_batch(part(1), 1)
    table.compact(spark)
    # A batch repeated after a failure, here even one that is compacted already, changes nothing.
    assert table.add_batch(part(1), 1) and table.add_batch(part(0), 0)
    assert sorted(map(repr, table.merged(spark).collect())) == want
    table.compact(spark)
    assert sorted(map(repr, table.merged(spark).collect())) == want
    assert not list((tmp_path / "merging" / "batches").glob("b*"))


def test_crash_before_publishing_leaves_no_part_of_a_batch(spark, tmp_path, monkeypatch):
    states = event_states(events(spark, [(1, "A", "x", "1", None, T(2025, 1, 1), None, 1.0, 1.0, "s")]), F.col("ord"), ["site"])
    table = MergeTable(str(tmp_path / "merging"), states.schema)

    def crash(*_):
        raise RuntimeError("crash")

    with monkeypatch.context() as patch:
        patch.setattr("posterwall.versions.rename", crash)
        with pytest.raises(RuntimeError):
            table.add_batch(states, 1)
    assert table.merged(spark).count() == 0
    assert table.add_batch(states, 1) and table.merged(spark).count() == 1


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120), st.integers(0, 40))
def test_numbering_in_slices_equals_window(spark, groups, limit):
    rows = [(g if i % 3 else 0, (i * 37) % len(groups), i) for i, g in enumerate(groups)]
    df = spark.createDataFrame(rows, "g int, o int, id int")
    want = {}
    seen = {}
    for g, o, i in sorted(rows):
        seen[g] = seen.get(g, 0) + 1
        want[i] = seen[g]
    got = numbering.number_rows(df, ["g"], ["o", "id"], "n", max_window_rows=limit).collect()
    assert {r["id"]: r["n"] for r in got} == want


def test_number_without_groups_and_empty(spark):
    df = spark.range(1000).withColumn("o", F.hash("id"))
    got = numbering.number_rows(df, [], ["o", "id"], "n", max_window_rows=10).orderBy("o", "id").select("n").collect()
    assert [r["n"] for r in got] == list(range(1, 1001))
    assert numbering.number_rows(df.limit(0), ["id"], ["o"], "n").count() == 0


@pytest.mark.parametrize("limit", [10, 10**6])
def test_batches_partition_a_run(spark, limit):
    df = spark.range(95).withColumn("operation", F.lit("r"))
    batches = numbering.assign_batches(df, ["id"], max_window_rows=limit)
    counts = {r["batch_number"]: r["count"] for r in batches.groupBy("batch_number").count().collect()}
    assert counts == {**{b: 10 for b in range(1, 10)}, 10: 5}
