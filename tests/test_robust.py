"""Rows that break shortcuts: NULL groups, repeated pages, odd HTML, empty parameters, absent runs."""

import time

import pytest
from pyspark.sql import functions as F

from posterwall.operators import runs, stats
from posterwall.operators.numbering import number_rows
from posterwall.plans.common import RunParameters
from posterwall.plans.feed import feed_events
from posterwall.sources import html
from posterwall.sources.feed import explode_feed, read_feed
from posterwall.sources.tables import pages_of


def test_null_groups_are_numbered_alike_in_slices(spark):
    rows = [(None if i % 3 == 0 else str(i % 3), None if i % 2 else "x", i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, h string, i int")
    whole = sorted(map(tuple, number_rows(df, ["g", "h"], ["i"]).collect()), key=repr)
    sliced = sorted(map(tuple, number_rows(df, ["g", "h"], ["i"], max_window_rows=40).collect()), key=repr)
    assert whole == sliced
    assert sorted(r[3] for r in whole if r[0] is None and r[1] is None) == list(range(1, 151))


def test_one_page_per_linked_url(spark):
    pages = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("c", "4"), (None, "5")], "url string, html string")
    links = spark.createDataFrame([("a",), ("a",), ("c",), ("z",), (None,)], "url string")
    first = sorted(map(tuple, pages_of(pages, links).collect()))
    assert [u for u, _ in first] == ["a", "c"]
    assert sorted(map(tuple, pages_of(pages.repartition(3), links).collect())) == first


def test_open_comments_tags_and_quotes_run_to_the_end():
    for page, text in (("<p>a<!-- b <p>c", "a"), ("<p>a</p><a href='x", "a"), ("<p>a</p><a <b", "a"), ("<p>a</p><!x", "a")):
        assert html._text(html.parse_html(page).root[0]).startswith(text)


@pytest.mark.parametrize("unit", ["<!--", '<a "', "<a '", "<a <", "<!"])
def test_parsing_time_is_linear(unit):
    def seconds(n: int) -> float:
        page = "<p>x</p>" + unit * (n // len(unit))
        start = time.perf_counter()
        html.parse_html(page)
        return time.perf_counter() - start

    seconds(100_000)
    assert seconds(1_000_000) < 10 * max(seconds(500_000), 0.05)


def test_text_elements_hold_no_tags():
    page = html.parse_html("<title>a &amp; <b>c</b></title><textarea><p class='price'>1</p></textarea><p class='price'>﻿ 2 \x1c</p>")
    assert [html._text(n) for n in html.select(page, ".price")] == ["2 \x1c"]
    assert html._text(html.select(page, "title")[0]) == "a & <b>c</b>"


def test_documents_of_one_file_keep_their_order(spark, tmp_path):
    lines = ['{"eventserie":[{"esName":"s%d","events":[{"eventName":"e"}]}]}' % i for i in range(5)]
    (tmp_path / "feed.json").write_text("\n".join(lines))
    rows = explode_feed(read_feed(spark, str(tmp_path / "feed.json"), multi_line=False))
    assert rows.select("file", "document", "series_pos", "event_pos").distinct().count() == 5


def test_empty_parameters_are_no_ids(spark):
    cities = spark.createDataFrame(
        [("c1", "k1", "Берлин | Berlin", None, None, 1)],
        "_id string, country_id string, name string, sort int, coordinates struct<lat: string, lon: string>, city_ord long",
    )
    feed = spark.createDataFrame(
        [("f", 0, 0, "Berlin")], "file string, series_pos int, event_pos int, eventCity string"
    )
    for name in ("esName", "esText", "esLink", "esPictureBig", "esPicture", "esPictureSmall", "eventName", "eventDateIso8601",
                 "eventVenue", "eventStreet", "eventZip", "eventLink"):
        feed = feed.withColumn(name, F.lit("2026-01-01" if "Date" in name else "x"))
    for name in ("venueLatitude", "venueLongitude", "minPrice", "maxPrice"):
        feed = feed.withColumn(name, F.lit(1.0))
    for given, want in (("", ("c1", "k1")), (None, ("c1", "k1")), ("p", ("p", "p"))):
        events, rejects = feed_events(feed, cities, RunParameters("r", city_id=given, country_id=given))
        assert [(r.city_id, r.country_id) for r in events.collect()] == [want]
        assert rejects.count() == 0


def test_statistics_of_runs_without_events(spark):
    staged = spark.createDataFrame([("a",)] * 11, "operation string")
    errors = spark.createDataFrame([("a",), ("b",), ("b",)], "operation string")
    known = spark.createDataFrame([("a",), ("c",)], "_id string")
    got = dict(map(tuple, stats.run_statistics(staged, errors, known).collect()))
    assert got == {
        "a": '{"total":11,"batches":2,"errors":1}', "b": '{"total":0,"batches":0,"errors":2}', "c": '{"total":0,"batches":0,"errors":0}',
    }


def test_answer_without_a_run(spark):
    staged = spark.createDataFrame([("a", 1, 1)], "operation string, batch_number long, seq long")
    none = spark.createDataFrame([], "_id string, type string")
    row = runs.answered(runs.page_summary(staged, none, 2, 5), 2, 5).first()
    assert (row.operation, row.total_events, row.total_pages, row.page, row.per_page) == (None, 0, 0, 2, 5)
    one = spark.createDataFrame([("a", "t")], "_id string, type string")
    assert [r.operation for r in runs.answered(runs.page_summary(staged, one)).collect()] == ["a"]
