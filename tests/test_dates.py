"""Date parsing and holding texts."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from posterwall.functions import dates as d, holding as h

D = dt.datetime
AS_OF = dt.date(2026, 1, 20)  # a Tuesday


def parse(spark, rows, as_of=AS_OF):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    out = df.select("i", d.parse_event_date("a", as_of, F.col("b")).alias("t")).collect()
    return [r["t"] for r in sorted(out, key=lambda r: r["i"])]


@pytest.mark.parametrize(
    "text, time, want",
    [
        ("Wednesday 28. January at 10:30 - 17:00", None, D(2026, 1, 28, 10, 30)),
        ("Wednesday 28. January at 09:00 - Friday 30. January at 18:00", None, D(2026, 1, 28, 9)),
        ("Wed, 28 Jan", None, D(2026, 1, 28)),
        ("Wed, 28 Jan", "19:00", D(2026, 1, 28, 19)),
        ("Mon, 5 Jan", None, D(2027, 1, 5)),  # passed, next year; the weekday is not checked
        ("Wed, 20 Jan", None, D(2026, 1, 20)),  # today stays
        ("Wed, 05 Jan", None, None),  # no leading zero
        ("28 Jan 2026", None, D(2026, 1, 28)),
        ("28 Jan 2026 19:15", None, D(2026, 1, 28, 19, 15)),
        ("January 28", None, D(2026, 1, 28)),
        ("january 28 at 08:00", None, D(2026, 1, 28, 8)),
        ("January 28, 2024", None, D(2024, 1, 28)),
        ("5 January", None, D(2026, 1, 5)),  # a long form does not roll over
        ("Thursday 28. January at 10:30", None, None),  # wrong weekday
        ("28. January at 9:30", None, None),  # two digits
        ("28. January at 24:00", None, D(2026, 1, 29)),
        ("28. January at 25:00", None, None),
        ("28. January at 25:00 - 17:00", None, D(2026, 1, 28, 17)),
        ("Wednesday, 28. January at 10:30 - 17:00", None, D(2026, 1, 28, 17)),
        ("Wednesday, 28 January at 10:30", None, None),
        ("29 February", None, None),
        ("31 April", None, None),
        ("Sun, 29 Feb", None, None),
        ("Wednesday 28. January", None, None),
        ("Wednesday 28. January - Friday", None, D(2026, 1, 28)),
        (" 28 January", None, None),
        (" 28 January ", "at 10:00 ", D(2026, 1, 28, 10)),
        ("junk", None, None),
        ("", "19:00", None),
        (None, None, None),
    ],
)
def test_parse_event_date(spark, text, time, want):
    assert parse(spark, [(text, time)]) == [want]


def test_leap_day_in_leap_year(spark):
    assert parse(spark, [("29 February", None), ("Thu, 29 Feb", None)], dt.date(2024, 1, 1)) == [D(2024, 2, 29)] * 2


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.datetimes(D(2025, 1, 1), D(2025, 12, 31, 23, 59)), min_size=1, max_size=30))
def test_written_dates_come_back(spark, moments):
    """Any moment written in any supported way is read as itself."""
    ways = ("%A {d}. %B at %H:%M", "%A {d} %B at %H:%M - 23:59", "{d}. %B at %H:%M", "%B {d} at %H:%M", "{d} %b %Y %H:%M", "%a, {d} %b %H:%M")
    moments = [m.replace(second=0, microsecond=0) for m in moments]
    rows = [(m.strftime(ways[i % len(ways)].format(d=m.day)), None) for i, m in enumerate(moments)]
    assert parse(spark, rows, dt.date(2025, 1, 1)) == moments


def test_array_and_iso(spark):
    df = spark.createDataFrame([([("28 Jan 2026", "10:00"), ("x", ""), ("29 Jan 2026", None)],)], "x array<struct<date:string,time:string>>")
    assert df.select(d.parse_event_dates("x", AS_OF)).first()[0] == [D(2026, 1, 28, 10), D(2026, 1, 29)]
    df = spark.createDataFrame([("2026-01-28T10:00:00+02:00",), ("2026-01-28",), ("x",), ("",), (None,)], "x string")
    got = [tuple(r) for r in df.select(d.parse_iso("x"), d.to_iso(d.parse_iso("x"))).collect()]
    assert got == [
        (D(2026, 1, 28, 8), "2026-01-28T08:00:00.000Z"), (D(2026, 1, 28), "2026-01-28T00:00:00.000Z"),
        (None, ""), (None, ""), (None, ""),
    ]


def texts(spark, lists, **options):
    rows = [(i, [dt.date.fromisoformat(x) for x in days] if days is not None else None) for i, days in enumerate(lists)]
    df = spark.createDataFrame(rows, "i int, x array<date>").select("i", h.format_holding_date("x", **options).alias("y"))
    return [r["y"] for r in sorted(df.collect(), key=lambda r: r["i"])]


LISTS = [
    ["2025-02-12"],
    ["2025-02-19", "2025-02-12"],
    ["2025-02-12", "2025-02-13", "2025-02-14"],
    ["2025-02-12", "2025-02-13", "2025-02-14", "2025-02-15", "2025-02-17", "2025-02-12"],
    ["2025-03-01", "2025-11-05"],
    ["2024-12-12", "2025-01-15"],
    [],
    None,
]


def test_holding_texts(spark):
    assert texts(spark, LISTS, collapse_runs=True) == [
        "12 февраля 2025", "12–19 февраль 2025", "12, 13, 14 февраль 2025", "12–15, 17 февраль 2025",
        "5 ноября, 1 марта 2025", "12 декабря 2024, 15 января 2025", "", "",
    ]
    assert texts(spark, LISTS, collapse_runs=False)[3] == "12, 13, 14, 15, 17 февраль 2025"
    fixed = texts(spark, LISTS, collapse_runs=True, chronological=True, genitive=True)
    assert fixed[1] == "12–19 февраля 2025" and fixed[4] == "1 марта, 5 ноября 2025"


def test_day_runs(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1, 2, 3, 4],), ([1, 3, 4, 8, 9, 10, 11, 31],), ([],)], "x array<int>")
    assert [r[0] for r in df.select(h.format_day_runs("x")).collect()] == ["1, 2, 3", "1–4", "1, 3, 4, 8–11, 31", ""]
