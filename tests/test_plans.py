"""Small runs of the three sources, row by row."""

import datetime as dt

from pyspark.sql import functions as F

from posterwall.operators.filters import classify_cards
from posterwall.plans import feed, listing, schedule
from posterwall.plans.common import RunParameters, union_events
from posterwall.schemas import EVENT_FIELDS

CITY = "_id string, country_id string, name string, sort int, coordinates struct<lat:string,lon:string>, city_ord bigint"
FEED_ROW = (
    "file string, series_pos int, event_pos int, esName string, esText string, esLink string, esPictureBig string, esPicture string, esPictureSmall string, "
    "eventName string, eventDateIso8601 string, eventVenue string, eventStreet string, eventZip string, eventCity string, eventLink string, "
    "venueLatitude double, venueLongitude double, minPrice double, maxPrice double"
)


def cities(spark):
    return spark.createDataFrame(
        [("1", "lv", "Рига | Riga", 1, ("56.9", "24.1"), 1), ("2", None, "Таллин | Tallinn", 1, ("0", "0"), 2)], CITY
    )


def feed_rows(spark):
    row = lambda e, **k: tuple({**dict(zip(FEED_NAMES, ["f", 0, e] + [None] * 17)), **k}.values())
    FEED_NAMES = [c.split()[0] for c in FEED_ROW.split(", ")]
    return spark.createDataFrame(
        [
            row(0, esName="S", eventCity="Riga", eventDateIso8601="2025-01-01T10:00:00+02:00", eventVenue="Hall", esPicture="p", minPrice=1.0),
            row(1, esName="S", eventName="E", esText="text", eventCity="RIGA ", venueLatitude=0.0, venueLongitude=5.0, eventLink="l"),
            row(2, esName="S", eventCity="Tallinn"),
            row(3, esName="S", eventCity="Riga", eventDateIso8601="bad"),
            row(4, esName="S", eventCity="Paris"),
            row(5, esName="S"),
        ],
        FEED_ROW,
    )


def test_feed(spark):
    events, rejects = feed.feed_events(feed_rows(spark), cities(spark), RunParameters("r"))
    assert tuple(events.columns) == (*EVENT_FIELDS, "ord")
    rows = {r["ord"]["event_pos"]: r for r in events.collect()}
    assert set(rows) == {0, 1}
    assert (rows[0]["name"], rows[0]["description"], rows[0]["holding_date"]) == ("S", "", "2025-01-01T08:00:00.000Z")
    assert (rows[0]["lat"], rows[0]["is_special_point_on_map"], rows[0]["photos"][0]["full_url"]) == (56.9, False, "p")
    assert (rows[1]["lat"], rows[1]["lon"], rows[1]["holding_date"], rows[1]["contacts"]["website"]) == (0.0, 5.0, "", "l")
    assert {r["ord"]["event_pos"]: r["reason"] for r in rejects.collect()} == {
        2: "city/country id missing", 3: "bad date", 4: "city/country id missing", 5: "city/country id missing",
    }
    # The run's own city and country come first, its city name stands in for a missing one.
    events, rejects = feed.feed_events(feed_rows(spark), cities(spark), RunParameters("r", country_id="xx", city_name="tallinn"))
    assert {r["ord"]["event_pos"]: (r["city_id"], r["country_id"]) for r in events.collect()} == {
        0: ("1", "xx"), 1: ("1", "xx"), 2: ("2", "xx"), 5: ("2", "xx"),
    }


def slot(start, place="Hall", price="5", sold="", city="", more=""):
    return (
        f'<div class="schedule-row"><meta itemprop="startDate" content="{start}"><div class="schedule-col-main"><span class="city">{city}</span>'
        f'<span class="place">{place}</span></div><meta itemprop="price" content="{price}"><i itemprop="availability" content="{sold}"></i>{more}</div>'
    )


def test_schedule(spark):
    host = "https://www.kontramarka.de"
    card = lambda title, link: f'<div class="events__item"><p class="block-title__text">{title}</p><a href="{link}">x</a></div>'
    city_pages = spark.createDataFrame(
        [(f"{host}/city/riga/", card("Show", "/tour/1") + card("Show", f"{host}/tour/2") + card("Nothing", "/about") + card("Lost", "/tour/404"))], "url string, html string"
    )
    tours = [
        (f"{host}/tour/1", slot("2025-02-01T10:00:00Z", price="7,5") + slot("2025-02-02T10:00:00Z") + slot("2025-02-03T10:00:00Z", sold="SoldOut") + slot("x", city="Nowhere")),
        (f"{host}/tour/2", slot("2025-02-05T10:00:00Z", price="abc")),
    ]
    tour_pages = spark.createDataFrame([(u, f'<div id="scheduleType_list">{h}</div>') for u, h in tours], "url string, html string")
    events, rejects = schedule.schedule_events(cities(spark), city_pages, tour_pages, RunParameters("r", city_name="riga"))
    (event,) = events.collect()
    assert (event["name"], event["address"], event["city_id"]) == ("Show", "Hall, Hall", "1")
    assert event["holding_date"] == "1, 2, 5 февраль 2025" and event["contacts"]["website"] == f"{host}/tour/1"
    assert (event["min_price"], event["max_price"], event["lat"]) == (5.0, 7.5, 56.9)
    assert event["date_end"] == dt.datetime(2025, 2, 5, 10)
    assert [r["target_city"] for r in rejects.collect()] == ["Nowhere"]


def test_listing(spark):
    base = "https://fienta.com"
    event = lambda name, date, place: f'<div id="event-header"><h1>{name}</h1><p class="time">{date}</p><p class="location">{place}</p></div><b class="ticket-price">9</b>'
    item = lambda url, date: f'<a class="series-item" href="{url}"><p class="text-body">{date}</p><p class="text-body">19:00</p></a>'
    html = {
        f"{base}/one": event("One", "Wednesday 28. January at 10:30", "Hall, Riga"),
        f"{base}/many": f'<div id="event-header">{item(base + "/d1", "28 Jan 2026")}{item(base + "/d2", "29 Jan 2026")}{item(base + "/s/x", "1 Jan 2026")}</div>',
        f"{base}/d1": event("D1", "1 Jan 2026", "Hall, Riga"),
        f"{base}/d2": event("D2", "junk", "Hall, Riga"),
        f"{base}/far": event("Far", "1 Jan 2026", "Hall, Paris"),
        f"{base}/noname": event("", "1 Jan 2026", "Riga"),
    }
    cards = [("one", "Hall", ""), ("many", "Hall", "and few more"), ("many", "Multiple venues", ""), ("gone", "Hall", ""), ("far", "", ""), ("noname", "", ""), ("gone2", "Multiple venues", ""), ("one", "Online", "")]
    df = spark.createDataFrame([(i, f"{base}/{h}", "T", v, d) for i, (h, v, d) in enumerate(cards)], "card_ord int, href string, title string, venue_text string, date_text string")
    events, rejects = listing.listing_events(
        classify_cards(df), spark.createDataFrame(list(html.items()), "url string, html string"), cities(spark), RunParameters("r"), dt.date(2026, 1, 1)
    )
    got = [(r["ord"]["type"], r["name"], r["holding_date"], r["contacts"]["website"][len(base):]) for r in events.orderBy("ord").collect()]
    assert got == [
        (1, "One", "28 января 2026", "/one"), (2, "D1", "28–29 январь 2026", "/d1"), (3, "D1", "1 января 2026", "/d1"),
    ]
    assert sorted((r["href"][len(base):], r["reason"]) for r in rejects.collect()) == [
        ("/d2", "no date"), ("/far", "no city"), ("/gone", "no page"), ("/gone2", "no page"), ("/noname", "no name"),
    ]
    assert union_events(events, events).count() == 6
