"""HTML extraction, inbox, feed files, page lookup."""

import gzip
import json

from pyspark.sql import functions as F

from posterwall.catalog import fixtures, pages as page_queries
from posterwall.operators.filters import classify_cards, is_sold_out
from posterwall.operators.series import link_groups, own_links, page_date_text
from posterwall.sources import html, inbox
from posterwall.sources.feed import explode_feed, read_feed
from posterwall.sources.tables import lookup_pages


def pages(spark, *documents):
    return spark.createDataFrame([(f"https://fienta.com/{i}", d) for i, d in enumerate(documents)], "url string, html string")


def test_tree_is_lenient():
    page = html.parse_html(
        '<!DOCTYPE html><DIV ID="a" class=\'x y\' hidden data-n=5>1<p>one<p>two<ul><li>i<li>j</ul></div><script>if (a<b) "</p>"</script>&amp;<br/>'
        "<!-- <p>no</p> --><p title=\"a > b\">q&eacute;</p></span><b>open"
    )
    assert [html._text(n) for n in html.select(page, "p")] == ["one", "two", "qé"]
    assert [html._text(n) for n in html.select(page, "#a.x li")] == ["i", "j"]
    assert html.select(page, "#a")[0].get("data-n") == "5"
    assert html.select(page, "p")[2].get("title") == "a > b" and not html.select(page, "#a.z")
    assert html.select(page, "b")[0].text == "open"
    assert html.select(html.parse_html(""), "p") == []
    assert html.select(html.parse_html('<p title="unclosed>x</p>' + "<" * 50), "p") == []


def test_event_page(spark):
    document = """<div id="event-header"><h1> Big <i>Show</i> </h1><p class="time small"> 5 May 2025 </p><button>Buy</button>
      <button>Sat 10</button><p class="location"> Hall,
      Riga </p><a class="series-item" href="https://fienta.com/x#t"><p class="text-body">1 May</p><p class="text-body">10:00</p></a>
      <a class="series-item"><p class="text-body"></p></a></div><img id="hero-image" src="img/a.jpg"><div id="desc"> <p class="a">T &amp; U</p><br>x </div>
      <div id="gmap"><div class="card-body"><p>Riga</p></div></div><div class="ticket"><b class="price">€12,50</b></div><i class="ticket-price">free</i>"""
    row = html.extract_event_pages(pages(spark, document, "", None)).orderBy("url").collect()
    first = row[0]
    assert (first["name"], first["time_text"], first["image"]) == ("Big Show", "5 May 2025", "https://fienta.com/img/a.jpg")
    assert first["description"] == '<p class="a">T &amp; U</p><br>x'
    assert first["button_texts"] == ["Buy", "Sat 10"] and first["price_texts"] == ["€12,50", "free"]
    assert [tuple(s) for s in first["series"]] == [("https://fienta.com/x#t", "1 May", "10:00"), ("", "", "")]
    assert (row[1]["name"], row[1]["image"], row[1]["series"]) == ("", "", [])
    assert row[2]["name"] == ""


def test_listing_tour_and_slot_rows(spark):
    card = '<article class="event-card"><a href="https://other/1">a</a><a href="https://fienta.com/1#x"><div class="event-card-title"><h2> T </h2></div></a><div class="event-card-body"><p class="small">D</p><p class="small">V</p></div></article>'
    rows = html.extract_listing_cards(pages(spark, card + '<article class="event-card"></article>')).collect()
    assert [tuple(r)[1:] for r in rows] == [(0, "https://fienta.com/1#x", "T", "D", "V"), (1, "", "", "", "")]
    assert inbox.project_cards(spark.createDataFrame(rows)).count() == 1

    tour = '<div class="events__item"><div class="cover-img-wrapper"><img src="s.jpg"></div><p class="block-title__text">T</p><i class="long-event__info-item">a</i><a href="/tour/1">x</a></div>'
    row = html.extract_tour_cards(pages(spark, tour)).first()
    assert (row["title"], row["venue"], row["photo"], row["link"]) == ("T", "", "s.jpg", "/tour/1")

    slot = '<div id="scheduleType_list"><div class="schedule-row"><meta itemprop="availability" content="http://schema.org/SoldOut"></div><div class="schedule-row"><div class="schedule-col-action"> РАСПРОДАНО</div></div><div class="schedule-row"><meta itemprop="startDate" content="2025-01-01T10:00:00Z"></div></div>'
    slots = html.extract_schedule_slots(pages(spark, slot))
    assert slots.count() == 3
    assert [r["pos"] for r in slots.where(~is_sold_out("availability", "action_text")).collect()] == [2]


def test_inbox(spark):
    good = json.dumps([{"href": " https://a/b#c", "title": " T ", "date": None}, {"href": "", "title": "x"}, {"title": "y"}, {"href": "h", "title": "t", "venue": " V "}])
    df = spark.createDataFrame([("1", good), ("2", '{"href":"a","title":"b"}'), ("3", "[]"), ("4", "[{"), ("5", "")], "_id string, data string")
    reasons = {r["_id"]: r["reason"] for r in inbox.validate_submissions(df).collect()}
    assert {i for i, r in reasons.items() if r is None} == {"1", "2", "3"}
    assert (reasons["4"], reasons["5"]) == (inbox.NOT_JSON, inbox.NOT_A_STRING)
    assert inbox.accepted(inbox.validate_submissions(df)).count() == 3
    assert {r["_id"] for r in inbox.check_dumps(df).where("error IS NOT NULL").collect()} == {"2", "4", "5"}
    cards = inbox.project_cards(inbox.explode_dumps(df)).orderBy("pos").collect()
    assert [(c["pos"], c["href"], c["title"], c["date_text"], c["venue_text"]) for c in cards] == [(0, "https://a/b", "T", "", ""), (3, "h", "t", "", "V")]


def test_classify(spark):
    rows = [
        ("Online, Multiple venues", "", "/x", None), ("Multiple venues", "one more", "/x", 3), ("Hall", "5 May AND FEW MORE", "/s/x", 2),
        ("Hall", "one more", "/x", 2), ("Hall", "", "/s/x", 3), ("Hall", "", "/x", 1), ("", "", "/x", 1),
    ]
    df = spark.createDataFrame(rows, "venue_text string, date_text string, href string, want int")
    assert classify_cards(df).where(~F.col("type").eqNullSafe(F.col("want"))).count() == 0


def test_feed_files(spark, tmp_path):
    feed = {"eventserie": [
        {"esName": "S", "events": [{"eventName": "A", "venueLatitude": 1.5, "venueLongitude": "2", "minPrice": True, "maxPrice": 7}, {"eventName": "B"}]},
        {"esName": "none"}, {"esName": "empty", "events": []},
    ]}
    with gzip.open(tmp_path / "feed.json.gz", "wt") as out:
        json.dump(feed, out, indent=1)
    (tmp_path / "blank.json").write_text("{}")
    rows = explode_feed(read_feed(spark, str(tmp_path))).orderBy("series_pos", "event_pos").collect()
    assert [(r["eventName"], r["esName"], r["venueLatitude"], r["venueLongitude"], r["minPrice"], r["maxPrice"]) for r in rows] == [
        ("A", "S", 1.5, None, None, 7.0), ("B", "S", None, None, None, None),
    ]


def test_lookup_keeps_misses_and_repeats(spark):
    links = spark.createDataFrame([("a",), ("a",), ("b",)], "href string")
    found = lookup_pages(links, spark.createDataFrame([("a", "x")], "url string, name string"))
    got = sorted((r["href"], r["name"], r["found"]) for r in found.collect())
    assert got == [("a", "x", True), ("a", "x", True), ("b", None, False)]


def test_link_groups_and_date_text(spark):
    item = "array<struct<href:string,date:string,time:string>>"
    series = [("https://fienta.com/s/1", "a", ""), ("https://fienta.com/1#x", "1 May", "10:00"), ("https://else/2", "z", ""), ("https://fienta.com/2", "2 May", "")]
    df = spark.createDataFrame([("u2", "T", 2, series), ("u3", "T", 3, series), ("e2", "T", 2, series[:1]), ("e3", "T", 3, [])], f"href string, title string, type int, series {item}")
    groups = {r["original_url"]: r for r in link_groups(df).collect()}
    assert set(groups) == {"u2", "u3", "e3"}
    assert groups["u2"]["links"] == ["https://fienta.com/1"] and groups["u2"]["is_same_address"]
    assert [tuple(d) for d in groups["u2"]["dates_times"]] == [("1 May", "10:00"), ("2 May", "")]
    assert groups["u3"]["links"] == ["https://fienta.com/1", "https://fienta.com/2"] and groups["u3"]["n_skipped"] == 1
    assert groups["e3"]["links"] == []
    assert df.select(F.size(own_links("series"))).first()[0] == 3

    rows = [("t", ["5"], series), ("", ["Buy", "in jan"], series), ("", ["Buy"], [("", "", "9"), ("", "1 May", "10:00")]), ("", [], [("", "2 May", "")]), ("", [], [])]
    df = spark.createDataFrame(rows, f"a string, b array<string>, c {item}")
    assert [r[0] for r in df.select(page_date_text("a", "b", "c")).collect()] == ["t", "in jan", "1 May 10:00", "2 May", ""]


def test_pages_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixtures, "DEALT_ROWS", 100)
    orders = spark.range(1000).selectExpr("id AS o_orderkey", "id AS o_custkey", "timestamp'1995-01-01' AS o_orderdate")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    for made in (page_queries._listing_pages(spark, str(tmp_path)), page_queries.listing_html(spark, str(tmp_path))):
        sizes = made.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert len(sizes) >= 10 and max(sizes) <= 300


def test_attributes_are_not_shared_between_pages():
    page = '<p class="a b" id="x" title="1 > 0">t</p>'
    first, second = html.parse_html(page), html.parse_html(page + page)
    assert [len(html.select(p, "p#x.a.b")) for p in (first, second)] == [1, 2]
    assert first.index.keys() == second.index.keys() == {"#x", ".a", ".b"}
    assert html.select(html.parse_html("<p a='1\" b>\">x</p>"), "p") == []
