"""String, number and JSON columns on hand-computed rows."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from posterwall.functions import numbers as n, text as t

NBSP = "\u00a0"


def column(spark, values, build, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}").select("i", build(F.col("x")).alias("y"))
    return [r["y"] for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_normalize(spark):
    values = ["Йошкар-Ола", "Ёлка", "Zürich", "Łódź", "ß", f" A{NBSP}{NBSP}b\t\nc ", "", None, "Ǟé́", "\ufeffx"]
    want = ["иошкар-ола", "елка", "zurich", "łodz", "ß", "a b c", "", "", "ae", "x"]
    assert column(spark, values, t.normalize) == want
    twice = column(spark, want, t.normalize)
    assert twice == want


def test_normalize_decomposes_all_code_points(spark):
    skipped = lambda c: c.isspace() or c in "|\ufeff"
    codes = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and not skipped(chr(c))]
    blocks = ["|".join(codes[i : i + 512]) for i in range(0, len(codes), 512)]
    bare = lambda char: "".join(x for x in unicodedata.normalize("NFD", char) if not "\u0300" <= x <= "\u036f")
    # Letters are lowered by the JVM, whose version of Unicode may be another one.
    want = ["|".join(map(bare, low.split("|"))) for low in column(spark, blocks, F.lower)]
    got = column(spark, blocks, t.normalize)
    assert [(x, y) for a, b in zip(got, want) for x, y in zip(a.split("|"), b.split("|")) if x != y] == []
    assert column(spark, ["서울 각", "ガガ", "東京 ばか"], t.normalize) == [unicodedata.normalize("NFD", x) for x in ("서울 각", "ガガ", "東京 ばか")]


def test_trim_collapse_address(spark):
    values = [f"{NBSP}a  b\u3000", "\n", None, "a\nb \t c"]
    assert column(spark, values, t.ws_trim) == ["a  b", "", None, "a\nb \t c"]
    assert column(spark, values, t.clean_address) == ["a b", "", "", "a b c"]


def test_city_tokens_and_slug(spark):
    values = ["Москва | Moscow", "Лондон", " | New  York ", "| |", "", None, "А | It's (b)!*~"]
    assert column(spark, values, t.city_tokens) == [
        ["москва", "moscow"], ["лондон"], ["new york"], [], [], [], ["а", "it's (b)!*~"],
    ]
    slugs = column(spark, values, t.city_slug)
    assert slugs[0] == "moscow" and slugs[2] == "new-york" and slugs[6] == "it's-(b)!*~"
    assert slugs[1] == "%D0%BB%D0%BE%D0%BD%D0%B4%D0%BE%D0%BD"


def test_links_and_photos(spark):
    assert column(spark, ["/tour/1", "http://x/y", "", None], lambda c: t.absolutize_link(c, "https://h")) == [
        "https://h/tour/1", "http://x/y", "", "",
    ]
    assert column(spark, ["./a.jpg", "//a", "https://b", "", "c"], lambda c: t.absolutize_photo(c, "https://h")) == [
        "https://h/a.jpg", "https://h/a", "https://b", None, "https://h/c",
    ]
    assert column(spark, [" https://a/b#c#d ", "#x", "q"], t.strip_fragment) == ["https://a/b", "", "q"]
    wrapped = column(spark, ["u", "", None], t.wrap_photo)
    assert [len(w) for w in wrapped] == [1, 0, 0] and wrapped[0][0]["full_url"] == "u"


def test_merge_locations(spark):
    rows = [("Hall", "Hall, Riga", "Hall, Riga"), ("Hall, Riga", "Riga", "Hall, Riga"), ("A", "B", "A, B"), ("", "B", "B"), ("A", None, "A"), (None, None, "")]
    df = spark.createDataFrame(rows, "a string, b string, want string")
    assert df.where(t.merge_locations("a", "b") != F.col("want")).count() == 0


def test_first_filled_and_join(spark):
    df = spark.createDataFrame([("", "b", None)], "a string, b string, c string")
    row = df.select(t.first_filled("a", "c", "b").alias("f"), t.join_filled("a", "b", "c", F.lit("d")).alias("j")).first()
    assert (row["f"], row["j"]) == ("b", "b, d")
    assert column(spark, ["x" * 120, "", None], lambda c: F.length(t.label(c, F.lit("href")))) == [100, 4, 4]


@pytest.mark.parametrize(
    "value, valid, array",
    [
        ('{"k":1}', True, False), ('{"k":1}{', False, False), ("[]", True, True), ("1,2", False, False),
        ("1],[2", False, False), ("null", True, False), ("", False, False), ('{"a":', False, False),
        ('"x"', True, False), ("{'a':1}", False, False), ('1,"end":1}{', False, False), (None, False, False),
        (' [1, {"a": [2]}] ', True, True), ("[1,]", False, False), ("[1] 2", False, False),
    ],
)
def test_is_json(spark, value, valid, array):
    assert column(spark, [value], t.is_json) == [valid]
    assert column(spark, [value], t.is_json_array) == [array]


def test_prices(spark):
    values = ["€12,50", "1 200,50", "1.200,50", "0", "free", None, "from 7 to 9"]
    assert column(spark, values, n.price_from_text) == [12.5, 1.0, 1.2, None, None, None, 7.0]
    attributes = ["12,5", "12,5,1", " 7 EUR", "-3.5x", ".5", "abc", "", None, "1e2"]
    assert column(spark, attributes, n.price_from_attribute) == [12.5, 12.5, 7.0, -3.5, 0.5, None, None, None, 100.0]


def test_coordinates(spark):
    values = ["lat=55,7 lon=37,6", "LAT = 1.5; LON=-2", "55 37", ""]
    points = column(spark, values, n.coordinates_from_text)
    assert [p and (p["lat"], p["lon"]) for p in points] == [(55.7, 37.6), (1.5, -2.0), None, None]
    rows = [(("55.7", "37.6"),), (("0", "0"),), (("", "1"),), (None,)]
    df = spark.createDataFrame(rows, "x struct<lat:string,lon:string>")
    points = [r[0] for r in df.select(n.coordinates_from_struct("x")).collect()]
    assert [p and (p["lat"], p["lon"]) for p in points] == [(55.7, 37.6), (0.0, 0.0), None, None]


def test_pick_coordinates(spark):
    rows = [(1.0, 0.0, ("5", "6")), (None, 2.0, ("5", "6")), (None, None, ("0", "6")), (None, None, None), (0.0, 0.0, ("5", "6"))]
    df = spark.createDataFrame(rows, "a double, b double, c struct<lat:string,lon:string>")
    picked = [r[0] for r in df.select(n.pick_coordinates("a", "b", n.coordinates_from_struct("c"))).collect()]
    assert [p and (p["lat"], p["lon"]) for p in picked] == [(1.0, 0.0), (5.0, 6.0), None, None, (0.0, 0.0)]
