"""Resolve free text to a city of the dimension by substring, first city in order wins.

A city matches when one of its tokens contains the text or the text contains the token. Candidates
share a gram of GRAM letters, and `contains` decides:

- text contains token: each token stands under its rarest gram (a token of at most GRAM letters
  under itself), and a text looks up all its grams;
- token contains text: a text looks up its rarest gram among the grams of all tokens, and is in no
  token if one of its grams is in none. A text of at most GRAM letters is a gram itself, for which the
  first city is known.

So the index grows with the letters of the names and the plan does not depend on their lengths. A part
that all names have in common makes candidates only of texts that consist of nothing rarer.

Only distinct texts are matched; the words of an address are matched once, however many addresses
hold them.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from posterwall.functions.text import _col, city_tokens, clean_address, normalize
from posterwall.session import BROADCAST_MAX_CHARS, BROADCAST_MAX_ROWS, broadcast_if_small, materialize

GRAM = 3
# Shorter words and parts of an address count only if they equal a token.
FREE_LENGTH = 4

_CITY = ("_id", "country_id", "name", "coordinates", "city_ord")


@dataclass(frozen=True)
class CityIndex:
    """Join tables of the dimension. Their sizes are known before anything is broadcast."""

    tokens: DataFrame  # key (the token's rarest gram), token, city_ord
    grams: DataFrame  # key, held (tokens with it), city_ord, long_ord (first city with a token of four or more)
    postings: DataFrame  # key, token, city_ord of every gram of full length


def _cuts(text, size: int) -> Column:
    """The substrings of the given size; empty if the text is shorter."""
    text = _col(text)
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    cuts = F.transform(starts, lambda start: F.substring(text, start, F.lit(size)))
    return F.coalesce(cuts, F.array().cast("array<string>"))


def _all_cuts(text) -> Column:
    """The distinct substrings of at most GRAM letters."""
    return F.array_distinct(F.concat(*[_cuts(text, n) for n in range(1, GRAM + 1)]))


def _rarest(rows: DataFrame, text: str, grams: DataFrame, *keep: str) -> DataFrame:
    """keep, text and key, the gram of the text that the fewest tokens have, of each text whose grams are all known.

    Places and counts are states of fixed width, so that no aggregate has to sort.
    """
    each = rows.select(*keep, text, F.posexplode(_cuts(text, GRAM)).alias("place", "key"))
    known = each.join(grams.select("key", "held"), "key", "left")
    least = known.groupBy(*keep, text).agg(
        F.min_by("place", "held").alias("place"), F.count(F.when(F.col("held").isNull(), 1)).alias("unknown")
    )
    key = F.substring(F.col(text), F.col("place") + 1, F.lit(GRAM)).alias("key")
    return least.where("unknown = 0").select(*keep, text, key)


def build_index(cities: DataFrame) -> CityIndex:
    tokens = (
        cities.select("city_ord", F.explode(city_tokens("name")).alias("token"))
        .groupBy("token")
        .agg(F.min("city_ord").alias("city_ord"))
    )
    size = F.length("token").cast("bigint")
    measured = tokens.agg(
        F.count(F.lit(1)).alias("n"), F.sum(size).alias("chars"), F.sum(size * (size + GRAM)).alias("posted")
    ).first()

    def bounded(df: DataFrame, rows, chars) -> DataFrame:
        """Small tables are broadcast, others written, as they are read more than once."""
        small = (rows or 0) <= BROADCAST_MAX_ROWS and (chars or 0) <= BROADCAST_MAX_CHARS
        return F.broadcast(df) if small else materialize(df, "cities")

    n, chars = measured["n"], measured["chars"] or 0
    grams = tokens.select("token", "city_ord", F.explode(_all_cuts("token")).alias("key")).groupBy("key").agg(
        F.count(F.lit(1)).alias("held"),
        F.min("city_ord").alias("city_ord"),
        F.min(F.when(F.length("token") >= FREE_LENGTH, F.col("city_ord"))).alias("long_ord"),
    )
    grams = bounded(grams, GRAM * chars, GRAM * GRAM * chars)
    rare = _rarest(tokens.where(F.length("token") > GRAM), "token", grams, "city_ord")
    short = tokens.where(F.length("token") <= GRAM).withColumn("key", F.col("token"))
    postings = tokens.select("token", "city_ord", F.explode(F.array_distinct(_cuts("token", GRAM))).alias("key"))
    return CityIndex(
        bounded(rare.unionByName(short), n, chars + GRAM * n),
        grams,
        bounded(postings, chars, measured["posted"]),
    )


def match_texts(texts: DataFrame, index: CityIndex) -> DataFrame:
    """text, and the first city that it touches by any token (city_ord), by a token of four letters or
    more (long_ord), and by a token equal to it (exact_ord), of the distinct texts(text) that touch one."""
    text, token, city = F.col("text"), F.col("token"), F.col("city_ord")
    orders = [
        "text", "city_ord", F.when(F.length(token) >= FREE_LENGTH, city).alias("long_ord"),
        F.when(token == text, city).alias("exact_ord"),
    ]
    holding = texts.select("text", F.explode(_all_cuts("text")).alias("key")).join(index.tokens, "key").where(text.contains(token))
    rare = _rarest(texts.where(F.length(text) > GRAM), "text", index.grams)
    inside = rare.join(index.postings, "key").where(token.contains(text))
    short = texts.where(F.length(text) <= GRAM).join(index.grams, text == F.col("key"))
    short = short.select("text", "city_ord", "long_ord", F.lit(None).cast("bigint").alias("exact_ord"))
    hits = holding.select(*orders).unionByName(inside.select(*orders)).unionByName(short)
    return hits.groupBy("text").agg(*(F.min(c).alias(c) for c in ("city_ord", "long_ord", "exact_ord")))


def match_simple(targets: DataFrame, index: CityIndex) -> DataFrame:
    """(target, city_ord) of the first city with any token inside or around the target."""
    found = match_texts(targets.select(F.col("target").alias("text")), index)
    return found.select(F.col("text").alias("target"), "city_ord")


def address_probes(target) -> Column:
    """The texts of an address to look up, in the order in which they may decide.

    The last three parts count, last first. Of a part come its words from right to left, each
    followed by itself with its left neighbour, and at the end the whole part.
    """
    trimmed = F.transform(F.split(_col(target), "[,•]"), lambda p: F.trim(p))
    parts = F.slice(F.reverse(F.filter(trimmed, lambda p: p != "")), 1, 3)

    def probe(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    def of_part(part: Column) -> Column:
        words = F.reverse(F.filter(F.split(part, " "), lambda w: F.length(w) > 2))
        pairs = F.zip_with(
            F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
            words,
            lambda left, word: F.concat(left, F.lit(" "), word),
        )
        by_word = F.zip_with(
            words, pairs, lambda w, p: F.array(probe("word", w), probe("pair", p))
        )
        return F.concat(F.flatten(by_word), F.array(probe("part", part)))

    return F.filter(F.flatten(F.transform(parts, of_part)), lambda p: p["text"].isNotNull())


def match_address(targets: DataFrame, index: CityIndex) -> DataFrame:
    """(target, city_ord) of the city hit by the earliest probe of an address.

    A word or a whole part counts only if it or the token has four characters; a word that equals
    a token and a pair of words always count.
    """
    probes = targets.select("target", F.posexplode(address_probes("target")).alias("rank", "probe"))
    probes = probes.select("target", "rank", F.col("probe.kind"), F.col("probe.text")).where("text <> ''")
    found = match_texts(probes.select("text").distinct(), index)
    free = (F.col("kind") == "pair") | (F.length("text") >= FREE_LENGTH)
    exact_word = F.when(F.col("kind") == "word", F.col("exact_ord"))
    first = F.when(free, F.col("city_ord")).otherwise(F.least("long_ord", exact_word))
    hits = probes.join(found, "text").select("target", "rank", first.alias("city_ord"))
    return hits.where("city_ord is not null").groupBy("target").agg(F.min_by("city_ord", "rank").alias("city_ord"))


def _attach(df: DataFrame, cities: DataFrame, target: Column, match, out: str) -> DataFrame:
    """df with the matched city of each row.

    The distinct targets are written first: the plan behind df runs once for them, and only they are
    normalized. The matches are written as well, by the target as it stands in df. Their size is then
    known: as long as they fit a broadcast, the rows of df are not shuffled at all. Otherwise the join
    shuffles, and AQE splits the partition of a target that many rows share.
    """
    raw = materialize(df.select(target.alias("_raw")).where(F.col("_raw").isNotNull()).distinct(), "targets")
    raw = raw.withColumn("_target", F.nullif(normalize("_raw"), F.lit(""))).where(F.col("_target").isNotNull())
    targets = raw.select(F.col("_target").alias("target")).distinct()
    found = cities.select("city_ord", F.struct(*_CITY).alias(out))
    matches = match(targets, build_index(cities)).join(found, "city_ord").select(F.col("target").alias("_target"), out)
    resolved = materialize(raw.join(matches, "_target").select("_raw", out), "matches")
    width = F.length("_raw") + F.length(F.col(out)["name"]) + 64
    return df.withColumn("_raw", target).join(broadcast_if_small(resolved, width), "_raw", "left").drop("_raw")


def resolve_city(df: DataFrame, cities: DataFrame, target, out: str = "city") -> DataFrame:
    """Add the struct `out` of the first city that shares a substring with the target."""
    return _attach(df, cities, _col(target), match_simple, out)


def resolve_city_of_address(df: DataFrame, cities: DataFrame, address, out: str = "city") -> DataFrame:
    """Add the struct `out` of the city that the address names, looking from its end."""
    return _attach(df, cities, clean_address(address), match_address, out)
