"""String columns: trimming, normalizing, addresses, URLs, JSON checks."""

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from posterwall.constants import LABEL_LENGTH, SCHEDULE_HOST, WHITESPACE, WHITESPACE_CLASS as WS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def ws_trim(c) -> Column:
    """Trim every kind of white space, no-break space included."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def ws_collapse(c) -> Column:
    """Turn each run of white space into one space."""
    return F.regexp_replace(_col(c), f"{WS}+", " ")


def falsy_to_null(c) -> Column:
    return F.nullif(_col(c), F.lit(""))


def first_filled(*cs) -> Column:
    """The first argument that is neither NULL nor ''."""
    return F.coalesce(*[falsy_to_null(c) for c in cs])


_MARKS = range(0x0300, 0x0370)
# Syllables of Hangul are made of a lead, a vowel and maybe a tail: 19 x 21 x 28 of them.
_SYLLABLES = range(0xAC00, 0xAC00 + 19 * 21 * 28)


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, str, str]:
    """What canonical decomposition makes of letters, without the marks U+0300..U+036F.

    Arguments of translate() for letters that become one letter, the marks becoming nothing; then
    the letters that become several, and these, each after a line break. Hangul follows a rule instead.
    """
    letters, bases, compounds, parts = [], [], [], []
    for code in range(0x00C0, 0x30000):
        char = chr(code)
        if code in _MARKS or code in _SYLLABLES or not unicodedata.decomposition(char):
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", char) if ord(x) not in _MARKS)
        if len(base) > 1:
            compounds.append(char)
            parts.append(base)
        elif base and base != char:
            letters.append(char)
            bases.append(base)
    return "".join(letters) + "".join(map(chr, _MARKS)), "".join(bases), "".join(compounds), "\n".join(parts)


@lru_cache(maxsize=1)
def _around(compounds: str, gap: int = 256) -> str:
    """A pattern of a few ranges that hold all compounds and syllables, and some other letters."""
    codes = sorted([*map(ord, compounds), *_SYLLABLES])
    starts = [codes[0], *(b for a, b in zip(codes, codes[1:]) if b - a > gap)]
    stops = [*(a for a, b in zip(codes, codes[1:]) if b - a > gap), codes[-1]]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, stops)) + "]"


def _syllable_parts(char: Column) -> Column:
    """Lead, vowel and tail of a syllable of Hangul, NULL for other characters."""
    at = F.ascii(char) - _SYLLABLES.start

    def jamo(first: int, n: int, place: Column) -> Column:
        return F.substring(F.lit("".join(chr(first + i) for i in range(n))), place.cast("int"), F.lit(1))

    tail = F.when(at % 28 > 0, jamo(0x11A8, 27, at % 28)).otherwise("")
    parts = F.concat(jamo(0x1100, 19, F.floor(at / 588) + 1), jamo(0x1161, 21, F.floor(at % 588 / 28) + 1), tail)
    return F.when((at >= 0) & (at < len(_SYLLABLES)), parts)


def _decompose_compounds(text: Column) -> Column:
    """text with its syllables of Hangul, kana with voice marks and the like taken apart."""
    _, _, compounds, parts = _decompositions()
    listed = F.split(F.lit(parts), "\n")

    def apart(char: Column) -> Column:
        place = F.instr(F.lit(compounds), char)
        return F.when(place > 0, F.get(listed, place - 1)).otherwise(F.coalesce(_syllable_parts(char), char))

    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.when(text.rlike(_around(compounds)), F.array_join(F.transform(chars, apart), "")).otherwise(text)


def normalize(c) -> Column:
    """Lower case without accents, white space collapsed and trimmed.

    Letters are decomposed one by one; marks outside U+0300..U+036F stay where they are.
    """
    source, target, _, _ = _decompositions()
    low = F.lower(F.coalesce(_col(c), F.lit("")))
    is_ascii = F.octet_length(low) == F.length(low)
    return F.trim(ws_collapse(F.when(is_ascii, low).otherwise(F.translate(_decompose_compounds(low), source, target))))


def city_tokens(name) -> Column:
    """The normalized, non-empty parts of 'Город | City'."""
    parts = F.split(F.coalesce(_col(name), F.lit("")), r"\|")
    return F.filter(F.transform(parts, normalize), lambda t: t != "")


def clean_address(c) -> Column:
    return F.coalesce(F.trim(ws_collapse(c)), F.lit(""))


def strip_fragment(url) -> Column:
    return ws_trim(F.substring_index(_col(url), "#", 1))


def absolutize_link(link, host: str = SCHEDULE_HOST) -> Column:
    """Keep absolute links, prefix the others with the host; '' stays ''."""
    link = F.coalesce(_col(link), F.lit(""))
    return (
        F.when(link == "", F.lit(""))
        .when(link.startswith("http"), link)
        .otherwise(F.concat(F.lit(host), link))
    )


def absolutize_photo(photo, host: str = SCHEDULE_HOST) -> Column:
    """Like absolutize_link, but drops a leading './' or '/' and gives NULL for ''."""
    photo = falsy_to_null(photo)
    return F.when(photo.startswith("http"), photo).otherwise(
        F.concat(F.lit(host + "/"), F.regexp_replace(photo, r"^\.?/+", ""))
    )


def city_slug(name) -> Column:
    """URL slug of the second part of a city name, else of the first, else of the name.

    url_encode follows HTML forms; the replacements bring it to URI component encoding.
    """
    name = F.coalesce(_col(name), F.lit(""))
    parts = F.filter(F.transform(F.split(name, r"\|"), ws_trim), lambda p: p != "")
    slug = F.regexp_replace(
        F.lower(F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)), name)), f"{WS}+", "-"
    )
    encoded = F.url_encode(slug)
    # Characters that a URI component keeps and a form encodes.
    for form, literal in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(form), F.lit(literal))
    return encoded


def join_filled(*parts) -> Column:
    """Join the non-empty parts with ', '."""
    return F.array_join(
        F.filter(F.array(*[_col(p) for p in parts]), lambda p: p.isNotNull() & (p != "")), ", "
    )


def contains_any(c, phrases) -> Column:
    """Whether the lower-cased text contains one of the phrases."""
    low = F.lower(F.coalesce(_col(c), F.lit("")))
    found = F.lit(False)
    for phrase in phrases:
        found = found | low.contains(phrase.lower())
    return found


def merge_locations(header, map_text) -> Column:
    """One location from the header text and the map text.

    The longer one if it contains the other, both if they differ, the filled one otherwise.
    """
    header = F.coalesce(_col(header), F.lit(""))
    map_text = F.coalesce(_col(map_text), F.lit(""))
    return (
        F.when(map_text.contains(header), map_text)
        .when(header.contains(map_text), header)
        .otherwise(F.concat_ws(", ", header, map_text))
    )


def wrap_photo(url) -> Column:
    url = falsy_to_null(url)
    empty = F.array().cast("ARRAY<STRUCT<full_url: STRING>>")
    return F.when(url.isNotNull(), F.array(F.struct(url.alias("full_url")))).otherwise(empty)


def wrap_website(url) -> Column:
    return F.struct(_col(url).alias("website"))


def label(title, href) -> Column:
    return F.left(F.coalesce(falsy_to_null(title), _col(href), F.lit("")), F.lit(LABEL_LENGTH))


def is_json(c) -> Column:
    """Whether the text is one JSON value and nothing else.

    The JSON readers stop after the first value. Wrapped in an object and in an array, a text
    reads well to the end of both only if nothing follows its first value.
    """
    c = _col(c)
    in_object = F.from_json(
        F.concat(F.lit('{"value":'), c, F.lit(',"end":1}')), "end INT", {"allowSingleQuotes": "false"}
    )
    in_array = F.json_array_length(F.concat(F.lit("["), c, F.lit("]")))
    return F.coalesce((in_object["end"] == 1) & (in_array == 1), F.lit(False))


def is_json_array(c) -> Column:
    return is_json(c) & F.json_array_length(_col(c)).isNotNull()
