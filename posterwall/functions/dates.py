"""Date and time columns: free-form event dates, ISO instants, retention cutoff.

Nothing here reads the clock; `as_of` is always an argument.
"""

import datetime as dt

from pyspark.sql import Column, functions as F

from posterwall.constants import MONTHS_EN, WEEKDAYS_EN
from posterwall.functions.text import WS, _col, falsy_to_null, let, ws_trim

# The building blocks of the accepted date texts. Names match in any case, a day
# has no leading zero, hours and minutes have two digits, single spaces separate the parts.
_MONTH = "(?i:" + "|".join(MONTHS_EN) + ")"
_MON = "(?i:" + "|".join(m[:3] for m in MONTHS_EN) + ")"
_WEEKDAY = "(?i:" + "|".join(WEEKDAYS_EN) + ")"
_WDAY = "(?i:" + "|".join(d[:3] for d in WEEKDAYS_EN) + ")"
_DAY = r"[1-9]\d?"
_TIME = r"(\d\d):(\d\d)"
_SPAN = rf"\d\d:\d\d - {_TIME}"

# The accepted shapes, each with the order in which its groups fill
# weekday|day|month|year|hour|minute. With 'HH:mm - HH:mm' the second time counts.
_WHOLE_TEXT_SHAPES = (
    (rf"^({_WEEKDAY}),? ({_DAY})\. ({_MONTH}) at {_TIME}$", "$1|$2|$3||$4|$5"),
    (rf"^({_WEEKDAY}),? ({_DAY})\. ({_MONTH}) at {_SPAN}$", "$1|$2|$3||$4|$5"),
    (rf"^({_WEEKDAY}) ({_DAY}) ({_MONTH}) at {_TIME}$", "$1|$2|$3||$4|$5"),
    (rf"^({_WEEKDAY}) ({_DAY}) ({_MONTH}) at {_SPAN}$", "$1|$2|$3||$4|$5"),
    (rf"^({_DAY})\.? ({_MONTH}) at {_TIME}$", "|$1|$2||$3|$4"),
    (rf"^({_DAY})\.? ({_MONTH}) at {_SPAN}$", "|$1|$2||$3|$4"),
    (rf"^({_MONTH}) ({_DAY}) at {_TIME}$", "|$2|$1||$3|$4"),
    (rf"^({_MONTH}) ({_DAY}) at {_SPAN}$", "|$2|$1||$3|$4"),
    (rf"^({_WDAY}), ({_DAY}) ({_MON}) {_TIME}$", "$1|$2|$3||$4|$5"),
    (rf"^({_WDAY}), ({_DAY}) ({_MON})$", "$1|$2|$3|||"),
    (rf"^({_DAY}) ({_MON}) (\d{{4}}) {_TIME}$", "|$1|$2|$3|$4|$5"),
    (rf"^({_DAY}) ({_MON}|{_MONTH}) (\d{{4}})$", "|$1|$2|$3||"),
    (rf"^({_DAY})\. ({_MONTH})$", "|$1|$2|||"),
    (rf"^({_DAY}) ({_MON}|{_MONTH})$", "|$1|$2|||"),
    (rf"^({_MONTH}) ({_DAY})$", "|$2|$1|||"),
    (rf"^({_MONTH}) ({_DAY}), (\d{{4}})$", "|$2|$1|$3||"),
)
_RANGE_START_SHAPES = (
    (rf"^({_WEEKDAY}) ({_DAY})\.? ({_MONTH}) at {_TIME}$", "$1|$2|$3||$4|$5"),
    (rf"^({_DAY})\.? ({_MONTH}) at {_TIME}$", "|$1|$2||$3|$4"),
    (rf"^({_WEEKDAY}) ({_DAY})\.? ({_MONTH})$", "$1|$2|$3|||"),
    (rf"^({_DAY})\.? ({_MONTH})$", "|$1|$2|||"),
)
_RANGE = rf"^(.+?){WS}+-{WS}+(.+)$"
_SHORT = rf"^[A-Za-z]{{3}},?{WS}+({_DAY}){WS}+({_MON})(?:{WS}+{_TIME})?$"


def _as_of(as_of) -> Column:
    if isinstance(as_of, (dt.date, dt.datetime)):
        return F.lit(as_of)
    return _col(as_of)


def _decompose(text: Column, shapes) -> Column:
    """weekday|day|month|year|hour|minute of the first shape that fits.

    A shape begins with a day or with a name, so a text is tried on those only that begin as it does.
    """

    def first_of(shapes) -> Column:
        fields = F.lit(None).cast("string")
        for pattern, order in reversed(shapes):
            fields = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, order)).otherwise(fields)
        return fields

    with_day = [shape for shape in shapes if shape[0].startswith(f"^({_DAY})")]
    with_name = [shape for shape in shapes if shape not in with_day]
    return F.when(F.left(text, F.lit(1)).between("1", "9"), first_of(with_day)).otherwise(first_of(with_name))


def _timestamp(fields: Column, year: Column, check_weekday: bool = True) -> Column:
    """Timestamp of decomposed fields; NULL for a day or an hour that does not exist and for a
    weekday that is not the day's. 24:00 is midnight of the next day."""

    def build(part: Column) -> Column:
        months = F.split(F.lit(" ".join(m[:3] for m in MONTHS_EN)), " ")
        month = F.array_position(months, F.lower(F.left(part[2], F.lit(3))))
        next_midnight = (part[4] == "24") & (part[5] == "00")
        hour = F.when(next_midnight, 0).otherwise(F.coalesce(part[4].try_cast("int"), F.lit(0)))
        parsed = F.try_make_timestamp(
            F.coalesce(part[3].try_cast("int"), year),
            month.cast("int"),
            part[1].try_cast("int"),
            hour,
            F.coalesce(part[5].try_cast("int"), F.lit(0)),
            F.lit(0).cast("decimal(16,6)"),
        )
        days_later = F.make_dt_interval(F.when(next_midnight, 1).otherwise(0))
        if not check_weekday:
            return parsed + days_later

        def on_weekday(ts: Column) -> Column:
            right_day = F.lower(F.date_format(ts, "EEEE")).startswith(F.lower(part[0]))
            return F.when((part[0] == "") | right_day, ts + days_later)

        return let(parsed, on_weekday)

    return let(F.split(fields, r"\|"), build)


def _next_occurrence(fields: Column, today: Column) -> Column:
    """The day in the year of today, or in the next year if it has passed."""
    year = F.year(today)
    return let(
        _timestamp(fields, year, check_weekday=False),
        lambda ts: F.when(ts.cast("date") >= today, ts).when(
            ts.isNotNull(), _timestamp(fields, year + 1, check_weekday=False)
        ),
    )


def parse_event_date(date_text, as_of, time_text=None) -> Column:
    """Timestamp of a free-form English event date, NULL when no shape fits.

    Of a range the start counts. 'Wed, 28 Jan' means the next such day from as_of on and its
    weekday is not checked; every other text without a year is in the year of as_of.
    """
    text = falsy_to_null(date_text)
    if time_text is not None:
        time = ws_trim(F.coalesce(_col(time_text), F.lit("")))
        text = F.when(time != "", F.concat(ws_trim(text), F.lit(" "), time)).otherwise(text)
    today = _as_of(as_of).cast("date")

    def parse(text: Column) -> Column:
        start = ws_trim(F.regexp_extract(text, _RANGE, 1))
        from_range = let(start, lambda t: _timestamp(_decompose(t, _RANGE_START_SHAPES), F.year(today)))
        short = F.when(text.rlike(_SHORT), F.regexp_replace(text, _SHORT, "|$1|$2||$3|$4"))
        from_short = let(short, lambda f: _next_occurrence(f, today))
        whole = _timestamp(_decompose(text, _WHOLE_TEXT_SHAPES), F.year(today))
        return F.coalesce(
            F.when(text.contains("-") & text.rlike(_RANGE), from_range), F.when(text.rlike(_SHORT), from_short), whole
        )

    return let(text, parse)


def _parse_each(dates_times: Column, as_of) -> Column:
    return F.transform(dates_times, lambda d: parse_event_date(d["date"], as_of, d["time"]))


def _present(dates: Column) -> Column:
    return F.filter(dates, lambda t: t.isNotNull())


def parse_event_dates(dates_times, as_of) -> Column:
    """Timestamps of an ARRAY<STRUCT<date, time>>, texts that do not parse left out."""
    return _present(_parse_each(_col(dates_times), as_of))


def series_or_page_dates(dates_times, date_text, as_of) -> Column:
    """The dates of a series, or the one of the page if the series gives none."""
    of_page = _present(F.array(parse_event_date(date_text, as_of, F.lit(""))))
    of_series = F.coalesce(parse_event_dates(dates_times, as_of), F.array().cast("array<timestamp>"))
    return let(of_series, lambda s: F.when(F.size(s) > 0, s).otherwise(of_page))


def parse_iso(c) -> Column:
    return F.try_to_timestamp(falsy_to_null(c))


def to_iso(ts) -> Column:
    """ISO text in UTC with milliseconds, '' for NULL."""
    return F.coalesce(F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))


def retention_cutoff(as_of, days: int) -> Column:
    return _as_of(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
