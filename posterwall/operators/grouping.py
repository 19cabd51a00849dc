"""First-wins grouping of schedule slots and merging of duplicate events.

Every aggregate has a state of bounded size: a first row, minima, maxima and the set of calendar
days, so no list of all members of a key is ever built. Slots are shuffled once, by title and
address, so that the groups of different tours that are merged afterwards lie in one task and reach
the merge combined. A title and address that very many slots share is dealt over tasks by tour.
"""

from pyspark.sql import Column, DataFrame, functions as F

from posterwall.functions.holding import format_holding_date
from posterwall.functions.text import ws_trim
from posterwall.session import broadcast_if_small, materialize

# Slots of one title and address beyond this are dealt over DEALS tasks by their tours.
HOT_ROWS = 1_000_000
DEALS = 64
# Of one tour in so many the slots are counted to find them.
COUNTED = 64


def _first(order: Column, row: Column) -> Column:
    """The first row and its order in one state, so that neither is held twice."""
    return F.min(F.when(order.isNotNull(), F.struct(order.alias("ord"), row.alias("row"))))


def _unlike(c: str, key: str) -> Column:
    """What differs from a key that the row carries anyway; `_whole` puts it back."""
    return F.nullif(F.col(c), F.col(key))


def _whole(c: Column, key: str) -> Column:
    return F.coalesce(c, F.col(key))


def _deal(slots: DataFrame, tour: str, hot_rows: int) -> tuple[DataFrame, list[str]]:
    """(slots, the columns to deal them out by): title and address, and _deal, which tells the tours of a
    frequent pair apart, if there is one. It decides only where slots are worked on, never which are grouped.
    """
    counted = slots.where(F.pmod(F.xxhash64(tour), F.lit(COUNTED)) == 0).groupBy("_title", "_address").count()
    hot = materialize(counted.where(F.col("count") > hot_rows // COUNTED).select("_title", "_address"), "hot")
    if hot.isEmpty():
        return slots, ["_title", "_address"]
    hot = broadcast_if_small(hot.select(F.col("_title").alias("_t"), F.col("_address").alias("_a"), F.lit(True).alias("_hot")))
    same = F.col("_title").eqNullSafe(F.col("_t")) & F.col("_address").eqNullSafe(F.col("_a"))
    deal = F.when(F.col("_hot"), F.pmod(F.xxhash64(tour), F.lit(DEALS))).otherwise(0)
    return slots.join(hot, same, "left").withColumn("_deal", deal), ["_title", "_address", "_deal"]


def group_slots(slots: DataFrame, order: Column, keep, tour: str = "tour", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Groups of a tour's slots with the same trimmed title and address.

    slots has title, address, start and price; the first slot of a group by `order` supplies
    title, address and `keep`. Adds ord (the order of that slot), days, date_start and date_end
    (both of the start dates) and the price bounds.
    """
    keyed = slots.withColumns({"_title": ws_trim("title"), "_address": ws_trim("address"), "_ord": order})
    dealt, where = _deal(keyed, tour, hot_rows)
    narrow = dealt.select(
        tour, *where, "_ord", _unlike("title", "_title").alias("title"), _unlike("address", "_address").alias("address"),
        *[c for c in keep if c != tour], "start", "price",
    )
    return (
        narrow.repartition(*where)
        .groupBy(tour, *where)
        .agg(
            _first(F.col("_ord"), F.struct("title", "address", *keep)).alias("_first"),
            F.sort_array(F.collect_set(F.to_date("start"))).alias("days"),
            F.min("start").alias("date_start"),
            F.max("start").alias("date_end"),
            F.min("price").alias("min_price"),
            F.max("price").alias("max_price"),
        )
        .select(
            tour,
            F.when(F.col("_first").isNotNull(), _whole(F.col("_first.row.title"), "_title")).alias("title"),
            F.when(F.col("_first").isNotNull(), _whole(F.col("_first.row.address"), "_address")).alias("address"),
            *[F.col("_first.row")[c].alias(c) for c in keep],
            F.col("_first.ord").alias("ord"),
            "days", "date_start", "date_end", "min_price", "max_price",
        )
    )


_KEY = ("_name", "_address", "_city")
_BOUNDS = ("date_start", "date_end", "min_price", "max_price")


def _combined(by_day: DataFrame) -> DataFrame:
    """One state per key of by_day(_KEY, _row, _ord, _BOUNDS, _i, _day), which has a row per day.

    Only the first row of an event carries _row and _ord, so that the extra rows are narrow and the
    set of days stays the only collected state.
    """
    leading = F.coalesce("_i", F.lit(0)) == 0
    row, keys = F.col("_row"), dict(zip(("name", "address", "city_id"), _KEY))
    slim = row
    for field, key in keys.items():
        slim = slim.withField(field, F.nullif(row[field], F.col(key)))
    whole = F.col("_state.row")
    for field, key in keys.items():
        # A missing city has an empty key.
        whole = whole.withField(field, F.coalesce(whole[field], F.nullif(F.col(key), F.lit("")) if field == "city_id" else F.col(key)))
    return (
        by_day.withColumn("_row", F.when(leading, slim))
        .withColumn("_ord", F.when(leading, F.col("_ord")))
        .groupBy(*_KEY)
        .agg(
            _first(F.col("_ord"), F.col("_row")).alias("_state"),
            F.sort_array(F.collect_set("_day")).alias("days"),
            F.min("date_start").alias("date_start"),
            F.max("date_end").alias("date_end"),
            F.least(F.min("min_price"), F.min("max_price")).alias("min_price"),
            F.greatest(F.max("min_price"), F.max("max_price")).alias("max_price"),
        )
        .select(
            *_KEY, whole.alias("_first"), F.col("_state.ord").alias("ord"),
            "days", *_BOUNDS,
        )
    )


def event_states(events: DataFrame, order: Column, keep) -> DataFrame:
    """A mergeable state per trimmed name, trimmed address and city: first row, bounds, set of days.

    events has name, address, city_id, days (NULL means the day of date_start), date_start,
    date_end and the price bounds.
    """
    single_day = F.filter(F.array(F.to_date("date_start")), lambda d: d.isNotNull())
    by_day = events.select(
        ws_trim("name").alias("_name"),
        ws_trim("address").alias("_address"),
        F.coalesce("city_id", F.lit("")).alias("_city"),
        F.struct("name", "address", "city_id", *keep).alias("_row"),
        order.alias("_ord"),
        "date_start",
        F.when(F.col("days").isNull(), F.col("date_start")).otherwise(F.col("date_end")).alias("date_end"),
        "min_price",
        "max_price",
        F.posexplode_outer(F.coalesce("days", single_day)).alias("_i", "_day"),
    )
    return _combined(by_day)


def combine_states(states: DataFrame) -> DataFrame:
    """One state per key of states that may share keys; the same however they were cut into states."""
    days = F.posexplode_outer("days").alias("_i", "_day")
    return _combined(states.select(*_KEY, F.col("_first").alias("_row"), F.col("ord").alias("_ord"), *_BOUNDS, days))


def finish_states(states: DataFrame, chronological: bool = False, genitive: bool = False) -> DataFrame:
    """The events of the states, which have one row per key, with the holding text of their days."""
    holding = format_holding_date("days", False, chronological, genitive)
    return states.select("_first.*", "ord", "days", holding.alias("holding_date"), *_BOUNDS)


def merge_duplicates(
    events: DataFrame, order: Column, keep, chronological: bool = False, genitive: bool = False
) -> DataFrame:
    """One event per trimmed name, trimmed address and city; the first event supplies the rest.

    Days and prices are united, the holding text is rebuilt; events are as in `event_states`.
    """
    return finish_states(event_states(events, order, keep), chronological, genitive)
