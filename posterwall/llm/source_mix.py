"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies of each of its documents: a whole
part, and a fraction that is rounded to 0 or 1. The pivotal method rounds two fractions against
each other: mass moves at random from one to the other until one of them is integral, and the
other goes on to the next duel. The sum of the fractions never changes and every document keeps
its own expected number of copies. Duels meet in the order of size, so that the words taken stay
near the target, too.

The order is cut into blocks of bounded size; each leaves one residual fraction at most. The
residuals meet in blocks again, level by level, until a source has one, which is rounded alone.
Draws are hashes of the documents that meet, so reruns and retried tasks agree.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from posterwall.llm.store import free_name, written
from posterwall.session import broadcast_if_small

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3.0
BLOCK = 4096
WORD = r"[^\x20\x09-\x0D]+"
_EDGE = 1e-9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, max_copies: float = MAX_COPIES
) -> DataFrame:
    """source, source_size, target of each source of sizes(source, size); one row per source.

    Sources take the weights in turn, by code point, null last. They share `share` of all sizes by
    weight. A target stops at max_copies times its source's size and the excess goes to the rest
    by weight. Sources that stop are those with the lowest limit per weight, so one pass over the
    sources in that order finds the level at which the others stand.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_limit = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("source").isNull(), F.col("source"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(0, Window.unboundedFollowing)
    turn = F.array(*map(F.lit, weights))
    grouped = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = grouped.withColumn("_weight", F.get(turn, (F.row_number().over(by_name) - 1) % len(weights)))
    limited = ranked.withColumn("_limit", max_copies * F.col("source_size"))
    levels = limited.select(
        "*",
        (
            (share * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
            / F.sum("_weight").over(after)
        ).alias("_level"),
    )
    # The first source in this order whose limit is above the level sets it for all that follow.
    above = F.when(F.col("_level") * F.col("_weight") <= F.col("_limit"), F.col("_level"))
    through = by_limit.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stand = levels.withColumn("_stand", F.first(above, ignorenulls=True).over(through))
    target = F.coalesce(F.col("_stand") * F.col("_weight"), F.col("_limit"))
    return stand.select("source", "source_size", target.alias("target"))


def _draw(seed: int, a: int, b: int) -> float:
    """A number in [0, 1) that depends on the two that meet only."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9 + 1) & (2**64 - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & (2**64 - 1)
    return (x ^ (x >> 31)) / 2.0**64


def duel(keys: np.ndarray, fractions: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Fractions after pairwise duels in the given order, and the place of the residual or -1."""
    p = fractions.astype(float).copy()
    left = -1
    for i in range(len(p)):
        if p[i] <= _EDGE or p[i] >= 1 - _EDGE:
            p[i] = round(p[i])
            continue
        if left < 0:
            left = i
            continue
        total, u = p[left] + p[i], _draw(seed, int(keys[left]), int(keys[i]))
        if total < 1:
            winner, loser = (left, i) if u * total < p[left] else (i, left)
            p[winner], p[loser], left = total, 0.0, winner
        else:
            winner, loser = (left, i) if u * (2 - total) < 1 - p[i] else (i, left)
            p[winner], p[loser], left = 1.0, total - 1, loser
        if p[left] <= _EDGE or p[left] >= 1 - _EDGE:
            p[left], left = round(p[left]), -1
    return p, left


_ROUNDED = "_source string, _null boolean, _key long, _count long, _order double, _fraction double, _level int, _block long"


def _round_block(level: int, seed: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["_order", "_key"], kind="stable").reset_index(drop=True)
        p, left = duel(block["_key"].to_numpy(), block["_fraction"].to_numpy(), seed + level)
        return block.assign(_fraction=p, _level=level)

    return run


def round_fractions(fractions: DataFrame, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """_source, _null, _key, _copy (0 or 1) for rows _source, _null, _key, _order, _fraction.

    _key tells the rows of a source apart. Blocks hold about `block` rows that follow each other in
    _order, whatever the size of their source.
    """
    group = ["_source", "_null"]
    rows = fractions.withColumn("_count", F.lit(1).cast("long"))
    # Bins of _order, split by hash into blocks; bins and counts depend on the rows alone.
    rows = rows.withColumn("_bin", F.floor(F.log2(F.col("_order") + 1) * 4).cast("long"))
    counts = rows.groupBy(*group, "_bin").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("_blocks"))
    joined = rows.join(counts, [*group, "_bin"])
    slot = F.pmod(F.xxhash64("_key"), F.col("_blocks"))
    pending = joined.withColumn("_block", F.col("_bin") * 1_000_000_007 + slot).withColumn("_level", F.lit(0))
    columns = [c.split()[0] for c in _ROUNDED.split(", ")]
    done, level = [], 0
    while True:
        dealt = pending.select(*columns).groupBy(*group, "_block").applyInPandas(_round_block(level, seed), _ROUNDED)
        rounded = written(dealt, "mix-level")
        open_ = (F.col("_fraction") > _EDGE) & (F.col("_fraction") < 1 - _EDGE)
        done.append(rounded.where(~open_))
        left = rounded.where(open_)
        most = left.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            alone = F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(1 << 30)) / float(1 << 30) < F.col("_fraction")
            done.append(left.withColumn("_fraction", alone.cast("double")))
            break
        level += 1
        pending = _gathered(left, most, block)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(*group, "_key", F.col("_fraction").cast("long").alias("_copy"))


def _gathered(left: DataFrame, most: int, block: int) -> DataFrame:
    """Up to `block` residuals of a source meet in one block, more of them in several by hash."""
    if most <= block:
        return left.withColumn("_block", F.lit(0).cast("long"))
    return left.withColumn("_block", F.pmod(F.xxhash64("_key"), F.lit(-(-most // block))))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, max_copies: float = MAX_COPIES, seed: int = 17
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source of every row of docs.

    A document without words, or without text, takes nothing and takes no part in the duels. Rows
    that repeat a doc_id within a source are rounded as one and each gets its copies. A null doc_id is a document
    like others, as is a null source. An empty table gives no rows.
    """
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    targets = source_targets(sized, weights, share, max_copies)
    wanted = written(targets.withColumn("_r", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                                        .otherwise(F.lit(0.0))), "mix-targets")
    null_id = F.col("doc_id").isNull()
    members = (
        sized.where("size > 0")
        .join(wanted.select(F.col("source").alias("_s"), "_r"), F.col("source").eqNullSafe(F.col("_s")))
        .groupBy(F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_null"),
                 F.coalesce("doc_id", F.lit(-1)).alias("_key"), null_id.alias("_no_id"))
        .agg(F.max("size").cast("double").alias("_order"), F.first(F.col("_r") - F.floor("_r")).alias("_fraction"))
    )
    # A null id competes under a number that stands for it alone.
    members = members.withColumn("_key", F.when(F.col("_no_id"), F.lit(-(2**63))).otherwise(F.col("_key")))
    copies = round_fractions(members.drop("_no_id"), seed)
    rows = sized.join(wanted.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "size", "source_size", "target", "_r",
        F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_null"),
        F.coalesce("doc_id", F.lit(-(2**63))).alias("_key"),
    )
    joined = rows.join(copies, ["_source", "_null", "_key"], "left")
    number = (F.floor("_r") + F.coalesce("_copy", F.lit(0))).cast("long")
    copies_of = F.when(F.col("size") > 0, number).otherwise(F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies_of).alias("taken"), copies_of.alias("copies"),
        F.when(~F.col("_null"), F.col("_source")).alias("source"),
    )


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """Each row of docs as often as the mix takes it, with all its columns.

    Copies are joined back by id and source; documents of no copies are left out.
    """
    of, origin, copies, time = (free_name(docs, name) for name in ("mix_id", "mix_source", "mix_copies", "mix_time"))
    taken = mix(docs, **parameters).where("copies > 0").select(
        F.col("doc_id").alias(of), F.col("source").alias(origin), F.col("copies").alias(copies)
    )
    # One row per document; of rows that repeat an id with and without words those without follow.
    taken = written(taken.groupBy(of, origin).agg(F.max(copies).alias(copies)), "mix-taken")
    same = F.col("doc_id").eqNullSafe(F.col(of)) & F.col("source").eqNullSafe(F.col(origin))
    both = docs.join(broadcast_if_small(taken, F.length(origin)), same)
    names = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    times = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))
    return both.select(*names, times.alias(time)).select(*names)
