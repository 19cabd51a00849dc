"""Exact duplicates by distributed MSD radix partitioning: no digest decides equality.

A digit is a run of successive bytes. At each level the documents of a part that is still open are
split by their next digit; parts of one document are done, and so are parts whose texts end within
the digit, as these are equal to the last byte. What remains goes on behind the digit. Digits grow by
GROWTH a level (FIRST bytes, then 8 times as many), so texts of n bytes end after about log8(n / 64)
levels, and each level moves the open documents only.

Parts are counted with map-side combine, so a part with a third of all rows reaches its reducer as
one row a task. The parts of more than one document are written and joined back by a sort-merge join
of two shuffles, in which AQE splits the side of the documents where a part is hot. So the first
level moves all texts once, as a radix partition does, and the further ones what is still open. Every
level is a written table: a lost executor repeats one level at most.

A null text counts as empty; empty texts equal each other. Of equal texts the row with the largest
doc_id stays; a null doc_id is below all others. Of rows that repeat doc_id and text exactly one
stays. An empty table gives no rows. Texts of any length are compared whole. Extra columns are
ignored by `duplicates` and kept by `keep_documents`.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from posterwall.llm.store import free_name, written
from posterwall.session import broadcast_if_small

FIRST = 64
GROWTH = 8


def _marked(rows: DataFrame, row: Column, first: int, growth: int) -> DataFrame:
    """row, id, sha, keep_id, keep_row, size of all of rows(id, text); `row` numbers them.

    keep_row is the row of the largest id among equal texts; the last three are null for a text of its own.
    """
    width, singles, ended = first, [], []
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    left = rows.withColumns({"rest": whole, "part": F.lit(0).cast("bigint")})
    kept = [row.alias("row"), "id", F.sha2(whole, 256).alias("sha")]
    while True:
        split = left.withColumn("digit", F.substring("rest", 1, width))
        several = split.groupBy("part", "digit").count().where("count > 1")
        several = written(several.select("part", "digit", F.monotonically_increasing_id().alias("next")), "radix-parts")
        open_ = F.col("next").isNotNull()
        more = F.octet_length("rest") >= width
        level = written(
            split.join(several.hint("merge"), ["part", "digit"], "left").select(
                *kept, F.col("next").alias("part"), (open_ & more).alias("more"),
                F.when(open_ & more, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
            ),
            "radix-level",
        )
        singles.append(level.where("part is null").select("row", "id", "sha"))
        at = F.lit(len(ended)).alias("level")
        ended.append(level.where("part is not null and not more").select("row", "id", "sha", at, "part"))
        left, kept = level.where("more").select("row", "id", "sha", "part", "rest"), ["row", "id", "sha"]
        if left.isEmpty():
            break
        width *= growth
    equal, alone = reduce(DataFrame.unionByName, ended), reduce(DataFrame.unionByName, singles)
    groups = written(
        equal.groupBy("level", "part").agg(
            F.count(F.lit(1)).alias("size"), F.max("id").alias("keep_id"), F.coalesce(F.max_by("row", "id"), F.min("row")).alias("keep_row")
        ),
        "radix-groups",
    )
    return equal.join(groups.hint("merge"), ["level", "part"]).drop("level", "part").unionByName(alone, allowMissingColumns=True)


def duplicates(docs: DataFrame, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs(doc_id, text)."""
    found = _marked(docs.select(F.col("doc_id").alias("id"), "text"), F.monotonically_increasing_id(), first, growth)
    return found.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_documents(docs: DataFrame, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with all their columns."""
    row = free_name(docs, "row_number")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "radix-rows")
    found = _marked(rows.select(F.col(row).alias("row"), F.col("doc_id").alias("id"), "text"), F.col("row"), first, growth)
    gone = written(found.where("keep_row <> row").select(F.col("row").alias(row)), "radix-gone")
    return rows.join(broadcast_if_small(gone), row, "left_anti").select(*docs.columns)


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
