"""How filters interact: what each one removes in every order they can be applied in.

Four filters look at one text. The fifth, E, is existential: a left-semi join of the table with
itself on hash, exact text and a smaller doc_id. Only texts whose hash occurs under several ids take
part, and of equal texts only the smallest id stands on the right, so the join makes no pairs within
a group of copies and AQE can split the left side of a hot one. The ids it marks are united with the
failures of the other filters, and one aggregate gives each document its combination of bits. From
there on only the counts of the combinations of a part are needed, 32 at most; orders, steps and
Shapley sums are expressions over these.

A null text counts as empty and a null lang as the part ''. A null doc_id neither fails E nor makes
another one fail. A row that repeats doc_id, text and lang counts as often as it stands there. Of
several labels of a document one that says so is enough. An empty table has no part and no rows.
Extra columns are ignored. Texts are read whole.
"""

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from posterwall.llm.store import written
from posterwall.session import broadcast_if_small

FILTERS = "ABCDE"
BITS = {letter: 1 << i for i, letter in enumerate(FILTERS)}
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 3
SYMBOLS = "[#$%&*|]"


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def failure_bits(text: Column) -> Column:
    """The bits of the filters that look at one text: A, B, C and D."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    failed = {
        "A": n < MIN_WORDS,
        "B": 100 * distinct.cast("bigint") < MIN_DISTINCT_PERCENT * n.cast("bigint"),
        "C": 100 * capitals.cast("bigint") > MAX_CAPITALS_PERCENT * F.char_length(text).cast("bigint"),
        "D": text.rlike(SYMBOLS),
    }
    bits = F.lit(0)
    for letter, fails in failed.items():
        bits = bits.bitwiseOR(F.when(fails, BITS[letter]).otherwise(0))
    return bits


def copies(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, hash, part, text) whose text is that of a smaller doc_id.

    hashes(hash, doc_id) is the table to look for several ids of one hash.
    """
    ids = hashes.where(F.col("doc_id").isNotNull()).groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    shared = broadcast_if_small(written(ids.where("lo < hi"), "audit-hashes"))
    rows = written(docs.join(shared.drop("hi"), "hash"), "audit-rows")
    firsts = rows.groupBy("hash", "text").agg(F.min("doc_id").alias("first_id"))
    firsts = written(firsts.select(F.col("hash").alias("of"), F.col("text").alias("same"), "first_id"), "audit-firsts")
    smaller = (F.col("hash") == F.col("of")) & (F.col("text") == F.col("same")) & (F.col("first_id") < F.col("doc_id"))
    return rows.where("doc_id > lo").join(firsts.hint("merge"), smaller, "left_semi").select("doc_id", "hash", "part")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, bits, n: the combination of failures of each document, and its rows."""
    rows = docs.select("doc_id", F.xxhash64(_text()).alias("hash"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), _text().alias("text"))
    own = written(rows.select("doc_id", "hash", "part", failure_bits(F.col("text")).alias("bits"), F.lit(1).cast("bigint").alias("n")), "audit-failures")
    repeated = copies(rows, own.select("hash", "doc_id")).distinct()
    marks = repeated.select("doc_id", "hash", "part", F.lit(BITS["E"]).alias("bits"), F.lit(0).cast("bigint").alias("n"))
    return own.unionByName(marks).groupBy("doc_id", "hash", "part").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n")).drop("hash")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, combos: of each part its combinations (bits, n, good, toxic), 32 at most."""
    judged = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("bigint")).alias("good"),
        F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("bigint")).alias("toxic"),
    )
    rows = failures(docs).join(judged, "doc_id", "left")
    lost = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0).cast("bigint"))).alias(c)
    counted = rows.groupBy("part", "bits").agg(lost("good"), lost("toxic"), F.sum("n").alias("n"))
    return counted.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("combos"))


def _total(combos: Column, which, what) -> Column:
    return F.aggregate(F.filter(combos, which), F.lit(0).cast("bigint"), lambda total, c: total + what(c))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, filter_order and step what the step's filter keeps and removes.

    docs has doc_id, text and lang, labels doc_id, quality and toxic.
    """
    steps = F.array(*[F.lit("".join(order)) for order in permutations(FILTERS)])
    rows = combinations(docs, labels).select("part", "combos", F.explode(steps).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit_of = F.create_map(*[F.lit(x) for pair in BITS.items() for x in pair])
    letters = F.split(F.col("filter_order"), "")
    rows = rows.select(
        "*",
        F.try_element_at(bit_of, F.substring("filter_order", F.col("step"), F.lit(1))).alias("bit"),
        F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda bits, x: bits.bitwiseOR(F.try_element_at(bit_of, x))).alias("before"),
    )
    combos, bit, before = F.col("combos"), F.col("bit"), F.col("before")
    fails = lambda c: c["bits"].bitwiseAND(bit) != 0
    here = lambda c: fails(c) & (c["bits"].bitwiseAND(before) == 0)
    rows_of = lambda c: c["n"]
    orders = 120
    return rows.select(
        "part", "filter_order", "step",
        _total(combos, lambda c: c["bits"].bitwiseAND(before.bitwiseOR(bit)) == 0, rows_of).alias("kept"),
        _total(combos, here, rows_of).alias("removed"),
        _total(combos, lambda c: fails(c) & (c["bits"].bitwiseAND(before) != 0), rows_of).alias("redundant"),
        _total(combos, lambda c: c["bits"] == bit, rows_of).alias("unique_fails"),
        _total(combos, here, lambda c: c["good"]).alias("good_lost"),
        _total(combos, here, lambda c: c["toxic"]).alias("toxic_lost"),
        # In the orders, each of a document's failing filters comes first equally often.
        _total(combos, fails, lambda c: c["n"] * (F.lit(orders) / F.bit_count(c["bits"])).cast("bigint")).alias("shapley"),
    )


_TOTALS = {
    "kept": "count(*) FILTER (WHERE bits & (before | bit) = 0)",
    "removed": "count(*) FILTER (WHERE bits & bit > 0 AND bits & before = 0)",
    "redundant": "count(*) FILTER (WHERE bits & bit > 0 AND bits & before > 0)",
    "unique_fails": "count(*) FILTER (WHERE bits = bit)",
    "good_lost": "count(*) FILTER (WHERE bits & bit > 0 AND bits & before = 0 AND good)",
    "toxic_lost": "count(*) FILTER (WHERE bits & bit > 0 AND bits & before = 0 AND toxic)",
}

ORACLE = rf"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
firsts AS (SELECT text AS same, min(doc_id) AS first_id FROM texts GROUP BY text),
judged AS (SELECT doc_id AS labelled, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
docs AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN first_id < doc_id THEN 16 ELSE 0 END) AS bits
  FROM words LEFT JOIN firsts ON text = same LEFT JOIN judged ON doc_id = labelled),
letters AS (SELECT chr(65 + i::INTEGER) AS c, (1 << i)::INTEGER AS b FROM range(5) AS r(i)),
orders AS (
  SELECT v.c || w.c || x.c || y.c || z.c AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bs
  FROM letters v, letters w, letters x, letters y, letters z WHERE v.b + w.b + x.b + y.b + z.b = 31
    AND v.b | w.b | x.b | y.b | z.b = 31),
steps AS (SELECT filter_order, step::INTEGER AS step, bs[step] AS bit, coalesce(list_sum(bs[1:step - 1]), 0)::INTEGER AS before
          FROM orders, range(1, 6) AS r(step)),
counted AS (SELECT part, filter_order, step, bit, {", ".join(f"{sql} AS {name}" for name, sql in _TOTALS.items())}
            FROM docs, steps GROUP BY ALL),
shares AS (SELECT part AS p, bit AS b, sum(removed)::BIGINT AS shapley FROM counted GROUP BY ALL)
SELECT part, filter_order, step, {", ".join(_TOTALS)}, shapley FROM counted JOIN shares ON part = p AND bit = b
"""
