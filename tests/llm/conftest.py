import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use themselves.
        *(T.StructField(name, T.StringType()) for name in ("kept", "size", "statistics", "digest", "value", "id", "sha", "_r")),
    ]
)
EXTRA = ("x",) * 8


def prose(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(("ta", "lo", "mi", "ser", "un", "é")) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def edge_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, white space, non-Latin letters."""
    long_text = " ".join(prose(1, 60_000))
    base = prose(2, 300)
    near = [*base[:150], "changed", *base[151:]]
    texts = [
        (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One TWO"), (5, long_text), (6, " ".join(base)),
        (7, " ".join(base)), (8, " ".join(near)), (9, "word " * 500), (10, "a\nb c\na\nb c\n \n"), (11, "Ελληνικά 漢字 🙂 \u0085x"),
        (12, "\n".join(["the same line here"] * 40)), (None, "no id at all"), (None, None), (6, " ".join(base)), (13, "1 2 3 !!"),
        (14, "Released under the MIT License."), (15, " ".join(prose(3, 40))),
    ]
    return [
        (i, t, (None, "en", "de")[k % 3], (None, "s1", "s2", "s2")[k % 4], None if t is None else len(t), *EXTRA)
        for k, (i, t) in enumerate(texts)
    ]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3, "text").cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
