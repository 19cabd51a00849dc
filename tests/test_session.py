"""Shared folder, materialized tables, broadcast check."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from posterwall.session import broadcast_if_small, materialize, shared_dir


def _session(master, root=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: root), sparkContext=SimpleNamespace(master=master)
    )


def test_shared_dir():
    assert shared_dir(_session("yarn", "hdfs://shared/"), "x").startswith("hdfs://shared/x-")
    assert shared_dir(_session("local[2]"), "x") != shared_dir(_session("local[2]"), "x")
    with pytest.raises(ValueError):
        shared_dir(_session("yarn"), "x")


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.range(7).select("id", F.struct(F.lit("a").alias("b"), F.array("id").alias("c")).alias("s"))
    written = materialize(df, "t")
    assert written.dtypes == df.dtypes
    assert sorted(map(str, written.collect())) == sorted(map(str, df.collect()))


@pytest.mark.parametrize("rows, chars, hinted", [(10, 100, True), (9, 100, False), (10, 9, False)])
def test_broadcast_only_below_both_bounds(spark, rows, chars, hinted):
    checked = broadcast_if_small(spark.range(10), F.lit(1), max_rows=rows, max_chars=chars)
    plan = spark.range(10**6).join(checked, "id")._jdf.queryExecution().logical().toString()
    assert ("ResolvedHint" in plan or "UnresolvedHint" in plan) == hinted
