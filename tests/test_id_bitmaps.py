"""Bitmap comparison of id sets against the joins."""

import pytest
from packloom.operators import id_bitmaps, quality
from pyspark.sql import functions as F

EDGES = [-32_769, -32_768, -32_767, -1, 0, 1, 2, 32_768, 32_769, 65_536, 65_537, 10**12]


def frame(spark, ids, kind="long"):
    return spark.createDataFrame([(i,) for i in ids], f"id {kind}")


@pytest.mark.parametrize("drop", range(len(EDGES)))
def test_each_edge_alone(spark, drop):
    rest = [i for i in EDGES if i != EDGES[drop]]
    got = id_bitmaps.id_differences(frame(spark, EDGES), frame(spark, rest + [5]), "id")
    assert {tuple(r) for r in got.collect()} == {(EDGES[drop], "missing"), (5, "unexpected")}


def test_equals_the_joins_with_repeats(spark):
    left = spark.range(0, 100_000).where(F.col("id") % 7 != 3).select((F.col("id") - 30_000).alias("id"))
    left = left.unionAll(left.limit(50))
    right = spark.range(0, 100_000).where(F.col("id") % 11 != 5).select((F.col("id") - 30_000).alias("id"))
    got, want = (f(left, right, "id") for f in (id_bitmaps.id_differences, quality.id_differences))
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    common = id_bitmaps.common_ids(left, right, "id")
    assert common.exceptAll(left.distinct().join(right, "id", "left_semi")).isEmpty()
    assert common.count() == left.distinct().join(right, "id", "left_semi").count()
    plans = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hash") for df in (got, want)]
    assert plans[0] < plans[1]


def test_nulls_types_and_empty_sides(spark):
    left, none = frame(spark, [1, None, 2], "int"), frame(spark, [], "int")
    got = id_bitmaps.id_differences(left, none, "id")
    assert got.schema["id"].dataType == left.schema["id"].dataType
    assert sorted(tuple(r) for r in got.collect()) == [(1, "missing"), (2, "missing")]
    assert id_bitmaps.id_differences(none, none, "id").count() == 0
    assert id_bitmaps.common_ids(left, none, "id").count() == 0
