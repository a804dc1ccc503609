from __future__ import annotations

import math
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelkit.functions.labels import ordinal, relabel
from panelkit.functions.semantics import clamp_negative, nan_to_null, ratio, search_sorted, sort_key


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_ratio_by_zero(spark):
    lit = F.lit
    assert one(spark, ratio(lit(1.0), lit(0.0))) is None
    assert one(spark, ratio(lit(1.0), lit(0.0), "ieee")) == math.inf
    assert one(spark, ratio(lit(-1.0), lit(0.0), "ieee")) == -math.inf
    assert math.isnan(one(spark, ratio(lit(0.0), lit(0.0), "ieee")))
    assert one(spark, ratio(lit(3.0), lit(2.0), "ieee")) == 1.5
    assert one(spark, ratio(lit(None).cast("double"), lit(0.0), "ieee")) is None
    with pytest.raises(ValueError):
        ratio(lit(1.0), lit(0.0), "inf")


def test_nan_is_missing_and_clamp_keeps_null(spark):
    assert one(spark, nan_to_null(F.lit(float("nan")))) is None
    assert one(spark, nan_to_null(F.lit(2.0))) == 2.0
    assert one(spark, clamp_negative(F.lit(None).cast("double"))) is None
    assert one(spark, clamp_negative(F.lit(-0.5))) == 0.0


def bits(v: float) -> int:
    raw = struct.unpack(">q", struct.pack(">d", abs(v)))[0]
    return -raw if v < 0 else raw


def test_sort_key_equals_the_bits_of_the_double(spark):
    edge = [0.0, -0.0, 1.0, -1.0, 2.0, 1e300, 5e-324, 2.2250738585072014e-308, 1e-310, math.inf, -math.inf]
    powers = [math.ldexp(1.0, e) for e in range(-1074, 1024, 7)]
    near = [math.nextafter(p, d) for p in powers for d in (0.0, math.inf)]
    values = edge + powers + near + [-v for v in powers]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", sort_key(F.col("v")).alias("k")).collect():
        assert row["k"] == bits(row["v"]), row["v"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=20, max_size=60))
def test_sort_key_keeps_order(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["v"]: r["k"] for r in df.select("v", sort_key(F.col("v")).alias("k")).collect()}
    assert all(got[v] == bits(v) for v in values)


def test_search_sorted_counts_smaller_points(spark):
    points = [1.0, 2.0, 2.0, 5.0, 9.0]
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 3.0, 5.0, 8.9, 9.0, 10.0)], "v double")
    got = [r["i"] for r in search_sorted(df, "v", points, "i").collect()]
    assert got == [0, 0, 1, 3, 3, 4, 4, 5]
    assert search_sorted(df, "v", [], "i").agg(F.sum("i")).first()[0] == 0


def test_labels(spark):
    assert one(spark, relabel(F.lit(8), {7: "a", 8: "b"})) == "b"
    assert one(spark, relabel(F.lit(9), {7: "a", 8: "b"})) is None
    assert one(spark, ordinal(F.lit("W1"), ("D1", "W1"))) == 2
    assert one(spark, ordinal(F.lit("x"), ("D1", "W1"))) is None
