"""Column helpers and DataFrame operators."""

from __future__ import annotations

from decimal import Decimal as D

from pyspark.sql import functions as F

from larkspur.functions import columns as C
from larkspur.operators import frames


def test_columns(spark):
    df = spark.createDataFrame([(2.5, 5, "hello", None), (-2.5, -5, "ab ", 1)], "x double, n int, s string, m int")
    got = df.select(
        C.to_int("x").alias("i"), C.between3("n", F.lit(1), F.col("m")).alias("b"), C.substring("s", -10, 3).alias("a"), C.substring("s", 0).alias("z"), C.round_float("x").alias("r"), C.blank_equal("s", F.lit("ab")).alias("e")
    ).collect()
    assert [tuple(r) for r in got] == [(3, None, "hel", "hello", 3.0, False), (-3, False, "ab ", "ab ", -2.0, True)]
    agg = df.agg(C.sum_exact("n", 10, 2), C.avg_exact("m"), C.avg_exact(F.col("n") + 6)).first()
    assert tuple(agg) == (D("0.00"), D("1.000000"), D("6.000000"))
    assert [r.m for r in df.orderBy(C.asc("m")).collect()] == [1, None] and [r.m for r in df.orderBy(C.desc("m")).collect()] == [None, 1]


def test_frames(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(2, "x"), (3, "y")], "k int, w string")
    assert sorted(map(str, frames.join_using(a, b, ["k"], "full").collect())) == sorted(["Row(k=1, v='a', w=None)", "Row(k=2, v='b', w='x')", "Row(k=3, v=None, w='y')", "Row(k=None, v='n', w=None)"])
    assert [r.k for r in frames.not_in(a, "k", b, "k").collect()] == [1]
    assert frames.not_in(a, "k", a, "k").count() == 0 and frames.not_in(a, "k", b.limit(0), "k").count() == 3
    assert [r.k for r in frames.top(a, 2, ("k", True)).collect()] == [None, 2]
    assert frames.duplicate_keys(a.union(a), "k").count() == 3 and [r.k for r in frames.orphans(a, ["k"], b, ["k"]).collect()] == [1]
