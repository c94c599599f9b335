"""Distributed order operators against plain Python."""

import math
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from smeltery.functions import ordered


@pytest.fixture(scope="module")
def values():
    rng = random.Random(7)
    rows = [("hot", round(rng.expovariate(1 / 400), 3)) for _ in range(4000)]
    rows += [("same", 5.0)] * 300 + [("one", 0.001)] + [(f"k{i % 40}", round(rng.uniform(0, 90000), 3)) for i in range(2000)]
    rows += [("zero", 0.0)] * 5
    return rows


def test_percentiles_match(spark, values):
    df = spark.createDataFrame([(k, D(str(v))) for k, v in values], "k string, v decimal(15,3)")
    probs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    got = {r.k: r for r in ordered.percentiles_cont(df, ["k"], "v", probs).collect()}
    groups = {}
    for k, v in values:
        groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, xs in groups.items():
        xs.sort()
        for name, p in probs.items():
            spot = (len(xs) - 1) * p
            low, high = xs[math.floor(spot)], xs[math.ceil(spot)]
            assert got[k][name] == pytest.approx(low + (high - low) * (spot - math.floor(spot)), abs=1e-9)


def test_null_values_do_not_count(spark):
    df = spark.createDataFrame([("a", None), ("a", D("1.000")), ("b", None)], "k string, v decimal(15,3)")
    got = ordered.order_statistics(df, ["k"], "v", {"m": F.floor(F.col("n") / 2)}).collect()
    assert [(r.k, r.n, r.m) for r in got] == [("a", 1, 1.0)]


def test_index_is_dense_with_ties(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("v"), F.col("id"))
    got = ordered.ordered_index(df, ["v", "id"]).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(5000))
    assert [(r.v, r.id) for r in got] == sorted((i % 3, i) for i in range(5000))


@pytest.mark.parametrize("n", [3, 4, 10, 1001])
def test_ntile(spark, n):
    df = spark.range(n).select("id")
    got = {r.id: r.t for r in ordered.ntile_over(df, [F.col("id")], 4, "t").collect()}
    size, extra = divmod(n, 4)
    expected, at = {}, 0
    for tile in range(1, 5):
        for _ in range(size + (tile <= extra)):
            expected[at] = tile
            at += 1
    assert got == expected


def test_dense_rank(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 9), ("d", None)], "g string, m int")
    got = {r.g: r.rank for r in ordered.dense_rank_over(df, "m", "rank").collect()}
    assert got == {"c": 1, "a": 2, "b": 2, "d": 3}


def test_surrogate_keys_start_after_the_highest(spark):
    df = spark.createDataFrame([(30,), (10,), (20,)], "n int")
    got = {r.n: r.key for r in ordered.with_surrogate_key(df, "key", ["n"], 7).collect()}
    assert got == {10: 8, 20: 9, 30: 10}


def test_position_in_key_matches_row_number(spark):
    from pyspark.sql import Window as W

    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5).alias("k"), (F.col("id") * 7919 % 97).alias("v"), "id"
    )
    got = ordered.position_in_key(df, ["k"], [F.col("v").desc(), F.col("id")], "p")
    want = df.withColumn("p", F.row_number().over(W.partitionBy("k").orderBy(F.col("v").desc(), "id")))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
