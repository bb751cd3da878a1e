"""The chunked helpers must equal plain windows whatever the chunk size."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from courtflow.operators.ordered import last_before, next_after, running_sum, with_lookback
from courtflow.operators.quantiles import exact_quantiles


def by_match():
    return Window.partitionBy("m").orderBy("f")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for m in range(12):
        f = rng.randrange(-5, 5)
        for _ in range(rng.choice([1, 2, 5, 40])):
            data.append((m, f, rng.choice([None, 1, 2, 3])))
            f += rng.choice([1, 1, 2, 9])
    return spark.createDataFrame(data, "m long, f long, v long").cache()


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_carries(rows, size):
    got = last_before(rows, ["m"], ["f"], {"a": F.col("v"), "z": F.col("v")}, size, earliest=["z"])
    before = by_match().rowsBetween(Window.unboundedPreceding, -1)
    same(
        got.select("m", "f", "a", "z"),
        rows.select("m", "f", F.last("v", True).over(before).alias("a"), F.first("v", True).over(before).alias("z")),
    )
    after = by_match().rowsBetween(1, Window.unboundedFollowing)
    got = next_after(rows, ["m"], ["f"], {"a": F.col("v")}, size)
    same(got.select("m", "f", "a"), rows.select("m", "f", F.first("v", True).over(after).alias("a")))


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_running_sum(rows, size):
    got = running_sum(rows, ["m"], ["f"], {"s": F.col("v"), "n": F.lit(1)}, size).select("m", "f", "s", "n")
    up_to = by_match().rowsBetween(Window.unboundedPreceding, 0)
    same(got, rows.select("m", "f", F.coalesce(F.sum("v").over(up_to), F.lit(0)), F.count(F.lit(1)).over(up_to)))


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
@pytest.mark.parametrize("n", [1, 4])
def test_lookback(rows, size, n):
    def compute(df, w):
        return df.withColumn("h", F.collect_list(F.coalesce("v", F.lit(0))).over(w.rowsBetween(-n, 0)))

    got = with_lookback(rows, ["m"], ["f"], n, compute, size).select("m", "f", "h")
    same(got, compute(rows, by_match()).select("m", "f", "h"))


@pytest.mark.parametrize("accuracy", [20, 1000])
def test_quantiles(spark, accuracy):
    import numpy as np

    rng = random.Random(8)
    groups = {"one": [4.0], "two": [1.0, 9.0], "hot": [5.0] * 4000 + [float(i) for i in range(50)]}
    groups["wide"] = [rng.random() ** 3 for _ in range(5000)]
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r.g, r.prob): r.quantile for r in exact_quantiles(df, "x", probs, ["g"], accuracy).collect()}
    for g, xs in groups.items():
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile(xs, p), abs=1e-12), (g, p)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_null_keys_and_frames_keep_their_rows(spark, size):
    """Null keys are a group of their own and rows without frame come last, as in the SQL checks."""
    rng = random.Random(9)
    data = [(m, t, f, rng.choice([None, 1, 2, 3])) for m in (None, 0, 1) for t in (None, 0, 4) for f in [None, *range(-4, 12, 2)]]
    df = spark.createDataFrame(data, "m long, t long, f long, v long")
    w = Window.partitionBy("m", "t").orderBy(F.col("f").asc_nulls_last())
    got = last_before(df, ["m", "t"], ["f"], {"a": F.col("v")}, size)
    same(got, df.withColumn("a", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    got = next_after(df, ["m", "t"], ["f"], {"a": F.col("v")}, size)
    same(got, df.withColumn("a", F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing))))
    got = running_sum(df, ["m", "t"], ["f"], {"n": F.lit(1)}, size)
    same(got, df.withColumn("n", F.count(F.lit(1)).over(w)))
    steps = lambda d, w: d.withColumn("h", F.collect_list(F.coalesce("v", F.lit(0))).over(w.rowsBetween(-2, 0)))
    same(with_lookback(df, ["m", "t"], ["f"], 2, steps, size), steps(df, w))
