"""Exact quantiles that never gather a column in one task.

``percentile`` keeps every distinct value of a group in one task's memory. Here
equal values are first counted (so a hot value is one row), an approximate sketch
with a known error bound brackets each wanted rank, and only the values inside
that narrow bracket are ordered. The answer is exact, with linear interpolation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), accuracy: int = ACCURACY
) -> DataFrame:
    """Columns ``by``, ``prob``, ``quantile``."""
    by = list(by)
    data = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    slack = 2.0 / accuracy
    low = [max(0.0, p - slack) for p in probs]
    high = [min(1.0, p + slack) for p in probs]
    sketch = data.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min("__v").alias("__min"),
        F.max("__v").alias("__max"),
        F.percentile_approx("__v", low, accuracy).alias("__lo"),
        F.percentile_approx("__v", high, accuracy).alias("__hi"),
    )
    wanted = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(float(p)).alias("prob"),
                    # the end brackets are the true extremes, not sketch values
                    (F.col("__min") if p <= slack else F.element_at("__lo", i + 1)).alias("lo"),
                    (F.col("__max") if p >= 1 - slack else F.element_at("__hi", i + 1)).alias("hi"),
                )
                for i, p in enumerate(probs)
            ]
        )
    )
    bracket = sketch.select(*by, "__n", wanted.alias("q")).select(
        *by, "q.*", ((F.col("__n") - 1) * F.col("q.prob")).alias("rank")
    )
    counts = data.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__c"))
    # one bracket row per group and probability
    joined = counts.join(bracket, by) if by else counts.crossJoin(F.broadcast(bracket))
    keys = [*by, "prob"]
    # widen each bracket by one value, as a rank may fall between two of them
    v, c = F.col("__v"), F.col("__c")
    under, over = v < F.col("lo"), v > F.col("hi")
    edge = joined.groupBy(*keys).agg(
        (F.sum(F.when(under, c).otherwise(0)) - F.coalesce(F.max_by(F.when(under, c), F.when(under, v)), F.lit(0))).alias("__below"),
        F.coalesce(F.max(F.when(under, v)), F.min("lo")).alias("lo"),
        F.coalesce(F.min(F.when(over, v)), F.max("hi")).alias("hi"),
    )
    inside = joined.drop("lo", "hi").join(edge, keys).filter(v.between(F.col("lo"), F.col("hi")))
    up_to = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("__cum", F.sum("__c").over(up_to))
    last = F.col("__below") + F.col("__cum") - 1  # highest 0-based rank of this value
    first = last - F.col("__c") + 1
    lo_rank, hi_rank = F.floor("rank"), F.ceil("rank")
    at = lambda r: F.max(F.when(r.between(first, last), F.col("__v")))
    out = inside.groupBy(*keys).agg(at(lo_rank).alias("__a"), at(hi_rank).alias("__b"), F.max("rank").alias("rank"))
    frac = F.col("rank") - F.floor("rank")
    found = F.col("__a") + (F.col("__b") - F.col("__a")) * frac
    missed = F.raise_error(F.lit("quantile outside its bracket")).cast("double")
    return out.select(*keys, F.coalesce(found, missed).alias("quantile"))


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std (sample), min, quartiles, max."""
    by = list(by)
    stats = df.groupBy(*by).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], by)
    pick = lambda p: F.max(F.when(F.col("prob") == p, F.col("quantile")))
    q = q.groupBy(*by).agg(pick(0.25).alias("q25"), pick(0.5).alias("q50"), pick(0.75).alias("q75"))
    # without groups both sides are a single row
    return stats.join(q, by, "left") if by else stats.crossJoin(F.broadcast(q))


