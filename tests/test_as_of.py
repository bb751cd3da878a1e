"""The as-of step sorts rows without the matrices carried to them, in as many tasks as asked for."""

from pyspark.sql import functions as F

from courtflow.operators import calibration as C
from courtflow.operators.ordered import last_before


def test_carried_values_are_not_sorted(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("m"), F.col("id").alias("f"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    plan = last_before(rows, ["m"], ["f"], {"a": F.col("v")}, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "TASK_ROWS", 10)
    df = spark.range(500).select((F.col("id") % 4).alias("match_id"), F.col("id").alias("frame_number"), F.lit(1).cast("long").alias("det_no"))
    cal = spark.createDataFrame([(0, 40, [1.0]), (0, 200, None), (0, 300, [2.0]), (3, 3, [3.0])], "match_id long, from_frame long, h array<double>")
    assert C.tasks_for(df) == 50
    got = C.calibration_as_of(df, cal, size=16, tasks=C.tasks_for(df))
    assert got.rdd.getNumPartitions() == 50

    def in_force(m, f):
        known = [(x["from_frame"], x["h"]) for x in cal.collect() if x["match_id"] == m and x["from_frame"] <= f]
        return max(known, key=lambda x: x[0])[1] if known else None

    assert got.count() == 500
    sample = got.filter(F.col("frame_number") % 9 == 0).collect()
    assert all(r["h"] == in_force(r["match_id"], r["frame_number"]) for r in sample)
