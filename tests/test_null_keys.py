"""Rows without match or frame number are neither lost nor end a run."""

import pytest
from pyspark.sql import functions as F

from courtflow.operators import calibration, folds, ordered

SCHEMA = "match_id long, frame_number long, det_no long, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize("size", [4, 16_384])
def test_tracker_keeps_every_detection(spark, size):
    rows = [(m, f, 1, 10.0 + (f or 0), 10.0, 60.0 + (f or 0), 90.0) for m in (1, None) for f in (0, 1, 2, 7, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.match_id, r.frame_number): r.track_id for r in folds.iou_tracker(df, size=size).collect()}
    assert len(got) == len(rows)
    assert {v for k, v in got.items() if k[1] is not None} == {1} and got[1, None] is None and got[None, None] is None


def test_no_frame_no_matrix(spark):
    rows = [(1, None, 1, 0.0, 0.0, 2.0, 2.0), (1, 5, 1, 0.0, 0.0, 2.0, 2.0), (None, 5, 1, 0.0, 0.0, 2.0, 2.0)]
    cal = spark.createDataFrame([(1, 0, [5.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]), (1, None, [9.0] * 9)], "match_id long, from_frame long, h array<double>")
    got = {(r.match_id, r.frame_number): r.court_x for r in calibration.with_court_coords(spark.createDataFrame(rows, SCHEMA), cal).collect()}
    assert got == {(1, None): None, (1, 5): 5.0, (None, 5): None}


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_blended_is_a_plain_loop(spark, size):
    values = [None, 4.0, None, 1.0, 8.0, 2.0, 2.0, None, 5.0, 3.0]
    rows = [(m, f, v) for m in (1, None) for f, v in enumerate(values)] + [(1, None, 7.0)]
    df = spark.createDataFrame(rows, "match_id long, frame_number long, v double").repartition(4)
    value = F.when(F.col("v").isNotNull(), F.array("v", F.col("v") * 2))
    out = ordered.blended(df, ["match_id"], ["frame_number"], value, F.lit(0.25), "x", size).collect()
    assert len(out) == len(rows)
    x, want = None, []
    for v in values:
        x = x if v is None else v if x is None else 0.25 * v + 0.75 * x
        want.append(x)
    for m in (1, None):
        got = [r.x for r in sorted((r for r in out if r.match_id == m and r.frame_number is not None), key=lambda r: r.frame_number)]
        assert [g and g[0] for g in got] == pytest.approx(want) and [g and g[1] for g in got] == pytest.approx([w and 2 * w for w in want])
    assert [r.x for r in out if r.frame_number is None] == [None]
