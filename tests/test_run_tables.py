"""Tables of a run that share a step read it from one stored table."""

from courtflow.plans.tables import Tables
from courtflow.sources import sinks

SF = "/root/testdata/sf0.001"


def test_shared_steps_are_computed_once(spark):
    t = Tables(spark, SF)
    made = sinks.calibrated_run_tables(t.detections, t.frames, t.ocr_reads)
    plan = lambda name: made[name]._jdf.queryExecution().optimizedPlan().toString()
    for name in ("possession_data", "shot_attempts", "shot_results"):
        assert not any(node in plan(name) for node in ("Join", "Window", "Aggregate")), name
    assert plan("shooting_statistics").count("Join") == 1 and "Window" not in plan("shooting_statistics")
    assert made["possession_data"].count() == t.frames.count()
