"""Calibration matrices: which is in force, applying them, and their quality."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtflow.constants import CALIBRATION_ADVICE, COURT_LENGTH, COURT_WIDTH
from courtflow.functions import geometry as G
from courtflow.functions.court import court_corners, whole_pixels
from courtflow.functions.geometry import safe_div
from courtflow.functions.shots import hoop_quality
from courtflow.operators.ordered import CHUNK_FRAMES, blended, last_before

FRAME = ["match_id", "frame_number"]
TASK_ROWS = 500_000


def with_inverse(calibrations: DataFrame) -> DataFrame:
    """Inverse matrix and pixel outline of the court, once per matrix.

    Exploding a single value between the steps keeps Spark from merging them into
    one expression with the inverse spelled out at every corner."""
    d = calibrations.withColumn("h_inv", F.explode(F.array(G.inverse("h"))))
    d = d.withColumn("__corners", F.explode(F.array(court_corners("h_inv"))))
    return d.withColumn("outline", F.when(F.col("h_inv").isNotNull(), whole_pixels("__corners"))).drop("__corners")


def calibration_as_of(
    df: DataFrame, calibrations: DataFrame, carry: str = "h", size: int = CHUNK_FRAMES, tasks: int | None = None
) -> DataFrame:
    """Rows with the matrix in force: the latest with from_frame <= frame_number.
    ``carry`` names the calibration column to bring (the matrix, its inverse ...). A row without
    frame number has no matrix; a matrix without from_frame is never in force.

    Both tables are put in one frame order and the last matrix is carried forward,
    so no range of pairs is formed. ``df`` needs a ``det_no`` (any row number). A task sorts its
    chunks of rows, so ``tasks`` (see ``tasks_for``) should grow with a large table."""
    cols = df.columns
    # wrapped, so that a matrix without the wanted value still ends the one before it
    wrapped = T.StructType([T.StructField("v", calibrations.schema[carry].dataType)])
    rows = df.withColumns({"__kind": F.lit(1), "__cal": F.lit(None).cast(wrapped)})
    cal = calibrations.select(
        *[
            F.col("match_id") if c == "match_id"
            else F.col("from_frame").alias(c) if c == "frame_number"
            else F.lit(-1).cast(df.schema[c].dataType).alias(c) if c == "det_no"
            else F.lit(None).cast(df.schema[c].dataType).alias(c)
            for c in cols
        ],
        F.lit(0).alias("__kind"),
        F.struct(F.col(carry).alias("v")).alias("__cal"),
    )
    both = rows.unionByName(cal.filter(F.col("frame_number").isNotNull()))
    out = last_before(both, ["match_id"], ["frame_number", "__kind", "det_no"], {"__in_force": F.col("__cal")}, size, tasks=tasks)
    in_force = F.when(F.col("frame_number").isNotNull(), F.col("__in_force.v"))
    return out.filter(F.col("__kind") == 1).select(*cols, in_force.alias(carry))


def tasks_for(df: DataFrame) -> int:
    """As many tasks as give each about ``TASK_ROWS`` rows, and no fewer than Spark's own number. Counts
    the rows, so ``df`` should be a table of files."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / TASK_ROWS))


def with_court_coords(detections: DataFrame, calibrations: DataFrame, size: int = CHUNK_FRAMES, tasks: int | None = None) -> DataFrame:
    """Court position of each box centre; null while no matrix is in force."""
    d = calibration_as_of(detections.drop("court_x", "court_y"), calibrations, size=size, tasks=tasks)
    b = G.box()
    x, y = G.pixel_to_court("h", G.center_x(b), G.center_y(b))
    return d.withColumns({"court_x": x, "court_y": y})


def valid_calibrations(calibrations: DataFrame) -> DataFrame:
    return calibrations.withColumn("is_valid", G.matrix_ok("h", "confidence"))


def blended_history(calibrations: DataFrame, alpha: float = 0.3, size: int = CHUNK_FRAMES) -> DataFrame:
    """Each matrix blended with the one before it in the match."""
    d = last_before(calibrations, ["match_id"], ["from_frame"], {"__old": F.col("h")}, size)
    return d.withColumn("h", G.blend_homography("__old", "h", alpha)).drop("__old")


def select_best_calibration(calibrations: DataFrame) -> DataFrame:
    """The most confident matrix of each match; the earliest on a tie."""
    cols = [c for c in calibrations.columns if c != "match_id"]
    best = F.max_by(F.struct(*cols), F.struct("confidence", -F.col("from_frame"))).alias("c")
    return calibrations.groupBy("match_id").agg(best).select("match_id", "c.*")


def reprojection_errors(points: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Distance between transformed and expected points (match_id, point_no, px, py,
    court_x, court_y). ``calibrations`` has one matrix per match, such as the chosen one."""
    d = points.join(calibrations.select("match_id", "from_frame", "h"), "match_id")
    x, y = G.pixel_to_court("h", "px", "py")
    return d.withColumn("error", G.euclidean(x, y, "court_x", "court_y")).drop("h")


def transformation_error_stats(errors: DataFrame) -> DataFrame:
    mean, top = F.avg("error"), F.max("error")
    return errors.groupBy("match_id", "from_frame").agg(
        mean.alias("mean_error"),
        top.alias("max_error"),
        F.stddev_pop("error").alias("std_error"),
        ((mean < 0.5) & (top < 1.0)).alias("is_valid"),
    )


def hoop_quality_by_frame(hoops: DataFrame) -> DataFrame:
    q = hoop_quality("confidence", G.area(G.box()))
    return hoops.groupBy(*FRAME).agg(F.avg(q).alias("quality"), F.count(F.lit(1)).alias("hoops"))


def hoop_detection_stats(hoops: DataFrame) -> DataFrame:
    """Per match: confidence spread and frames with one or at least two hoops."""
    per_frame = hoops.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("c"),
        F.sum("confidence").alias("s"),
        F.min("confidence").alias("lo"),
        F.max("confidence").alias("hi"),
    )
    return per_frame.groupBy("match_id").agg(
        (F.sum("s") / F.sum("c")).alias("avg_confidence"),
        F.min("lo").alias("min_confidence"),
        F.max("hi").alias("max_confidence"),
        F.avg("c").alias("avg_hoops_per_frame"),
        F.count_if(F.col("c") >= 2).alias("frames_with_2_hoops"),
        F.count_if(F.col("c") == 1).alias("frames_with_1_hoop"),
    )


def calibration_quality(attempts: DataFrame) -> DataFrame:
    """Accuracy of the successful attempts per match, with quality bands."""
    a = F.col("accuracy")
    return attempts.filter("success").groupBy("match_id").agg(
        F.avg(a).alias("avg_accuracy"),
        F.min(a).alias("min_accuracy"),
        F.max(a).alias("max_accuracy"),
        F.stddev_pop(a).alias("std_accuracy"),
        F.count_if(a > 0.8).alias("high_quality"),
        F.count_if(a.between(0.6, 0.8)).alias("medium_quality"),
        F.count_if(a < 0.6).alias("low_quality"),
    )


def method_distribution(attempts: DataFrame) -> DataFrame:
    return attempts.filter("success").groupBy("match_id", "method").agg(F.count(F.lit(1)).alias("n"))


def calibration_attempt_summary(attempts: DataFrame) -> DataFrame:
    ok = F.col("success")
    return attempts.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("total_attempts"),
        F.count_if(ok).alias("successful_attempts"),
        F.count_if(~ok).alias("failed_attempts"),
        (F.count_if(ok) / F.count(F.lit(1))).alias("success_rate"),
        F.max("confidence").alias("best_confidence"),
        F.coalesce(F.avg(F.when(ok, F.col("accuracy"))), F.lit(0.0)).alias("average_accuracy"),
    )


def best_calibration_parameters(attempts: DataFrame) -> DataFrame:
    """Parameter with the highest success rate x mean accuracy; the lower one on a
    tie, none when no score is positive. ``attempts`` has one row per frame with hoops."""
    ok = F.col("success")
    d = attempts.groupBy("parameter").agg(
        safe_div(F.count_if(ok), F.greatest(F.count(F.lit(1)), F.lit(1))).alias("success_rate"),
        F.avg(F.when(ok, F.col("accuracy"))).alias("avg_accuracy"),
    )
    d = d.withColumn("score", F.col("success_rate") * F.col("avg_accuracy")).filter(F.col("score") > 0)
    best = F.max_by(F.struct("parameter", "score"), F.struct("score", -F.col("parameter"))).alias("b")
    return d.agg(best).select("b.*")


def estimate_hoop_targets(hoops: DataFrame, frames: DataFrame) -> DataFrame:
    """Confidence by hoop count per frame, and the court ends when both are seen."""
    n = hoops.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("hoops"))
    d = frames.select(*FRAME).join(n, FRAME, "left").withColumn("hoops", F.coalesce("hoops", F.lit(0).cast("long")))
    two = F.col("hoops") >= 2
    at = lambda x: F.when(two, F.lit(x))
    return d.withColumns(
        {
            "confidence": F.when(two, 0.9).when(F.col("hoops") == 1, 0.5).otherwise(0.0),
            "left_x": at(0.0),
            "right_x": at(COURT_LENGTH),
            "goal_y": at(COURT_WIDTH / 2),
        }
    )


def auto_recalibrate(
    drift: DataFrame,
    check_interval: int = 30,
    min_interval: int = 60,
    threshold_px: float = 20.0,
    min_hoops: int = 1,
    size: int = CHUNK_FRAMES,
) -> DataFrame:
    """Frames at which to recalibrate. ``drift``: match_id, frame_number, hoops, drift_px.

    Every ``check_interval`` frames, when enough hoops are seen and they drifted too
    far, unless the last recalibration is under ``min_interval`` frames ago. A
    candidate at least ``min_interval`` after the one before always fires, so runs
    of closer candidates are independent. With an interval of at most two checks the
    candidates of a run are evenly spaced and every n-th fires."""
    if min_interval > 2 * check_interval:
        from courtflow.operators.folds import debounced

        candidates = _drifted(drift, check_interval, threshold_px, min_hoops)
        return debounced(candidates, min_interval, size)
    d = _drifted(drift, check_interval, threshold_px, min_hoops)
    d = last_before(d, ["match_id"], ["frame_number"], {"__prev": F.col("frame_number")}, size)
    first = F.when(
        F.col("__prev").isNull() | (F.col("frame_number") - F.col("__prev") >= min_interval), F.col("frame_number")
    )
    d = last_before(d, ["match_id"], ["frame_number"], {"__run": first}, size)
    every = check_interval * math.ceil(min_interval / check_interval)
    d = d.withColumn("__run", F.coalesce(first, F.col("__run")))
    return d.filter((F.col("frame_number") - F.col("__run")) % every == 0).select(*FRAME, "drift_px")


def recalibrated(calibrations: DataFrame, decisions: DataFrame, alpha: float = 0.3, size: int = CHUNK_FRAMES) -> DataFrame:
    """The matrices in force when a match recalibrates: match_id, from_frame, h.

    The first matrix is taken as it is. At each decision (match_id, frame_number, as from
    ``auto_recalibrate``) the matrix measured by then is blended into the one in force, so each
    blend feeds the next. Decisions before any matrix have no effect."""
    measured = calibration_as_of(decisions.select(*FRAME, F.lit(0).alias("det_no")), calibrations.select("match_id", "from_frame", "h"), size=size)
    first = calibrations.filter(F.col("from_frame").isNotNull()).groupBy("match_id").agg(F.min_by(F.struct("from_frame", "h"), "from_frame").alias("c"))
    steps = first.select("match_id", "c.from_frame", "c.h", F.lit(0).alias("kind")).unionByName(
        measured.filter(F.col("h").isNotNull()).select("match_id", F.col("frame_number").alias("from_frame"), "h", F.lit(1).alias("kind"))
    )
    d = blended(steps, ["match_id"], ["from_frame", "kind"], F.col("h"), F.lit(alpha), "blend")
    # of a first matrix and a decision at the same frame the blend counts
    latest = d.groupBy("match_id", "from_frame").agg(F.max_by("blend", "kind").alias("h"))
    return latest.select("match_id", "from_frame", "h")


def _drifted(drift, check_interval, threshold_px, min_hoops):
    return drift.filter(
        (F.col("frame_number") % check_interval == 0)
        & (F.col("hoops") >= min_hoops)
        & (F.col("drift_px") > threshold_px)
    )


def calibration_recommendations(attempts: DataFrame, frames: DataFrame) -> DataFrame:
    """Advice lines per match. ``attempts`` has one row per frame with hoops."""
    total = frames.groupBy("match_id").agg(F.count(F.lit(1)).alias("frames"))
    a = attempts.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("with_hoops"),
        F.count_if("success").alias("ok"),
        F.avg(F.when(F.col("success"), F.col("accuracy"))).alias("accuracy"),
    )
    d = total.join(a, "match_id", "left").fillna(0, ["with_hoops", "ok"])
    lines = F.array_compact(
        F.array(
            F.when(F.col("with_hoops") < F.col("frames") * 0.3, F.lit(CALIBRATION_ADVICE["hoops"])),
            F.when(F.col("ok") < F.col("with_hoops") * 0.5, F.lit(CALIBRATION_ADVICE["success"])),
            F.when(F.col("accuracy") < 0.7, F.lit(CALIBRATION_ADVICE["accuracy"])),
        )
    )
    return d.select("match_id", lines.alias("recommendations"))
