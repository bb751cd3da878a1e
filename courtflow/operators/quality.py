"""Detection quality, tracking quality and validation reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtflow.constants import EDGE_CASES, FAILURE_MODES, FPS, VALIDATION_ADVICE
from courtflow.functions import geometry as G
from courtflow.functions.geometry import safe_div
from courtflow.operators.ordered import CHUNK_FRAMES, last_before, running_sum, with_lookback
from courtflow.operators.quantiles import exact_quantiles

FRAME = ["match_id", "frame_number"]


def _n():
    return F.count(F.lit(1))


def _class(name: str):
    return F.count_if(F.col("class_name") == name)


# -- counts and summaries --------------------------------------------------------


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(_n().alias("n"))


def detections_per_frame_stats(detections: DataFrame) -> DataFrame:
    """Frames with detections and their mean / max / min count."""
    per_frame = detections.groupBy(*FRAME).agg(_n().alias("c"))
    return per_frame.agg(
        _n().alias("frames_with_detections"),
        F.avg("c").alias("avg_detections_per_frame"),
        F.max("c").alias("max_detections_per_frame"),
        F.min("c").alias("min_detections_per_frame"),
    )


def spatial_distribution(detections: DataFrame) -> DataFrame:
    return detections.agg(
        F.min("court_x").alias("x_min"),
        F.max("court_x").alias("x_max"),
        F.min("court_y").alias("y_min"),
        F.max("court_y").alias("y_max"),
        F.avg("court_x").alias("x_center"),
        F.avg("court_y").alias("y_center"),
    )


def frame_statistics(detections: DataFrame, reads: DataFrame | None = None) -> DataFrame:
    """Per-frame counts by class, calibrated counts, and text reads if given."""
    on = F.col("court_x").isNotNull()
    out = detections.groupBy(*FRAME).agg(
        *[_class(c).alias(f"{c}s") for c in ("player", "ball", "hoop")],
        *[F.count_if((F.col("class_name") == c) & on).alias(f"calibrated_{c}s") for c in ("player", "ball", "hoop")],
    )
    if reads is None:
        return out
    r = reads.groupBy(*FRAME).agg(_n().alias("ocr_reads"))
    return out.join(r, FRAME, "left").withColumn("ocr_reads", F.coalesce("ocr_reads", F.lit(0).cast("long")))


def detection_summary(detections: DataFrame, frames: DataFrame, reads: DataFrame) -> DataFrame:
    """Totals and per-frame means by class and of text reads, per match. Frames
    come from the frame table, so frames without detections count."""
    f = frames.groupBy("match_id").agg(_n().alias("frames"))
    d = detections.groupBy("match_id").agg(
        _class("player").alias("players"), _class("ball").alias("balls"), _class("hoop").alias("hoops")
    )
    numeric = F.col("text").rlike("^[0-9]+$")
    r = reads.groupBy("match_id").agg(
        _n().alias("reads"),
        F.count_distinct(F.when(numeric, F.col("text").try_cast("bigint"))).alias("unique_numbers"),
        # at most the seven position codes
        F.sort_array(F.collect_set(F.when(F.col("text").isin("GS", "GA", "WA", "C", "WD", "GD", "GK"), F.col("text")))).alias(
            "unique_positions"
        ),
    )
    out = f.join(d, "match_id", "left").join(r, "match_id", "left")
    zero = F.lit(0).cast("long")
    counts = ["players", "balls", "hoops", "reads", "unique_numbers"]
    out = out.withColumns({c: F.coalesce(F.col(c), zero) for c in counts})
    return out.withColumns({f"{c}_per_frame": safe_div(c, "frames") for c in counts[:4]})


def run_quality(detections: DataFrame, possessions: DataFrame, shots: DataFrame, violations: DataFrame) -> DataFrame:
    """One-row summary of a run with its overall grade."""
    d = detections.agg((F.max("frame_number") + 1).alias("total_frames_analyzed"), _n().alias("total_detections"))
    one = lambda df, name: F.broadcast(df.agg(_n().alias(name)))  # a single row each
    out = (
        d.crossJoin(one(possessions, "total_possession_events"))
        .crossJoin(one(shots, "total_shots"))
        .crossJoin(one(violations, "total_violations"))
    )
    n, p = F.col("total_detections"), F.col("total_possession_events")
    grade = (
        F.when((n > 1000) & (p > 10), "excellent")
        .when((n > 500) & (p > 5), "good")
        .when(n > 100, "fair")
        .otherwise("poor")
    )
    return out.withColumn("analysis_quality", grade)


def ball_confidence_stats(balls: DataFrame) -> DataFrame:
    stats = balls.agg(
        F.min("confidence").alias("min"),
        F.max("confidence").alias("max"),
        F.avg("confidence").alias("mean"),
        F.stddev_samp("confidence").alias("std"),
    )
    q = exact_quantiles(balls, "confidence", [0.25, 0.5, 0.75])
    pick = lambda p: F.max(F.when(F.col("prob") == p, F.col("quantile")))
    q = q.agg(pick(0.25).alias("q25"), pick(0.5).alias("median"), pick(0.75).alias("q75"))
    return stats.crossJoin(F.broadcast(q))


def ball_size_stats(balls: DataFrame) -> DataFrame:
    b = G.box()
    d = balls.select(
        G.width(b).alias("width"), G.height(b).alias("height"), G.area(b).alias("area"), G.aspect_wh(b).alias("aspect_ratio")
    )
    return d.agg(
        *[f(c).alias(f"{c}_{n}") for c in d.columns for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    )


def threshold_shares(balls: DataFrame) -> DataFrame:
    """How many balls pass each proposed filter, and their share in percent."""
    b = G.box()
    c = F.col("confidence")
    w, h, a = G.width(b).between(10, 100), G.height(b).between(10, 100), G.aspect_wh(b).between(0.5, 2.0)
    tests = {
        "high_confidence": c > 0.5,
        "medium_confidence": c > 0.3,
        "low_confidence": c > 0.1,
        "reasonable_width": w,
        "reasonable_height": h,
        "reasonable_aspect": a,
        "combined_filter": (c > 0.3) & w & h & a,
    }
    one = balls.agg(_n().alias("total"), *[F.count_if(t).alias(n) for n, t in tests.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("filter"), F.col(n).alias("n")) for n in tests]))
    return one.select("total", rows.alias("r")).select(
        "r.filter", "r.n", (safe_div("r.n", "total") * F.lit(100.0)).alias("percent")
    )


def detection_stability(players: DataFrame, frames: DataFrame) -> DataFrame:
    """Detection rate, mean count and spread of confidence and box area, per match."""
    b = G.box()
    per_frame = players.groupBy(*FRAME).agg(_n().alias("c")).groupBy("match_id").agg(
        _n().alias("frames_with_detections"), F.avg("c").alias("avg_detections_per_frame")
    )
    spread = players.groupBy("match_id").agg(
        F.avg("confidence").alias("avg_confidence"),
        F.stddev_pop("confidence").alias("confidence_std"),
        F.stddev_pop(G.area(b)).alias("bbox_size_std"),
    )
    total = frames.groupBy("match_id").agg(_n().alias("total_frames"))
    out = total.join(per_frame, "match_id", "left").join(spread, "match_id", "left")
    zero = F.lit(0).cast("long")
    out = out.withColumn("frames_with_detections", F.coalesce("frames_with_detections", zero))
    return out.withColumn("detection_rate", safe_div("frames_with_detections", "total_frames")).fillna(
        0.0, ["avg_detections_per_frame", "avg_confidence", "confidence_std", "bbox_size_std"]
    )


# -- frame-to-frame ----------------------------------------------------------------


def _per_frame_count(players: DataFrame, frames: DataFrame) -> DataFrame:
    n = players.groupBy(*FRAME).agg(_n().alias("n"))
    return frames.select(*FRAME).join(n, FRAME, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def detection_count_flicker(players: DataFrame, frames: DataFrame, size: int = CHUNK_FRAMES) -> DataFrame:
    """Frames (from the third on) whose head count jumps by more than two."""

    def lags(df, w):
        return df.withColumns({"prev_n": F.lag("n").over(w), "third": F.lag("n", 2).over(w).isNotNull()})

    d = with_lookback(_per_frame_count(players, frames), ["match_id"], ["frame_number"], 2, lags, size)
    jump = F.abs(F.col("n") - F.col("prev_n"))
    return d.filter(F.col("third") & (jump > 2)).select(
        *FRAME, "prev_n", "n", F.when(jump > 3, "high").otherwise("medium").alias("severity")
    )


def id_switches(players: DataFrame, frames: DataFrame, size: int = CHUNK_FRAMES) -> DataFrame:
    """New and gone track ids of each frame against the frame before; frames after
    one without players are skipped."""
    ids = players.groupBy(*FRAME).agg(F.collect_set("track_id").alias("ids"))
    none = F.array().cast("array<bigint>")
    d = frames.select(*FRAME).join(ids, FRAME, "left").withColumn("ids", F.coalesce("ids", none))
    d = last_before(d, ["match_id"], ["frame_number"], {"prev": F.struct("ids")}, size)
    d = d.filter(F.size("prev.ids") > 0)
    return d.select(
        *FRAME,
        F.size(F.array_except("ids", "prev.ids")).cast("long").alias("new_ids"),
        F.size(F.array_except("prev.ids", "ids")).cast("long").alias("gone_ids"),
    )


def evaluation_metrics(
    detections: DataFrame, frames: DataFrame, processing_seconds: float, fps: float = FPS, size: int = CHUNK_FRAMES
) -> DataFrame:
    """Tracking metrics of a match and whether they pass. No table says which hoop
    boxes are wrong, so hoop precision is that of the detections given."""
    players = detections.filter(F.col("class_name") == "player")
    sw = id_switches(players, frames, size).groupBy("match_id").agg(F.sum(F.col("new_ids") + F.col("gone_ids")).alias("id_switches"))
    balls = detections.groupBy(*FRAME).agg(_class("ball").alias("b"), _class("hoop").alias("h"))
    per = (
        frames.select(*FRAME)
        .join(balls, FRAME, "left")
        .groupBy("match_id")
        .agg(
            _n().alias("frames"),
            F.coalesce(F.sum("b"), F.lit(0)).alias("ball_detections"),
            F.count_if(F.coalesce("b", F.lit(0)) == 0).alias("ball_misses"),
            F.coalesce(F.sum("h"), F.lit(0)).alias("hoop_detections"),
        )
    )
    d = per.join(sw, "match_id", "left").withColumn("id_switches", F.coalesce("id_switches", F.lit(0).cast("long")))
    d = d.withColumns(
        {
            "id_switches_per_minute": F.col("id_switches") / (F.col("frames") / F.lit(fps) / F.lit(60.0)),
            "ball_recall": safe_div("ball_detections", F.col("ball_detections") + F.col("ball_misses")),
            "hoop_precision": F.when(F.col("hoop_detections") > 0, 1.0).otherwise(0.0),
            "processing_fps": F.col("frames") / F.lit(processing_seconds),
            "real_time_factor": F.col("frames") / F.lit(fps) / F.lit(processing_seconds),
        }
    )
    ok = (F.col("id_switches_per_minute") <= 3) & (F.col("ball_recall") >= 0.85) & (F.col("hoop_precision") >= 0.95)
    return d.withColumn("passed", ok)


def smooth_bbox_mean3(
    detections: DataFrame, frames: DataFrame, threshold: float = 0.3, size: int = CHUNK_FRAMES
) -> DataFrame:
    """Boxes averaged with the overlapping boxes of their class over three frames.

    A frame's boxes become one row, which looks back two rows of ``frames``; so a box is
    shuffled twice, and no pair of boxes is. Boxes without det_no stay as they are."""
    names = ["class_name", "det_no", *G.BOX, "confidence"]
    d = detections.select(*FRAME, F.struct(*names).alias("b"), F.lit(False).alias("listed"))
    d = d.unionByName(frames.select(*FRAME, F.lit(True).alias("listed")), allowMissingColumns=True)
    d = d.filter(F.col("match_id").isNotNull() & F.col("frame_number").isNotNull()).groupBy(*FRAME)
    d = d.agg(F.sort_array(F.collect_list("b")).alias("b0"), F.bool_or("listed").alias("listed")).filter("listed").drop("listed")

    def averaged(df, w):
        seen = df.withColumns({"b1": F.lag("b0").over(w), "b2": F.lag("b0", 2).over(w)})
        full = F.when(F.col("b2").isNotNull(), F.concat("b0", "b1", "b2"))  # else too few frames before
        each = seen.withColumn("full", full).drop("b1", "b2").select("*", F.posexplode("b0").alias("place", "b")).drop("b0")
        pair = each.select("*", F.explode_outer("full").alias("h")).drop("full")
        box = lambda v: tuple(F.col(f"{v}.{c}") for c in G.BOX)
        near = (F.col("b.class_name") == F.col("h.class_name")) & F.col("b.det_no").isNotNull() & (G.iou(box("b"), box("h")) > threshold)
        pair = pair.withColumns({"near": near, "class_name": F.col("b.class_name"), "det_no": F.col("b.det_no")})
        # grouped by all that the rows are dealt by, so they stay where they are
        keys = [c for c in df.columns if c != "b0"]
        mean = lambda c: F.coalesce(F.avg(F.when(F.col("near"), F.col(f"h.{c}"))), F.first(f"b.{c}")).alias(c)
        return pair.groupBy(*keys, "place", "class_name", "det_no").agg(*[mean(c) for c in [*G.BOX, "confidence"]])

    d = with_lookback(d, ["match_id"], ["frame_number"], 2, averaged, size)
    return d.select(*FRAME, *names)


# -- thresholds --------------------------------------------------------------------


def threshold_grid(df: DataFrame, thresholds: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Per group and threshold: count and mean confidence of the rows at or above
    it. One pass of conditional aggregates; rows are not multiplied."""
    by = list(by)
    aggs = []
    for i, t in enumerate(thresholds):
        on = F.col("confidence") >= t
        aggs += [F.count_if(on).alias(f"n{i}"), F.avg(F.when(on, F.col("confidence"))).alias(f"m{i}")]
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean_confidence"))
                for i, t in enumerate(thresholds)
            ]
        )
    )
    return df.groupBy(*by).agg(*aggs).select(*by, rows.alias("r")).select(*by, "r.*")


def threshold_sweep(df: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ("class_name",)) -> DataFrame:
    """Best threshold per class: mean confidence x min(1, n / 10); the first wins
    ties, and the first stands when no score is positive."""
    grid = threshold_grid(df, thresholds, by)
    score = F.coalesce("mean_confidence", F.lit(0.0)) * F.least(F.lit(1.0), F.col("n") / F.lit(10.0))
    best = F.max_by(F.struct("threshold", "score"), F.struct("score", -F.col("threshold")))
    out = grid.withColumn("score", score).groupBy(*by).agg(best.alias("b"))
    return out.select(*by, F.col("b.threshold").alias("best_threshold"), F.col("b.score").alias("best_score"))


def best_model_threshold(detections: DataFrame, frames: DataFrame, model: str, thresholds: Sequence[float]) -> DataFrame:
    """Model and threshold with most detections per frame of the frame table."""
    total = F.broadcast(frames.agg(_n().alias("frames")))  # one row
    grid = threshold_grid(detections, thresholds, [model]).crossJoin(total)
    grid = grid.withColumn("score", safe_div("n", "frames"))
    best = F.max_by(F.struct(model, "threshold", "score"), F.struct("score", -F.col("threshold")))
    return grid.agg(best.alias("b")).select("b.*")


# -- validation ----------------------------------------------------------------------


def validate_against_truth(
    predictions: DataFrame, truth: DataFrame, align: str = "position", size: int = CHUNK_FRAMES
) -> DataFrame:
    """Predictions (match_id, frame_number, pred_player) beside truth (match_id,
    frame_number, true_player). 'position' pairs the i-th of both lists, leaving
    later rows of the longer one unpaired; 'frame' pairs equal frames."""
    if align == "frame":
        t = truth.select(*FRAME, "true_player", F.lit(True).alias("paired"))
        return predictions.join(t, FRAME, "left").withColumn("paired", F.coalesce("paired", F.lit(False)))
    one = {"position": F.lit(1).cast("long")}
    p = running_sum(predictions, ["match_id"], ["frame_number"], one, size)
    t = running_sum(truth.select(*FRAME, "true_player"), ["match_id"], ["frame_number"], one, size)
    t = t.select("match_id", "position", "true_player", F.lit(True).alias("paired"))
    return p.join(t, ["match_id", "position"], "left").withColumn("paired", F.coalesce("paired", F.lit(False)))


def confusion_metrics(paired: DataFrame, mode: str = "reference") -> DataFrame:
    """tp / fp / fn / tn and rates per match. A wrong player counts as a true
    negative in 'reference' mode and as a false positive in 'strict' mode."""
    t, p, on = F.col("true_player"), F.col("pred_player"), F.col("paired")
    hit = F.coalesce(t == p, F.lit(False))
    wrong = t.isNotNull() & p.isNotNull() & ~hit
    fp = t.isNull() & p.isNotNull()
    tn = (t.isNull() & p.isNull()) | wrong
    if mode == "strict":
        fp, tn = fp | wrong, t.isNull() & p.isNull()
    d = paired.groupBy("match_id").agg(
        _n().alias("total_frames"),
        F.count_if(on & hit).alias("tp"),
        F.count_if(on & fp).alias("fp"),
        F.count_if(on & t.isNotNull() & p.isNull()).alias("fn"),
        F.count_if(on & tn).alias("tn"),
    )
    return _rates(d)


def _rates(d: DataFrame) -> DataFrame:
    d = d.withColumns(
        {
            "precision": safe_div("tp", F.col("tp") + F.col("fp")),
            "recall": safe_div("tp", F.col("tp") + F.col("fn")),
            "accuracy": safe_div(F.col("tp") + F.col("tn"), "total_frames"),
        }
    )
    return d.withColumn(
        "f1_score",
        safe_div(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
    )


def edge_cases(assigned: DataFrame) -> DataFrame:
    """Distinct edge-case labels seen in a match's possession frames."""
    ball = F.col("ball_count") > 0
    label = F.explode(
        F.array_compact(
            F.array(
                F.when((F.col("player_count") > 1) & ball, F.lit(EDGE_CASES["crowd"])),
                F.when(ball & F.col("player_no").isNull(), F.lit(EDGE_CASES["air"])),
                F.when(F.col("confidence") < 0.3, F.lit(EDGE_CASES["unsure"])),
            )
        )
    )
    return assigned.select("match_id", label.alias("label")).distinct()


def failure_modes(assigned: DataFrame) -> DataFrame:
    d = assigned.groupBy("match_id").agg(
        F.avg(F.when(F.col("ball_count") == 0, 1.0).otherwise(0.0)).alias("no_ball"),
        F.avg(F.when(F.col("player_no").isNull(), 1.0).otherwise(0.0)).alias("no_possession"),
    )
    label = F.explode(
        F.array_compact(
            F.array(
                F.when(F.col("no_ball") > 0.3, F.lit(FAILURE_MODES["ball"])),
                F.when(F.col("no_possession") > 0.5, F.lit(FAILURE_MODES["possession"])),
            )
        )
    )
    return d.select("match_id", label.alias("label"))


def validation_recommendations(metrics: DataFrame) -> DataFrame:
    """Advice lines per row from precision, recall, F1, the edge cases found and the frame time."""
    found = lambda case: F.array_contains("edge_cases_found", EDGE_CASES[case])
    lines = F.array_compact(
        F.array(
            F.when(F.col("precision") < 0.85, F.lit(VALIDATION_ADVICE["precision"])),
            F.when(F.col("recall") < 0.80, F.lit(VALIDATION_ADVICE["recall"])),
            F.when(F.col("f1_score") < 0.82, F.lit(VALIDATION_ADVICE["f1_score"])),
            *[F.when(found(case), F.lit(VALIDATION_ADVICE[case])) for case in EDGE_CASES],
            F.when(F.col("processing_time_per_frame") > 0.1, F.lit(VALIDATION_ADVICE["speed"])),
        )
    )
    return metrics.withColumn("recommendations", lines)


def aggregate_validation(reports: DataFrame) -> DataFrame:
    """All reports rolled into overall rates and an assessment (one row).
    ``reports``: total_frames, tp, fp, fn, tn, processing_time_per_frame."""
    d = reports.agg(
        _n().alias("total_tests"),
        *[F.sum(c).alias(c) for c in ("total_frames", "tp", "fp", "fn", "tn")],
        F.avg("processing_time_per_frame").alias("average_processing_time"),
    )
    d = _rates(d).withColumns(
        {"fp_rate": safe_div("fp", "total_frames"), "fn_rate": safe_div("fn", "total_frames")}
    )
    a, p, r = F.col("accuracy"), F.col("precision"), F.col("recall")
    grade = (
        F.when((a >= 0.85) & (p >= 0.80) & (r >= 0.80), "EXCELLENT")
        .when((a >= 0.75) & (p >= 0.70) & (r >= 0.70), "GOOD")
        .when((a >= 0.65) & (p >= 0.60) & (r >= 0.60), "FAIR")
        .otherwise("POOR")
    )
    return d.withColumns(
        {"fp_rate_met": F.col("fp_rate") < 0.15, "fn_rate_met": F.col("fn_rate") < 0.20, "assessment": grade}
    )


def label_counts(reports: DataFrame, column: str, top: int = 5) -> DataFrame:
    """The ``top`` most frequent labels of an array column; ties by label."""
    labels = reports.select(F.explode(column).alias("label")).filter(F.col("label") != "")
    return labels.groupBy("label").agg(_n().alias("n")).orderBy(F.desc("n"), "label").limit(top)


def annotation_stats(truth: DataFrame) -> DataFrame:
    held = F.count_if(F.col("true_player").isNotNull())
    return truth.agg(
        _n().alias("total_annotations"),
        held.alias("possession_frames"),
        (_n() - held).alias("no_possession_frames"),
        (held / _n()).alias("possession_rate"),
        F.avg("true_confidence").alias("average_confidence"),
    )


def most_active_players(truth: DataFrame, top: int = 5) -> DataFrame:
    """The players of each match with most annotated frames."""
    d = truth.filter(F.col("true_player").isNotNull()).groupBy("match_id", "true_player").agg(_n().alias("n"))
    rank = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("n"), "true_player"))
    return d.withColumn("__rank", rank).filter(F.col("__rank") <= top).drop("__rank")


def validation_summary_table(reports: DataFrame) -> DataFrame:
    """Flat report table: rates and the sizes of the label arrays."""
    size = lambda c: F.size(F.filter(c, lambda x: x != "")).cast("long")
    return _rates(reports).select(
        "video_name",
        "segment_start",
        "segment_end",
        "total_frames",
        "accuracy",
        "precision",
        "recall",
        "f1_score",
        "processing_time_per_frame",
        size("edge_cases_found").alias("edge_cases_count"),
        size("failure_modes").alias("failure_modes_count"),
        size("recommendations").alias("recommendations_count"),
    )
