"""Detection quality, tracking quality and validation queries."""

from pyspark.sql import functions as F

from courtflow.operators import possession as P
from courtflow.operators import quality as Q
from courtflow.operators import zones as Z
from courtflow.operators.quantiles import describe
from courtflow.plans.possession import ASSIGNED, LABELS, assigned, smoothed_labels
from courtflow.plans.registry import query, shown
from courtflow.plans.zones import BASE_V, ZONED

DESCRIBE = """COUNT({v}) AS count, ROUND(AVG({v}), 8) AS mean, ROUND(STDDEV_SAMP({v}), 8) AS std, MIN({v}) AS min, MAX({v}) AS max,
 ROUND(QUANTILE_CONT({v}, 0.25), 8) AS q25, ROUND(QUANTILE_CONT({v}, 0.5), 8) AS q50, ROUND(QUANTILE_CONT({v}, 0.75), 8) AS q75"""
DCOLS = ["mean", "std", "q25", "q50", "q75"]


@query("describe_confidence", "SELECT class_name, " + DESCRIBE.format(v="confidence") + " FROM @detections GROUP BY 1")
def _d1(t):
    return shown(describe(t.detections, "confidence", ["class_name"]), *DCOLS, places=8)


@query("describe_shot_distance", "SELECT " + DESCRIBE.format(v="distance_to_goal") + " FROM @shots")
def _d2(t):
    return shown(describe(t.shots, "distance_to_goal"), *DCOLS, places=8)


@query("describe_shot_angle", "SELECT " + DESCRIBE.format(v="angle_to_goal") + " FROM @shots")
def _d3(t):
    return shown(describe(t.shots, "angle_to_goal"), *DCOLS, places=8)


@query(
    "describe_possession_duration",
    LABELS
    + ", dur AS (SELECT end_frame - start_frame AS duration_frames FROM pc) SELECT "
    + DESCRIBE.format(v="duration_frames").replace("MIN(duration_frames)", "CAST(MIN(duration_frames) AS BIGINT)")
    + " FROM dur",
)
def _d4(t):
    return shown(describe(P.possession_changes(smoothed_labels(t)), "duration_frames"), *DCOLS, places=8)


@query("detections_by_class", "SELECT class_name, COUNT(*) AS n FROM @detections GROUP BY 1")
def _by_class(t):
    return Q.value_counts(t.detections, "class_name")


@query(
    "detections_per_frame_stats",
    """SELECT COUNT(*) AS frames_with_detections, ROUND(AVG(c), 8) AS avg_detections_per_frame, MAX(c) AS max_detections_per_frame,
 MIN(c) AS min_detections_per_frame FROM (SELECT COUNT(*) AS c FROM @detections GROUP BY match_id, frame_number)""",
)
def _per_frame(t):
    return shown(Q.detections_per_frame_stats(t.detections), "avg_detections_per_frame", places=8)


@query(
    "spatial_distribution",
    """SELECT MIN(court_x) AS x_min, MAX(court_x) AS x_max, MIN(court_y) AS y_min, MAX(court_y) AS y_max,
 ROUND(AVG(court_x), 8) AS x_center, ROUND(AVG(court_y), 8) AS y_center FROM @detections""",
)
def _spatial(t):
    return shown(Q.spatial_distribution(t.detections), "x_center", "y_center", places=8)


@query(
    "frame_statistics",
    """WITH c AS (SELECT match_id, frame_number, COUNT(*) FILTER (WHERE class_name='player') AS players, COUNT(*) FILTER (WHERE class_name='ball') AS balls,
 COUNT(*) FILTER (WHERE class_name='hoop') AS hoops FROM @detections GROUP BY 1,2),
r AS (SELECT match_id, frame_number, COUNT(*) AS n FROM @ocr_reads GROUP BY 1,2)
SELECT match_id, frame_number, players, balls, hoops, players AS calibrated_players, balls AS calibrated_balls, hoops AS calibrated_hoops,
 coalesce(n, 0) AS ocr_reads FROM c LEFT JOIN r USING (match_id, frame_number)""",
)
def _frame_stats(t):
    return Q.frame_statistics(t.detections, t.ocr_reads)


@query(
    "detection_summary",
    """WITH f AS (SELECT match_id, COUNT(*) AS frames FROM @frames GROUP BY 1),
d AS (SELECT match_id, COUNT(*) FILTER (WHERE class_name='player') AS players, COUNT(*) FILTER (WHERE class_name='ball') AS balls,
 COUNT(*) FILTER (WHERE class_name='hoop') AS hoops FROM @detections GROUP BY 1),
r AS (SELECT match_id, COUNT(*) AS reads, COUNT(DISTINCT TRY_CAST(CASE WHEN regexp_full_match(text, '[0-9]+') THEN text END AS BIGINT)) AS unique_numbers,
 array_to_string(list_sort(list_distinct(list(text) FILTER (WHERE text IN ('GS','GA','WA','C','WD','GD','GK')))), ',') AS unique_positions FROM @ocr_reads GROUP BY 1)
SELECT match_id, frames, players, balls, hoops, reads, unique_numbers, unique_positions, ROUND(players/CAST(frames AS DOUBLE),6) AS players_per_frame,
 ROUND(balls/CAST(frames AS DOUBLE),6) AS balls_per_frame, ROUND(hoops/CAST(frames AS DOUBLE),6) AS hoops_per_frame,
 ROUND(reads/CAST(frames AS DOUBLE),6) AS reads_per_frame FROM f JOIN d USING (match_id) JOIN r USING (match_id)""",
)
def _summary(t):
    df = Q.detection_summary(t.detections, t.frames, t.ocr_reads)
    df = df.withColumn("unique_positions", F.array_join("unique_positions", ","))
    return shown(df, "players_per_frame", "balls_per_frame", "hoops_per_frame", "reads_per_frame")


@query(
    "run_quality",
    LABELS
    + ", "
    + ZONED.replace("WITH ", "")
    + ","
    + BASE_V
    + """ SELECT (SELECT MAX(frame_number)+1 FROM @detections) AS total_frames_analyzed, (SELECT COUNT(*) FROM @detections) AS total_detections,
 (SELECT COUNT(*) FROM pc) AS total_possession_events, (SELECT COUNT(*) FROM @shots) AS total_shots, (SELECT COUNT(*) FROM bv) AS total_violations,
 CASE WHEN (SELECT COUNT(*) FROM @detections) > 1000 AND (SELECT COUNT(*) FROM pc) > 10 THEN 'excellent'
  WHEN (SELECT COUNT(*) FROM @detections) > 500 AND (SELECT COUNT(*) FROM pc) > 5 THEN 'good'
  WHEN (SELECT COUNT(*) FROM @detections) > 100 THEN 'fair' ELSE 'poor' END AS analysis_quality""",
)
def _run_quality(t):
    return Q.run_quality(t.detections, P.possession_changes(smoothed_labels(t)), t.shots, Z.zone_violations(t.players))


@query(
    "ball_confidence_stats",
    """SELECT MIN(confidence) AS min, MAX(confidence) AS max, ROUND(AVG(confidence),8) AS mean, ROUND(STDDEV_SAMP(confidence),8) AS std,
 ROUND(QUANTILE_CONT(confidence,0.25),8) AS q25, ROUND(QUANTILE_CONT(confidence,0.5),8) AS median, ROUND(QUANTILE_CONT(confidence,0.75),8) AS q75
FROM @detections WHERE class_name='ball'""",
)
def _ball_conf(t):
    return shown(Q.ball_confidence_stats(t.balls), "mean", "std", "q25", "median", "q75", places=8)


SZ = "MIN({e}) AS {n}_min, MAX({e}) AS {n}_max, ROUND(AVG({e}),8) AS {n}_mean"


@query(
    "ball_size_stats",
    "SELECT "
    + ", ".join(
        SZ.format(e=e, n=n)
        for e, n in (("x2-x1", "width"), ("y2-y1", "height"), ("(x2-x1)*(y2-y1)", "area"), ("(x2-x1)/(y2-y1)", "aspect_ratio"))
    )
    + " FROM @detections WHERE class_name='ball'",
)
def _ball_size(t):
    return shown(Q.ball_size_stats(t.balls), "width_mean", "height_mean", "area_mean", "aspect_ratio_mean", places=8)


@query(
    "threshold_shares",
    """WITH b AS (SELECT confidence AS c, x2-x1 AS w, y2-y1 AS h FROM @detections WHERE class_name='ball'),
a AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE c > 0.5e0) AS n1, COUNT(*) FILTER (WHERE c > 0.3e0) AS n2, COUNT(*) FILTER (WHERE c > 0.1e0) AS n3,
 COUNT(*) FILTER (WHERE w BETWEEN 10 AND 100) AS n4, COUNT(*) FILTER (WHERE h BETWEEN 10 AND 100) AS n5, COUNT(*) FILTER (WHERE w/h BETWEEN 0.5e0 AND 2) AS n6,
 COUNT(*) FILTER (WHERE c > 0.3e0 AND w BETWEEN 10 AND 100 AND h BETWEEN 10 AND 100 AND w/h BETWEEN 0.5e0 AND 2) AS n7 FROM b),
u AS (SELECT total, unnest(['high_confidence','medium_confidence','low_confidence','reasonable_width','reasonable_height','reasonable_aspect','combined_filter']) AS filter,
 unnest([n1,n2,n3,n4,n5,n6,n7]) AS n FROM a)
SELECT filter, n, ROUND(n/CAST(total AS DOUBLE)*100e0, 6) AS percent FROM u""",
)
def _shares(t):
    return shown(Q.threshold_shares(t.balls), "percent")


@query(
    "detection_stability",
    """WITH p AS (SELECT * FROM @detections WHERE class_name='player'), f AS (SELECT match_id, COUNT(*) AS total_frames FROM @frames GROUP BY 1),
c AS (SELECT match_id, COUNT(*) AS fw, AVG(c) AS ac FROM (SELECT match_id, frame_number, COUNT(*) AS c FROM p GROUP BY 1,2) GROUP BY 1),
s AS (SELECT match_id, AVG(confidence) AS m, STDDEV_POP(confidence) AS sd, STDDEV_POP((x2-x1)*(y2-y1)) AS bs FROM p GROUP BY 1)
SELECT match_id, total_frames, fw AS frames_with_detections, ROUND(ac,8) AS avg_detections_per_frame, ROUND(m,8) AS avg_confidence,
 ROUND(sd,8) AS confidence_std, ROUND(bs,4) AS bbox_size_std, ROUND(fw/CAST(total_frames AS DOUBLE),8) AS detection_rate
FROM f JOIN c USING (match_id) JOIN s USING (match_id)""",
)
def _stability(t):
    df = Q.detection_stability(t.players, t.frames)
    df = shown(df, "avg_detections_per_frame", "avg_confidence", "confidence_std", "detection_rate", places=8)
    return shown(df, "bbox_size_std", places=4)


COUNTS = """WITH n AS (SELECT f.match_id, f.frame_number, COUNT(d.det_no) AS n, list_distinct(list(d.track_id) FILTER (WHERE d.det_no IS NOT NULL)) AS ids
 FROM @frames f LEFT JOIN @detections d ON d.match_id=f.match_id AND d.frame_number=f.frame_number AND d.class_name='player' GROUP BY 1,2)"""


@query(
    "detection_count_flicker",
    COUNTS
    + """, l AS (SELECT *, LAG(n) OVER w AS prev_n, LAG(n,2) OVER w AS p2 FROM n WINDOW w AS (PARTITION BY match_id ORDER BY frame_number))
SELECT match_id, frame_number, prev_n, n, CASE WHEN abs(n-prev_n) > 3 THEN 'high' ELSE 'medium' END AS severity FROM l WHERE p2 IS NOT NULL AND abs(n-prev_n) > 2""",
)
def _flicker(t):
    return Q.detection_count_flicker(t.players, t.frames)


SWITCHES = (
    COUNTS
    + """, s AS (SELECT match_id, frame_number, coalesce(ids, []) AS ids, coalesce(LAG(ids) OVER (PARTITION BY match_id ORDER BY frame_number), []) AS prev FROM n),
sw AS (SELECT match_id, frame_number, CAST(len(list_filter(ids, lambda x: NOT list_contains(prev, x))) AS BIGINT) AS new_ids,
 CAST(len(list_filter(prev, lambda x: NOT list_contains(ids, x))) AS BIGINT) AS gone_ids FROM s WHERE len(prev) > 0)"""
)


@query("id_switches", SWITCHES + " SELECT * FROM sw")
def _switches(t):
    return Q.id_switches(t.players, t.frames)


@query(
    "evaluation_metrics",
    SWITCHES
    + """, b AS (SELECT f.match_id, f.frame_number, COUNT(*) FILTER (WHERE class_name='ball') AS b, COUNT(*) FILTER (WHERE class_name='hoop') AS h
 FROM @frames f LEFT JOIN @detections d ON d.match_id=f.match_id AND d.frame_number=f.frame_number GROUP BY 1,2),
p AS (SELECT match_id, COUNT(*) AS frames, CAST(SUM(b) AS BIGINT) AS bd, COUNT(*) FILTER (WHERE b=0) AS bm, CAST(SUM(h) AS BIGINT) AS hd FROM b GROUP BY 1),
q AS (SELECT match_id, CAST(SUM(new_ids+gone_ids) AS BIGINT) AS sw FROM sw GROUP BY 1),
m AS (SELECT *, sw/(frames/30e0/60e0) AS spm, bd/CAST(bd+bm AS DOUBLE) AS br FROM p JOIN q USING (match_id))
SELECT match_id, frames, bd AS ball_detections, bm AS ball_misses, hd AS hoop_detections, sw AS id_switches, ROUND(spm,6) AS id_switches_per_minute,
 ROUND(br,6) AS ball_recall, CASE WHEN hd > 0 THEN 1e0 ELSE 0e0 END AS hoop_precision, ROUND(frames/60e0,6) AS processing_fps,
 ROUND(frames/30e0/60e0,6) AS real_time_factor, spm <= 3 AND br >= 0.85e0 AND hd > 0 AS passed FROM m""",
)
def _evaluation(t):
    df = Q.evaluation_metrics(t.detections, t.frames, processing_seconds=60.0)
    return shown(df, "id_switches_per_minute", "ball_recall", "processing_fps", "real_time_factor")


@query(
    "smooth_bbox_mean3",
    """WITH o AS (SELECT match_id, frame_number, LAG(frame_number) OVER w AS p1, LAG(frame_number,2) OVER w AS p2 FROM @frames
 WINDOW w AS (PARTITION BY match_id ORDER BY frame_number)),
d AS (SELECT d.*, p1, p2 FROM @detections d JOIN o USING (match_id, frame_number)),
j AS (SELECT b.match_id, b.frame_number, b.det_no, p.x1, p.y1, p.x2, p.y2, p.confidence FROM d b JOIN @detections p
 ON p.match_id=b.match_id AND p.class_name=b.class_name AND p.frame_number IN (b.frame_number, b.p1, b.p2)
 WHERE b.p2 IS NOT NULL AND (CASE WHEN least(b.x2,p.x2) > greatest(b.x1,p.x1) AND least(b.y2,p.y2) > greatest(b.y1,p.y1) THEN
 (least(b.x2,p.x2)-greatest(b.x1,p.x1))*(least(b.y2,p.y2)-greatest(b.y1,p.y1)) /
 ((b.x2-b.x1)*(b.y2-b.y1)+(p.x2-p.x1)*(p.y2-p.y1)-(least(b.x2,p.x2)-greatest(b.x1,p.x1))*(least(b.y2,p.y2)-greatest(b.y1,p.y1))) ELSE 0e0 END) > 0.3e0),
m AS (SELECT match_id, frame_number, det_no, AVG(x1) AS x1, AVG(y1) AS y1, AVG(x2) AS x2, AVG(y2) AS y2, AVG(confidence) AS c FROM j GROUP BY 1,2,3)
SELECT d.match_id, d.frame_number, d.class_name, d.det_no, ROUND(coalesce(m.x1,d.x1),4) AS x1, ROUND(coalesce(m.y1,d.y1),4) AS y1,
 ROUND(coalesce(m.x2,d.x2),4) AS x2, ROUND(coalesce(m.y2,d.y2),4) AS y2, ROUND(coalesce(m.c,d.confidence),8) AS confidence
FROM d LEFT JOIN m ON m.match_id=d.match_id AND m.frame_number=d.frame_number AND m.det_no=d.det_no""",
)
def _mean3(t):
    df = Q.smooth_bbox_mean3(t.detections, t.frames)
    return shown(shown(df, "x1", "y1", "x2", "y2", places=4), "confidence", places=8)


THRESHOLDS = [0.1, 0.2, 0.3, 0.5, 0.7, 0.9]
GRID = """WITH th AS (SELECT unnest([0.1e0,0.2e0,0.3e0,0.5e0,0.7e0,0.9e0]) AS threshold),
g AS (SELECT c.class_name, threshold, COUNT(*) FILTER (WHERE confidence >= threshold) AS n, AVG(CASE WHEN confidence >= threshold THEN confidence END) AS mc
 FROM @detections c CROSS JOIN th GROUP BY 1,2)"""


@query("threshold_grid", GRID + " SELECT class_name, threshold, n, ROUND(mc, 8) AS mean_confidence FROM g")
def _grid(t):
    return shown(Q.threshold_grid(t.detections, THRESHOLDS, ["class_name"]), "mean_confidence", places=8)


@query(
    "threshold_sweep",
    GRID
    + """, s AS (SELECT *, coalesce(mc,0e0)*least(1e0,n/10e0) AS score FROM g),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY class_name ORDER BY score DESC, threshold) AS rn FROM s)
SELECT class_name, threshold AS best_threshold, ROUND(score,8) AS best_score FROM r WHERE rn = 1""",
)
def _sweep(t):
    return shown(Q.threshold_sweep(t.detections, THRESHOLDS), "best_score", places=8)


@query(
    "best_model_threshold",
    GRID
    + """ SELECT class_name, threshold, ROUND(n/CAST((SELECT COUNT(*) FROM @frames) AS DOUBLE),6) AS score FROM g ORDER BY score DESC, threshold LIMIT 1""",
)
def _best_model(t):
    return shown(Q.best_model_threshold(t.detections, t.frames, "class_name", THRESHOLDS), "score")


PAIRED = LABELS + """, pr AS (SELECT match_id, frame_number, smoothed AS pred, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY frame_number) AS i FROM s4),
tr AS (SELECT match_id, true_player, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY frame_number) AS i FROM @truth),
pt AS (SELECT pr.match_id, pr.frame_number, pr.i, pred, true_player, tr.i IS NOT NULL AS paired FROM pr LEFT JOIN tr ON tr.match_id=pr.match_id AND tr.i=pr.i)"""
CONF = """, c AS (SELECT match_id, COUNT(*) AS total_frames, COUNT(*) FILTER (WHERE paired AND true_player = pred) AS tp,
 COUNT(*) FILTER (WHERE paired AND {fp}) AS fp, COUNT(*) FILTER (WHERE paired AND true_player IS NOT NULL AND pred IS NULL) AS fn,
 COUNT(*) FILTER (WHERE paired AND {tn}) AS tn FROM pt GROUP BY 1),
r AS (SELECT *, CASE WHEN tp+fp=0 THEN 0e0 ELSE tp/CAST(tp+fp AS DOUBLE) END AS p, CASE WHEN tp+fn=0 THEN 0e0 ELSE tp/CAST(tp+fn AS DOUBLE) END AS rc FROM c)
SELECT match_id, total_frames, tp, fp, fn, tn, ROUND(p,6) AS precision, ROUND(rc,6) AS recall, ROUND((tp+tn)/CAST(total_frames AS DOUBLE),6) AS accuracy,
 ROUND(CASE WHEN p+rc=0 THEN 0e0 ELSE 2e0*p*rc/(p+rc) END,6) AS f1_score FROM r"""
RATES = ["precision", "recall", "accuracy", "f1_score"]
WRONG = "(true_player IS NOT NULL AND pred IS NOT NULL AND true_player <> pred)"


def predictions(t):
    return smoothed_labels(t).select("match_id", "frame_number", F.col("smoothed").alias("pred_player"))


@query(
    "validate_against_truth",
    PAIRED + " SELECT match_id, frame_number, i AS position, pred AS pred_player, true_player, paired FROM pt",
)
def _validate(t):
    return Q.validate_against_truth(predictions(t), t.truth)


@query(
    "confusion_metrics",
    PAIRED + CONF.format(fp="true_player IS NULL AND pred IS NOT NULL", tn=f"((true_player IS NULL AND pred IS NULL) OR {WRONG})"),
)
def _confusion(t):
    return shown(Q.confusion_metrics(Q.validate_against_truth(predictions(t), t.truth)), *RATES)


@query(
    "confusion_metrics_by_frame",
    LABELS
    + """, pt AS (SELECT s.match_id, s.smoothed AS pred, true_player, tr.match_id IS NOT NULL AS paired FROM s4 s LEFT JOIN @truth tr
 ON tr.match_id=s.match_id AND tr.frame_number=s.frame_number)"""
    + CONF.format(fp=f"((true_player IS NULL AND pred IS NOT NULL) OR {WRONG})", tn="(true_player IS NULL AND pred IS NULL)"),
)
def _confusion_strict(t):
    paired = Q.validate_against_truth(predictions(t), t.truth, align="frame")
    return shown(Q.confusion_metrics(paired, mode="strict"), *RATES)


@query(
    "edge_cases",
    ASSIGNED
    + """ SELECT DISTINCT match_id, 'Multiple players near ball' AS label FROM asg WHERE player_count > 1 AND ball_count > 0
 UNION SELECT match_id, 'Ball in air - no clear possession' FROM asg WHERE ball_count > 0 AND player_no IS NULL
 UNION SELECT match_id, 'Low confidence possession assignment' FROM asg WHERE confidence < 0.3e0""",
)
def _edge(t):
    return Q.edge_cases(assigned(t))


@query(
    "failure_modes",
    ASSIGNED
    + """, a AS (SELECT match_id, AVG(CASE WHEN ball_count = 0 THEN 1e0 ELSE 0e0 END) AS nb, AVG(CASE WHEN player_no IS NULL THEN 1e0 ELSE 0e0 END) AS np FROM asg GROUP BY 1)
SELECT match_id, 'Frequent ball detection failures' AS label FROM a WHERE nb > 0.3e0
 UNION ALL SELECT match_id, 'High rate of missed possession assignments' FROM a WHERE np > 0.5e0""",
)
def _failure(t):
    return Q.failure_modes(assigned(t))


RR = """WITH r AS (SELECT *, CASE WHEN tp+fp=0 THEN 0e0 ELSE tp/CAST(tp+fp AS DOUBLE) END AS p, CASE WHEN tp+fn=0 THEN 0e0 ELSE tp/CAST(tp+fn AS DOUBLE) END AS rc,
 CASE WHEN total_frames=0 THEN 0e0 ELSE (tp+tn)/CAST(total_frames AS DOUBLE) END AS ac FROM {src}),
q AS (SELECT *, CASE WHEN p+rc=0 THEN 0e0 ELSE 2e0*p*rc/(p+rc) END AS f1 FROM r)"""


@query(
    "validation_recommendations",
    RR.format(src="@report_rows")
    + """ SELECT video_name, concat_ws(' | ', CASE WHEN p < 0.85e0 THEN 'Improve precision by tuning confidence thresholds' END,
 CASE WHEN rc < 0.8e0 THEN 'Improve recall by relaxing distance/overlap thresholds' END, CASE WHEN f1 < 0.82e0 THEN 'Balance precision and recall for better F1 score' END,
 CASE WHEN list_contains(string_split(edge_text,','), 'Multiple players near ball') THEN 'Implement better multi-player possession resolution' END,
 CASE WHEN list_contains(string_split(edge_text,','), 'Ball in air - no clear possession') THEN 'Add temporal smoothing for ball-in-air scenarios' END,
 CASE WHEN list_contains(string_split(edge_text,','), 'Low confidence possession assignment') THEN 'Review confidence calculation algorithm' END,
 CASE WHEN processing_time_per_frame > 0.1e0 THEN 'Optimize processing speed for real-time analysis' END) AS recommendations FROM q""",
)
def _advice(t):
    df = Q.validation_recommendations(Q._rates(t.validation_reports.drop("recommendations")))
    return df.select("video_name", F.array_join("recommendations", " | ").alias("recommendations"))


@query(
    "aggregate_validation",
    "WITH s AS (SELECT COUNT(*) AS total_tests, CAST(SUM(total_frames) AS BIGINT) AS total_frames, CAST(SUM(tp) AS BIGINT) AS tp, CAST(SUM(fp) AS BIGINT) AS fp, "
    "CAST(SUM(fn) AS BIGINT) AS fn, CAST(SUM(tn) AS BIGINT) AS tn, AVG(processing_time_per_frame) AS apt FROM @report_rows), "
    + RR.format(src="s").replace("WITH ", "")
    + """ SELECT total_tests, total_frames, tp, fp, fn, tn, ROUND(apt,8) AS average_processing_time, ROUND(p,8) AS precision, ROUND(rc,8) AS recall,
 ROUND(ac,8) AS accuracy, ROUND(f1,8) AS f1_score, ROUND(fp/CAST(total_frames AS DOUBLE),8) AS fp_rate, ROUND(fn/CAST(total_frames AS DOUBLE),8) AS fn_rate,
 fp/CAST(total_frames AS DOUBLE) < 0.15e0 AS fp_rate_met, fn/CAST(total_frames AS DOUBLE) < 0.2e0 AS fn_rate_met,
 CASE WHEN ac >= 0.85e0 AND p >= 0.8e0 AND rc >= 0.8e0 THEN 'EXCELLENT' WHEN ac >= 0.75e0 AND p >= 0.7e0 AND rc >= 0.7e0 THEN 'GOOD'
  WHEN ac >= 0.65e0 AND p >= 0.6e0 AND rc >= 0.6e0 THEN 'FAIR' ELSE 'POOR' END AS assessment FROM q""",
)
def _aggregate(t):
    df = Q.aggregate_validation(t.validation_reports)
    return shown(df, "average_processing_time", "fp_rate", "fn_rate", *RATES, places=8)


def _labels(column: str, top: int) -> str:
    return f"SELECT label, COUNT(*) AS n FROM (SELECT unnest(string_split({column}, ',')) AS label FROM @report_rows) WHERE label <> '' GROUP BY 1 ORDER BY n DESC, label LIMIT {top}"


@query("edge_case_counts", _labels("edge_text", 5))
def _edge_counts(t):
    return Q.label_counts(t.validation_reports, "edge_cases_found", 5)


@query("recommendation_counts", _labels("advice_text", 10))
def _advice_counts(t):
    return Q.label_counts(t.validation_reports, "recommendations", 10)


@query("failure_mode_counts", _labels("failure_text", 5))
def _failure_counts(t):
    return Q.label_counts(t.validation_reports, "failure_modes", 5)


@query(
    "annotation_stats",
    """SELECT COUNT(*) AS total_annotations, COUNT(true_player) AS possession_frames, COUNT(*)-COUNT(true_player) AS no_possession_frames,
 ROUND(COUNT(true_player)/CAST(COUNT(*) AS DOUBLE),8) AS possession_rate, ROUND(AVG(true_confidence),8) AS average_confidence FROM @truth""",
)
def _annotations(t):
    return shown(Q.annotation_stats(t.truth), "possession_rate", "average_confidence", places=8)


@query(
    "most_active_players",
    """WITH c AS (SELECT match_id, true_player, COUNT(*) AS n FROM @truth WHERE true_player IS NOT NULL GROUP BY 1, 2)
SELECT * FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY n DESC, true_player) <= 5""",
)
def _active(t):
    return Q.most_active_players(t.truth)


@query(
    "validation_summary_table",
    RR.format(src="@report_rows")
    + """ SELECT video_name, segment_start, segment_end, total_frames, ROUND(ac,6) AS accuracy, ROUND(p,6) AS precision, ROUND(rc,6) AS recall, ROUND(f1,6) AS f1_score,
 processing_time_per_frame, CAST(len(list_filter(string_split(edge_text,','), lambda x: x <> '')) AS BIGINT) AS edge_cases_count,
 CAST(len(list_filter(string_split(failure_text,','), lambda x: x <> '')) AS BIGINT) AS failure_modes_count,
 CAST(len(list_filter(string_split(advice_text,','), lambda x: x <> '')) AS BIGINT) AS recommendations_count FROM q""",
)
def _summary_table(t):
    return shown(Q.validation_summary_table(t.validation_reports), *RATES)
