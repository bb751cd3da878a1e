"""Writing result tables and reading them back."""

from pyspark.sql import functions as F

from courtflow.operators import possession as P
from courtflow.operators import service as V
from courtflow.operators import standings as S
from courtflow.operators import zones as Z
from courtflow.plans.geometry import K
from courtflow.plans.league import STANDINGS_CTE
from courtflow.plans.possession import LABELS, PC_SELECT, STATS, player_frames, smoothed_labels
from courtflow.plans.registry import query, shown
from courtflow.plans.zones import BASE_V, ZONED
from courtflow.session import scratch_path
from courtflow.sources import readers as R
from courtflow.sources import sinks as W


def _csv(df, label):
    path = scratch_path(df.sparkSession, label)
    df.write.option("header", True).csv(path)
    return path


def _json(df, label):
    path = scratch_path(df.sparkSession, label)
    df.write.json(path)
    return path


@query(
    "read_game_results",
    "SELECT game_id, home_team, away_team, home_score, away_score, category, CAST(game_date AS VARCHAR) AS game_date FROM @game_results",
)
def _games(t):
    d = R.read_game_results(t.spark, _csv(t.game_results, "games"))
    return d.withColumn("game_date", F.col("game_date").cast("string"))


@query("read_detections", f"SELECT {K}, class_name, x1, y1, x2, y2, confidence, track_id, team, position, court_x, court_y FROM @detections")
def _detections(t):
    d = R.read_detections(t.spark, _csv(t.detections, "detections"))
    return d.drop("ts_sec")


@query("read_possession_changes", LABELS + PC_SELECT.replace(",\n open_at_end", ""))
def _changes(t):
    made = P.possession_changes(smoothed_labels(t)).drop("open_at_end")
    d = R.read_possession_changes(t.spark, _csv(made, "changes"))
    return shown(d, "start_timestamp", "end_timestamp", "duration_seconds")


@query(
    "read_zone_violations",
    ZONED + "," + BASE_V + " SELECT match_id, frame_number, player_id, violation_type, zone AS zone_name, severity, description FROM bv",
)
def _violations(t):
    made = Z.zone_violations(t.players).select(
        "match_id", "frame_number", F.col("ts_sec").alias("timestamp"), "player_id", "violation_type",
        F.col("zone").alias("zone_name"), "severity", "description",
    )
    return R.read_zone_violations(t.spark, _csv(made, "violations")).drop("timestamp")


@query(
    "frame_detections_json",
    """WITH o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, frame_number ORDER BY CASE class_name WHEN 'ball' THEN 0 WHEN 'player' THEN 1 ELSE 2 END, det_no) AS n FROM @detections)
SELECT match_id, frame_number, n AS det_no, class_name, x1, y1, x2, y2, confidence FROM o""",
)
def _frame_json(t):
    made = W.per_frame_detections_json(t.detections)
    path = scratch_path(t.spark, "frames")
    made.write.option("header", True).option("escape", '"').csv(path)
    return R.read_frame_detections_json(t.spark, path).drop("ts_sec")


@query(
    "per_frame_detections_json",
    """SELECT match_id, frame_number, COUNT(*) FILTER (WHERE class_name='player') AS player_count, COUNT(*) FILTER (WHERE class_name='ball') AS ball_count,
 COUNT(*) FILTER (WHERE class_name='hoop') AS hoop_count FROM @detections GROUP BY 1,2""",
)
def _per_frame(t):
    return W.per_frame_detections_json(t.detections).select(
        "match_id", "frame_number", "player_count", "ball_count", "hoop_count"
    )


@query("read_calibrations", "SELECT match_id, from_frame, method, confidence, h0, h4, h8 FROM @calibration_rows")
def _calibrations(t):
    rows = F.array(*[F.slice("h", i, 3) for i in (1, 4, 7)])
    made = t.calibrations.select(
        "match_id", "from_frame", rows.alias("homography_matrix"), "method", "confidence",
        F.struct(F.lit(30.5).alias("length"), F.lit(15.25).alias("width")).alias("court_dimensions"),
    )
    d = R.read_calibrations(t.spark, _json(made, "calibrations"))
    at = lambda i: F.element_at("h", i + 1).alias(f"h{i}")
    return d.select("match_id", "from_frame", "method", "confidence", at(0), at(4), at(8))


@query("read_ground_truth", "SELECT match_id, frame_number, true_player, true_confidence FROM @truth")
def _truth(t):
    item = F.struct(
        "frame_number",
        F.col("true_player").alias("true_possession_player"),
        F.col("true_confidence").alias("true_possession_confidence"),
    )
    # one document per annotated frame here; annotation files hold a segment each
    made = t.truth.select("match_id", F.array(item).alias("annotations"))
    d = R.read_ground_truth(t.spark, _json(made, "truth"))
    return d.select("match_id", "frame_number", "true_player", "true_confidence")


@query(
    "read_validation_reports",
    "SELECT video_name, segment_start, segment_end, total_frames, tp, fp, fn, tn, processing_time_per_frame FROM @report_rows",
)
def _reports(t):
    metrics = F.struct(
        "total_frames",
        F.col("tp").alias("true_positives"),
        F.col("fp").alias("false_positives"),
        F.col("fn").alias("false_negatives"),
        F.col("tn").alias("true_negatives"),
        "processing_time_per_frame",
    )
    made = t.validation_reports.select(
        "video_name", "segment_start", "segment_end", metrics.alias("metrics"), "edge_cases_found", "failure_modes",
        "recommendations",
    )
    d = R.read_validation_reports(t.spark, _json(made, "reports"), pattern="*.json", multi_line=False)
    return d.drop("edge_cases_found", "failure_modes", "recommendations")


@query("read_error_log", "SELECT value FROM @error_lines")
def _log(t):
    path = scratch_path(t.spark, "log")
    t.error_lines.write.text(path)
    return R.read_error_log(t.spark, path)


@query("file_manifest_storage", "SELECT 'csv' AS file_type, COUNT(*) > 0 AS found FROM @game_results")
def _manifest(t):
    d = R.read_file_manifest(t.spark, _csv(t.game_results, "games"))
    stats = V.storage_stats(d).filter(F.col("file_type") == "csv")
    return stats.select("file_type", (F.col("files") > 0).alias("found"))


GAINED = """, g AS (SELECT match_id, start_ts AS timestamp, 'possession_gained' AS event_type, player_id, CASE WHEN player_id = 1 THEN 'home' ELSE 'away' END AS team,
 '' AS result, '' AS zone, CAST(NULL AS DOUBLE) AS distance FROM pc)"""


def possession_events(t):
    d = P.possession_changes(smoothed_labels(t))
    return d.select(
        "match_id",
        F.col("start_timestamp").alias("ts_sec"),
        "player_id",
        F.when(F.col("player_id") == 1, "home").otherwise("away").alias("team"),
        F.lit("gained").alias("event_type"),
    )


@query(
    "events_table",
    LABELS
    + GAINED
    + """ SELECT match_id, ROUND(timestamp,6) AS timestamp, event_type, player_id, team, result, zone, distance FROM g UNION ALL
 SELECT match_id, ROUND(ts_sec,6), 'shot', shooter_id, team, result, zone, distance_to_goal FROM @shots""",
)
def _events(t):
    return shown(W.events_table(t.shots, possession_events(t)), "timestamp")


@query(
    "player_stats_table",
    STATS
    + """ SELECT match_id, player_id, ROUND(coalesce(possession_time,0e0),6) AS possession_time, coalesce(sa,0) AS shots_attempted, coalesce(sm,0) AS shots_made,
 CAST(0 AS BIGINT) AS passes, CAST(0 AS BIGINT) AS interceptions, coalesce(zone_violations,0) AS zone_violations FROM ps FULL JOIN sh USING (match_id, player_id)""",
)
def _player_stats(t):
    return shown(W.player_stats_table(P.player_stats(player_frames(t), t.shots)), "possession_time")


@query(
    "write_standings",
    STANDINGS_CTE
    + """SELECT category, team, points, ROW_NUMBER() OVER (PARTITION BY category ORDER BY points DESC, tab.goal_average DESC,
  goal_difference DESC, goals_for DESC, first_seen) AS position FROM tab""",
)
def _standings(t):
    path = scratch_path(t.spark, "standings")
    W.write_standings(S.league_table(S.standings(t.game_results)).select("category", "position", "team", "points"), path)
    return t.spark.read.schema("position long, team string, points long, category string").option("header", True).csv(path)


@query(
    "analysis_documents",
    LABELS
    + """, e AS (SELECT match_id, COUNT(*) AS n FROM pc GROUP BY 1), f AS (SELECT match_id, COUNT(*) AS n FROM @frames GROUP BY 1),
p AS (SELECT match_id, COUNT(DISTINCT track_id) AS n FROM @detections WHERE class_name='player' GROUP BY 1),
s AS (SELECT match_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE result='goal' AND team='home') AS hs FROM @shots GROUP BY 1)
SELECT CAST(f.match_id AS VARCHAR) AS game_id, f.n AS frame_count, p.n AS players, coalesce(s.n,0) AS shots, coalesce(e.n,0) AS events, coalesce(hs,0) AS home_score
FROM f JOIN p USING (match_id) LEFT JOIN s USING (match_id) LEFT JOIN e USING (match_id)""",
)
def _documents(t):
    players = t.players.groupBy("match_id", "track_id").agg(
        F.max("team").alias("team"),
        F.min("position").alias("position"),
        F.lit(0.0).alias("possession_time"),
        F.lit(False).alias("is_in_possession"),
    )
    docs = W.analysis_documents(players, t.shots, possession_events(t), t.frames, processing_time=60.0)
    path = scratch_path(t.spark, "documents")
    W.write_analysis_documents(docs, path)
    d = R.read_analysis_results(t.spark, path)
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    return d.groupBy("game_id").agg(  # a long match has several part documents
        F.sum("frame_count").alias("frame_count"),
        F.max(size("players")).alias("players"),
        F.sum(size("shot_events")).alias("shots"),
        F.sum(size("possession_events")).alias("events"),
        F.sum("game_state.home_score").alias("home_score"),
    )


def _counts(tables, spark):
    path = scratch_path(spark, "run")
    W.write_tables(tables, path)
    parts = [
        spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("n")) for n in tables
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("calibrated_run_tables")
def _calibrated(t):
    return _counts(W.calibrated_run_tables(t.detections, t.frames, t.ocr_reads), t.spark)


@query("final_run_tables")
def _final(t):
    return _counts(W.final_run_tables(t.detections, t.ocr_reads), t.spark)
