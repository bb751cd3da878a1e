"""Tracking and other stepwise queries."""

from pyspark.sql import functions as F

from courtflow.operators import folds as T
from courtflow.operators import shooting as S
from courtflow.plans.possession import ASSIGNED, assigned, fsm_sql
from courtflow.plans.registry import query, shown


def ball_frames(t):
    a = assigned(t).select("match_id", "frame_number", "ts_sec", F.col("track_id").alias("possession_player_id"))
    team = F.when(F.col("possession_player_id").isNull(), None).when(F.col("possession_player_id") <= 7, "home")
    return a.withColumn("team", team.otherwise("away"))


FSM = """, bf AS (SELECT match_id, frame_number, ts_sec, track_id AS holder, CASE WHEN track_id <= 7 THEN 'home' WHEN track_id > 7 THEN 'away' END AS team FROM asg), """


@query("possession_fsm", ASSIGNED.replace("WITH", "WITH RECURSIVE", 1) + FSM + fsm_sql("bf") + " SELECT * FROM fsm")
def _fsm(t):
    return T.possession_fsm(ball_frames(t)).drop("event_no")


@query("possession_fsm_chunks", ASSIGNED.replace("WITH", "WITH RECURSIVE", 1) + FSM + fsm_sql("bf") + " SELECT * FROM fsm")
def _fsm_chunks(t):
    """The same in chunks of 64 frames, each folded from an unknown state first."""
    return T.possession_fsm(ball_frames(t), size=64).drop("event_no")


@query("iou_tracker")
def _tracker(t):
    return T.iou_tracker(t.players, t.frames)


@query("stabilize_bboxes")
def _stabilize(t):
    d = T.stabilize_bboxes(t.detections)
    return shown(d.filter("kept").drop("kept"), "x1", "y1", "x2", "y2", "confidence", "stability")


@query("stabiliser_statistics")
def _stats(t):
    return shown(T.stabiliser_statistics(T.stabilize_bboxes(t.detections), t.detections), "avg_stability", "avg_frames_seen", "avg_confidence")


def track(t):
    return T.kalman_ball(S.ball_points(t.balls), t.frames)


@query("kalman_ball")
def _kalman(t):
    return shown(track(t), "x", "y", "vx", "vy")


@query("mean_velocity_3")
def _mean3(t):
    return shown(T.mean_velocity_3(track(t)), "mean_vx", "mean_vy")


@query("ball_in_motion")
def _motion(t):
    return T.ball_in_motion(track(t)).select("match_id", "frame_number", "in_motion")


@query(
    "predict_trajectory",
    """WITH s AS (SELECT match_id, frame_number, ball_x, ball_y, angle_to_goal AS vx, distance_to_goal AS vy FROM @shots)
SELECT match_id, frame_number, CAST(k AS INTEGER) AS step, ROUND(ball_x + k/30e0*vx, 6) AS x, ROUND(ball_y + k/30e0*vy, 6) AS y
FROM s CROSS JOIN (SELECT unnest([1,2,3,4,5]) AS k)""",
)
def _predict(t):
    d = t.shots.select(
        "match_id", "frame_number", F.col("ball_x").alias("x"), F.col("ball_y").alias("y"),
        F.col("angle_to_goal").alias("vx"), F.col("distance_to_goal").alias("vy"),
    )
    return shown(T.predict_trajectory(d, points=5), "x", "y")


@query("nms")
def _nms(t):
    d = T.nms(t.detections, {"ball": 0.3, "hoop": 0.5})
    return d.select("match_id", "frame_number", "class_name", "det_no")


@query("shrink_oversized_players")
def _shrink(t):
    return shown(T.shrink_oversized_players(t.players), "x1", "y1", "x2", "y2")


@query("auto_recalibrate_wide")
def _wide(t):
    from courtflow.operators.calibration import auto_recalibrate

    return auto_recalibrate(t.hoop_drift, check_interval=10, min_interval=45)


@query(
    "match_tracks",
    """WITH t AS (SELECT match_id, frame_number + 1 AS frame_number, track_id, x1, y1, x2, y2 FROM @detections WHERE class_name = 'player'),
j AS (SELECT b.match_id, b.frame_number, b.det_no, p.track_id, CASE WHEN least(b.x2,p.x2) > greatest(b.x1,p.x1) AND least(b.y2,p.y2) > greatest(b.y1,p.y1) THEN
 (least(b.x2,p.x2)-greatest(b.x1,p.x1))*(least(b.y2,p.y2)-greatest(b.y1,p.y1)) /
 ((b.x2-b.x1)*(b.y2-b.y1)+(p.x2-p.x1)*(p.y2-p.y1)-(least(b.x2,p.x2)-greatest(b.x1,p.x1))*(least(b.y2,p.y2)-greatest(b.y1,p.y1))) ELSE 0e0 END AS iou
 FROM @detections b JOIN t p ON p.match_id = b.match_id AND p.frame_number = b.frame_number WHERE b.class_name = 'player'),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, frame_number, det_no ORDER BY iou DESC, track_id) AS rn FROM j WHERE iou >= 0.3e0)
SELECT d.match_id, d.frame_number, d.det_no, r.track_id, ROUND(r.iou, 6) AS iou FROM @detections d LEFT JOIN r
 ON r.match_id = d.match_id AND r.frame_number = d.frame_number AND r.det_no = d.det_no AND r.rn = 1 WHERE d.class_name = 'player'""",
)
def _match(t):
    tracks = t.players.withColumn("frame_number", F.col("frame_number") + 1)
    return shown(T.match_tracks(t.players, tracks), "iou")
