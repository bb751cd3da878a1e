"""Shooting queries."""

from pyspark.sql import functions as F

from courtflow.operators import shooting as S
from courtflow.plans.geometry import IOU_SQL
from courtflow.plans.registry import query, shown

BEST = """bb AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, frame_number ORDER BY confidence DESC, det_no) AS rn
 FROM @detections WHERE class_name = 'ball') WHERE rn = 1),
pts AS (SELECT match_id, frame_number, ts_sec, (x1+x2)/2 AS x, (y1+y2)/2 AS y FROM bb)"""


@query("best_ball_per_frame", "WITH " + BEST + " SELECT match_id, frame_number, det_no, confidence FROM bb")
def _best(t):
    return S.best_ball_per_frame(t.balls).select("match_id", "frame_number", "det_no", "confidence")


C = "((x1+x2)/2 - (bx1+bx2)/2)"
PAIR = """WITH b AS (SELECT match_id, frame_number, det_no AS ball_no, x1 AS bx1, y1 AS by1, x2 AS bx2, y2 AS by2 FROM @detections WHERE class_name='ball'),
j AS (SELECT b.*, d.det_no, d.track_id, d.confidence, d.x2-d.x1 AS w, d.y2-d.y1 AS h,
 sqrt(((d.x1+d.x2)/2-(bx1+bx2)/2)*((d.x1+d.x2)/2-(bx1+bx2)/2)+((d.y1+d.y2)/2-(by1+by2)/2)*((d.y1+d.y2)/2-(by1+by2)/2)) AS dist
 FROM b JOIN @detections d USING (match_id, frame_number) WHERE d.class_name = '{cls}'),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, frame_number, ball_no ORDER BY dist, det_no) AS rn FROM j)
"""


@query(
    "nearest_player",
    PAIR.format(cls="player")
    + "SELECT match_id, frame_number, ball_no, det_no AS player_no, track_id, confidence, ROUND(dist, 6) AS distance_to_ball FROM k WHERE rn = 1",
)
def _nearest(t):
    return shown(S.nearest_player(t.balls, t.players), "distance_to_ball")


@query(
    "shot_outcome_by_hoop_radius",
    PAIR.format(cls="hoop")
    + """SELECT b.match_id, b.frame_number, b.ball_no, k.det_no AS hoop_no, ROUND(dist, 6) AS hoop_proximity,
 CASE WHEN dist IS NULL THEN 'unknown' WHEN dist < greatest(w,h)/2*1.2e0 THEN 'goal' ELSE 'miss' END AS result,
 ROUND(CASE WHEN dist IS NULL THEN 0e0 WHEN dist < greatest(w,h)/2*1.2e0 THEN greatest(0.7e0, 1e0-dist/(greatest(w,h)/2))
  ELSE least(0.8e0, dist/(greatest(w,h)/2*3)) END, 6) AS confidence
FROM b LEFT JOIN k ON k.match_id = b.match_id AND k.frame_number = b.frame_number AND k.ball_no = b.ball_no AND k.rn = 1""",
)
def _hoop_radius(t):
    return shown(S.shot_outcome_by_hoop_radius(t.balls, t.hoops), "hoop_proximity", "confidence")


VEL = "WITH " + BEST + """,
v1 AS (SELECT *, CASE WHEN ts_sec - LAG(ts_sec) OVER w > 0 THEN
  sqrt((x-LAG(x) OVER w)*(x-LAG(x) OVER w)+(y-LAG(y) OVER w)*(y-LAG(y) OVER w))/(ts_sec - LAG(ts_sec) OVER w) END AS step,
  y - LAG(y, 2) OVER w AS rise, COUNT(*) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n,
  x - LAG(x) OVER w AS dx, y - LAG(y) OVER w AS dy FROM pts WINDOW w AS (PARTITION BY match_id ORDER BY frame_number)),
v2 AS (SELECT *, CASE WHEN n = 3 THEN coalesce(AVG(step) OVER (PARTITION BY match_id ORDER BY frame_number
  ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 0e0) ELSE 0e0 END AS velocity FROM v1)"""


@query(
    "ball_velocity",
    VEL
    + """ SELECT match_id, frame_number, ROUND(velocity, 6) AS velocity, coalesce(n = 3 AND velocity > 2 AND rise < 0, false) AS is_shot,
 ROUND(CASE WHEN n = 3 AND velocity > 2 AND rise < 0 THEN least(velocity/10e0, 1e0) ELSE 0e0 END, 6) AS confidence FROM v2""",
)
def _velocity(t):
    df = S.ball_velocity(S.ball_points(t.balls)).select("match_id", "frame_number", "velocity", "is_shot", "confidence")
    return shown(df, "velocity", "confidence")


@query(
    "velocity_shots",
    VEL
    + " SELECT match_id, frame_number, ROUND(velocity, 6) AS velocity, ROUND(least(velocity/10e0, 1e0), 6) AS confidence FROM v2 WHERE n = 3 AND velocity > 2 AND rise < 0",
)
def _velocity_shots(t):
    df = S.velocity_shots(S.ball_points(t.balls)).select("match_id", "frame_number", "velocity", "confidence")
    return shown(df, "velocity", "confidence")


@query(
    "trajectory_quality",
    VEL
    + """, q1 AS (SELECT *, LAG(dx) OVER w AS px, LAG(dy) OVER w AS py FROM v2 WINDOW w AS (PARTITION BY match_id ORDER BY frame_number)),
q2 AS (SELECT *, CASE WHEN sqrt(px*px+py*py) > 0 AND sqrt(dx*dx+dy*dy) > 0 AND
  degrees(acos(greatest(-1e0, least(1e0, (px*dx+py*dy)/(sqrt(px*px+py*py)*sqrt(dx*dx+dy*dy)))))) > 30 THEN 1 ELSE 0 END AS turn FROM q1),
q3 AS (SELECT match_id, frame_number, COUNT(*) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS points,
  COUNT(step) OVER (w ROWS BETWEEN 28 PRECEDING AND CURRENT ROW) AS steps,
  AVG(step) OVER (w ROWS BETWEEN 28 PRECEDING AND CURRENT ROW) AS mean_step,
  VAR_POP(step) OVER (w ROWS BETWEEN 28 PRECEDING AND CURRENT ROW) AS var,
  SUM(turn) OVER (w ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS turns FROM q2
  WINDOW w AS (PARTITION BY match_id ORDER BY frame_number))
SELECT match_id, frame_number, CASE WHEN points >= 5 THEN steps ELSE 0 END AS steps,
 CASE WHEN points >= 5 THEN ROUND(mean_step, 4) END AS mean_velocity,
 ROUND(CASE WHEN points >= 5 THEN 1e0/(1e0+var) ELSE 0e0 END, 9) AS smoothness,
 CASE WHEN points >= 5 THEN CAST(turns AS BIGINT) ELSE 0 END AS direction_changes FROM q3""",
)
def _trajectory(t):
    df = S.trajectory_quality(S.ball_points(t.balls))
    steps = F.size("velocity_profile").cast("long")
    total = F.aggregate("velocity_profile", F.lit(0.0), lambda a, x: a + x)
    return df.select(
        "match_id",
        "frame_number",
        steps.alias("steps"),
        F.when(steps > 0, F.round(total / F.when(steps > 0, steps), 4)).alias("mean_velocity"),
        F.round("smoothness", 9).alias("smoothness"),
        "direction_changes",
    )


@query(
    "shot_rhythm",
    """WITH g AS (SELECT *, ts_sec - LAG(ts_sec) OVER (PARTITION BY match_id ORDER BY frame_number) AS gap FROM @shots),
a AS (SELECT match_id, COUNT(*) AS n, MAX(ts_sec)-MIN(ts_sec) AS span, AVG(gap) AS m, VAR_POP(gap) AS v FROM g GROUP BY 1)
SELECT match_id, ROUND(n/(span/60e0), 6) AS shots_per_minute, ROUND(m, 6) AS mean_interval, ROUND(v, 6) AS interval_variance,
 CASE WHEN v < m*0.5e0 THEN 'consistent' WHEN v > m*2e0 THEN 'sporadic' ELSE 'moderate' END AS rhythm FROM a""",
)
def _rhythm(t):
    return shown(S.shot_rhythm(t.shots), "shots_per_minute", "mean_interval", "interval_variance")


@query(
    "recent_shots",
    "SELECT match_id, frame_number, shooter_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY frame_number DESC) AS rn FROM @shots) WHERE rn <= 10",
)
def _recent(t):
    return S.recent_shots(t.shots).select("match_id", "frame_number", "shooter_id")


@query(
    "shots_within_last_minute",
    "WITH m AS (SELECT match_id, MAX(ts_sec) AS l FROM @shots GROUP BY 1) SELECT match_id, frame_number, shooter_id FROM @shots JOIN m USING (match_id) WHERE l - ts_sec <= 60",
)
def _recent_minute(t):
    return S.recent(t.shots).select("match_id", "frame_number", "shooter_id")


ATTEMPTS = f"""WITH fr AS (SELECT match_id, frame_number, LAG(frame_number) OVER (PARTITION BY match_id ORDER BY frame_number) AS pf FROM @frames),
hold AS (SELECT * FROM (SELECT p.match_id, p.frame_number, p.ts_sec, p.track_id, p.det_no, p.court_x, p.court_y,
  b.court_x AS bx, b.court_y AS by_, ROW_NUMBER() OVER (PARTITION BY p.match_id, p.frame_number, p.track_id ORDER BY p.det_no, b.det_no) AS rn
  FROM @detections p JOIN @detections b ON p.match_id=b.match_id AND p.frame_number=b.frame_number
  WHERE p.class_name='player' AND b.class_name='ball' AND {IOU_SQL} > 0.1e0 AND
  sqrt(((p.x1+p.x2)/2-(b.x1+b.x2)/2)*((p.x1+p.x2)/2-(b.x1+b.x2)/2)+((p.y1+p.y2)/2-(b.y1+b.y2)/2)*((p.y1+p.y2)/2-(b.y1+b.y2)/2)) < 50) WHERE rn = 1),
h2 AS (SELECT hold.*, fr.pf, LAG(hold.frame_number) OVER (PARTITION BY hold.match_id, track_id ORDER BY hold.frame_number) AS lf
  FROM hold JOIN fr ON fr.match_id = hold.match_id AND fr.frame_number = hold.frame_number),
h3 AS (SELECT *, SUM(CASE WHEN lf IS NULL OR lf IS DISTINCT FROM pf THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, track_id
  ORDER BY frame_number ROWS UNBOUNDED PRECEDING) AS spell,
  CASE WHEN sqrt(court_x*court_x+(court_y-7.625e0)*(court_y-7.625e0)) <= 4.9e0 THEN 0e0
   WHEN sqrt((court_x-30.5e0)*(court_x-30.5e0)+(court_y-7.625e0)*(court_y-7.625e0)) <= 4.9e0 THEN 30.5e0 END AS gx FROM h2),
h4 AS (SELECT *, greatest(0e0, sqrt((bx-gx)*(bx-gx)+(by_-7.625e0)*(by_-7.625e0))-4.9e0) AS sd FROM h3 WHERE gx IS NOT NULL),
h5 AS (SELECT *, greatest(0e0, 1e0 - sqrt((bx-court_x)*(bx-court_x)+(by_-court_y)*(by_-court_y))/30e0)*0.6e0
  + CASE WHEN sd < 2 THEN 1e0 ELSE greatest(0e0, 1e0-(sd-2e0)/3e0) END*0.4e0 AS conf FROM h4),
att AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, track_id, spell ORDER BY frame_number) AS r2
  FROM h5 WHERE conf >= {{min}}) WHERE r2 = 1)"""


def attempts(t, minimum=0.7):
    return S.new_shot_attempts(t.balls, t.players, t.frames, minimum)


@query(
    "new_shot_attempts",
    ATTEMPTS.format(min="0.7e0")
    + """ SELECT match_id, frame_number, ROUND(ts_sec, 6) AS timestamp, track_id AS player_id,
 CASE WHEN gx = 0 THEN 'shooting_circle_left' ELSE 'shooting_circle_right' END AS shooting_circle, bx AS ball_x, by_ AS ball_y,
 court_x AS player_x, court_y AS player_y, ROUND(sd, 6) AS shot_distance, ROUND(degrees(atan2(7.625e0-by_, gx-bx)), 6) AS shot_angle,
 ROUND(conf, 6) AS confidence FROM att""",
)
def _attempts(t):
    return shown(attempts(t), "timestamp", "shot_distance", "shot_angle", "confidence")


@query(
    "shot_outcome_by_proximity",
    ATTEMPTS.format(min="0.2e0")
    + """, hp AS (SELECT * FROM (SELECT a.match_id, a.frame_number, a.track_id, d.det_no AS hoop_no, d.court_x AS hx, d.court_y AS hy,
 ROW_NUMBER() OVER (PARTITION BY a.match_id, a.frame_number, a.track_id ORDER BY sqrt((d.court_x-a.gx)*(d.court_x-a.gx)
  +(d.court_y-7.625e0)*(d.court_y-7.625e0)), d.det_no) AS rn FROM att a JOIN @detections d USING (match_id, frame_number)
 WHERE d.class_name='hoop' AND d.confidence >= 0.5e0) WHERE rn = 1),
gp AS (SELECT hp.match_id, hp.frame_number, hp.track_id, hp.hoop_no, MIN(sqrt((b.court_x-hx)*(b.court_x-hx)+(b.court_y-hy)*(b.court_y-hy))) AS gap
 FROM hp JOIN @detections b ON b.match_id = hp.match_id AND b.frame_number = hp.frame_number WHERE b.class_name = 'ball' GROUP BY 1,2,3,4)
SELECT att.match_id, att.frame_number, att.track_id AS player_id, CASE WHEN gx = 0 THEN 'shooting_circle_left' ELSE 'shooting_circle_right' END AS shooting_circle,
 hoop_no, ROUND(gap, 6) AS ball_hoop_distance, CASE WHEN gap IS NULL THEN 'unknown' WHEN gap < 2 THEN 'goal' ELSE 'miss' END AS result,
 ROUND(CASE WHEN gap IS NULL THEN 0.3e0 WHEN gap < 2 THEN greatest(0.5e0, 1e0-gap/2e0) ELSE 0.7e0 END, 6) AS confidence
FROM att LEFT JOIN gp ON gp.match_id=att.match_id AND gp.frame_number=att.frame_number AND gp.track_id=att.track_id""",
)
def _proximity(t):
    df = S.shot_outcome_by_proximity(attempts(t, 0.2), t.balls, t.hoops)
    return shown(df, "ball_hoop_distance", "confidence")


RATE = "ROUND(COUNT(*) FILTER (WHERE result='goal')/CAST(COUNT(*) AS DOUBLE), 6)"
GOALS = "COUNT(*) FILTER (WHERE result='goal')"
SUM_COLS = f"COUNT(*) AS shots, {GOALS} AS goals, COUNT(*) - {GOALS} AS misses, {RATE} AS success_rate, ROUND(AVG(distance_to_goal),8) AS average_distance, ROUND(AVG(angle_to_goal),8) AS average_angle FROM @shots"


@query(
    "shooting_summary",
    f"SELECT match_id, 'all' AS grouping, 'all' AS value, {SUM_COLS} GROUP BY match_id UNION ALL SELECT match_id, 'team', team, {SUM_COLS} GROUP BY match_id, team "
    f"UNION ALL SELECT match_id, 'position', position, {SUM_COLS} GROUP BY match_id, position UNION ALL SELECT match_id, 'zone', zone, {SUM_COLS} GROUP BY match_id, zone",
)
def _summary(t):
    return shown(shown(S.shooting_summary(t.shots), "success_rate"), "average_distance", "average_angle", places=8)


@query(
    "player_shooting_stats",
    f"""SELECT match_id, shooter_id AS player_id, COUNT(*) AS total_shots, {GOALS} AS goals, COUNT(*) FILTER (WHERE result='miss') AS misses,
 COUNT(*) FILTER (WHERE result='blocked') AS blocked_shots, {RATE} AS success_rate, ROUND(AVG(distance_to_goal),8) AS average_distance,
 ROUND(AVG(angle_to_goal),8) AS average_angle FROM @shots GROUP BY 1,2""",
)
def _player(t):
    return shown(shown(S.player_shooting_stats(t.shots), "success_rate"), "average_distance", "average_angle", places=8)


@query("shots_by_zone", f"SELECT match_id, zone, COUNT(*) AS attempts, {GOALS} AS goals, {RATE} AS accuracy FROM @shots GROUP BY 1, 2")
def _by_zone(t):
    return shown(S.shots_by(t.shots, "match_id", "zone"), "accuracy")


@query(
    "shots_by_player",
    f"SELECT match_id, shooter_id, COUNT(*) AS attempts, {GOALS} AS goals, {RATE} AS accuracy FROM @shots GROUP BY 1, 2",
)
def _by_player(t):
    return shown(S.shots_by(t.shots, "match_id", "shooter_id"), "accuracy")


@query(
    "shot_outcomes",
    """WITH o AS (SELECT match_id, result, COUNT(*) AS n FROM @shots GROUP BY 1, 2)
SELECT match_id, result, n, ROUND(SUM(CASE WHEN result='goal' THEN n ELSE 0 END) OVER w/CAST(SUM(n) OVER w AS DOUBLE), 6) AS success_rate FROM o WINDOW w AS (PARTITION BY match_id)""",
)
def _outcomes(t):
    return shown(S.shot_outcomes(t.shots), "success_rate")


@query(
    "expected_goals",
    """SELECT match_id, team, ROUND(SUM(0.6e0 * CASE WHEN distance_to_goal > 5 THEN 0.8e0 WHEN distance_to_goal < 2 THEN 1.2e0 ELSE 1e0 END
 * CASE WHEN abs(angle_to_goal) > 45 THEN 0.9e0 ELSE 1e0 END * CASE WHEN position='GS' THEN 1.1e0 ELSE 1e0 END), 6) AS expected_goals,
 COUNT(*) FILTER (WHERE result='goal') AS goals FROM @shots GROUP BY 1,2""",
)
def _expected(t):
    return shown(S.expected_goals(t.shots), "expected_goals")


@query(
    "success_rate_by_distance_bin",
    f"""WITH e AS (SELECT match_id, MIN(distance_to_goal) AS lo, (MAX(distance_to_goal)-MIN(distance_to_goal))/5e0 AS st FROM @shots GROUP BY 1),
b AS (SELECT match_id, CAST(CASE WHEN distance_to_goal <= lo+st THEN 0 WHEN distance_to_goal <= lo+2e0*st THEN 1 WHEN distance_to_goal <= lo+3e0*st THEN 2
 WHEN distance_to_goal <= lo+4e0*st THEN 3 ELSE 4 END AS BIGINT) AS bin, result FROM @shots JOIN e USING (match_id))
SELECT match_id, bin, COUNT(*) AS attempts, {RATE} AS success_rate FROM b GROUP BY 1, 2""",
)
def _bins(t):
    return shown(S.success_rate_by_distance_bin(t.shots, keys=["match_id"]), "success_rate")
