"""Possession queries."""

from pyspark.sql import functions as F

from courtflow.operators import possession as P
from courtflow.operators import zones as Z
from courtflow.plans.geometry import BP_JOIN, CONTAIN_SQL, DIST_SQL, HA_SQL, IOU_SQL
from courtflow.plans.registry import query, shown


def assigned_sql(score_sql: str, a: float, b: float) -> str:
    return f"""
WITH pr AS (SELECT b.match_id, b.frame_number, b.det_no AS ball_no, p.det_no AS player_no, p.track_id,
  {DIST_SQL} AS distance, {score_sql} AS score {BP_JOIN}),
cf AS (SELECT *, {a}e0 * greatest(0e0, 1e0 - distance/50e0) + {b}e0 * score AS confidence FROM pr WHERE distance <= 50),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, frame_number ORDER BY confidence DESC, ball_no, player_no) AS rn
  FROM cf WHERE confidence > 0.5e0),
ct AS (SELECT match_id, frame_number, COUNT(*) FILTER (WHERE class_name='ball') AS ball_count,
  COUNT(*) FILTER (WHERE class_name='player') AS player_count FROM @detections GROUP BY 1,2),
asg AS (SELECT f.match_id, f.frame_number, f.ts_sec, ct.ball_count, ct.player_count, rk.player_no, rk.track_id,
  coalesce(rk.confidence, 0e0) AS confidence, rk.distance, rk.score,
  CASE WHEN rk.player_no IS NOT NULL THEN CASE WHEN rk.score > 0.3e0 THEN 'LABEL' ELSE 'proximity' END
   WHEN ct.ball_count = 0 THEN 'no_ball_detected' WHEN ct.player_count = 0 THEN 'no_players_detected'
   ELSE 'no_clear_possession' END AS reason
  FROM @frames f JOIN ct USING (match_id, frame_number)
  LEFT JOIN rk ON rk.match_id = f.match_id AND rk.frame_number = f.frame_number AND rk.rn = 1)
"""


ASSIGNED = assigned_sql(CONTAIN_SQL, 0.3, 0.7).replace("LABEL", "containment")
ASSIGNED_IOU = assigned_sql(IOU_SQL, 0.4, 0.6).replace("LABEL", "overlap")


def smooth_sql(source: str, prefix: str = "WITH ") -> str:
    """Stepwise rule as islands: run position within equal consecutive labels."""
    return f"""{prefix}s0 AS (SELECT match_id, frame_number, ts_sec, raw_player, raw_confidence FROM {source}),
s1 AS (SELECT *, LAG(raw_player) OVER w AS p1, LAG(raw_player, 2) OVER w AS p2,
  COUNT(raw_player) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM s0
  WINDOW w AS (PARTITION BY match_id ORDER BY frame_number)),
s2 AS (SELECT *, CASE WHEN raw_player IS NOT NULL AND ((raw_player = p1 AND raw_player = p2) OR seen = 0)
  THEN raw_player END AS cand FROM s1),
s3 AS (SELECT *, LAST_VALUE(cand IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY frame_number
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS smoothed FROM s2),
s4 AS (SELECT *, LAG(smoothed) OVER (PARTITION BY match_id ORDER BY frame_number) AS prev FROM s3),
s5 AS (SELECT *, CASE WHEN smoothed IS DISTINCT FROM prev THEN 1 ELSE 0 END AS chg FROM s4),
s6 AS (SELECT *, SUM(chg) OVER (PARTITION BY match_id ORDER BY frame_number ROWS UNBOUNDED PRECEDING) AS ep FROM s5),
ep AS (SELECT match_id, ep, MIN(frame_number) AS start_frame, MIN(ts_sec) AS start_ts, MIN(smoothed) AS player_id
  FROM s6 WHERE smoothed IS NOT NULL GROUP BY 1, 2),
fin AS (SELECT match_id, MAX(frame_number) AS f, MAX(ts_sec) AS ts FROM s0 GROUP BY 1),
pc AS (SELECT ep.match_id, player_id, start_frame, coalesce(LEAD(start_frame) OVER w, fin.f) AS end_frame, start_ts,
  coalesce(LEAD(start_ts) OVER w, fin.ts) AS end_ts, LEAD(start_frame) OVER w IS NULL AS open_at_end
  FROM ep JOIN fin USING (match_id) WINDOW w AS (PARTITION BY ep.match_id ORDER BY start_frame))
"""


def fsm_sql(source: str, timeout: float = 3.0) -> str:
    """The possession automaton frame by frame, to be put after other tables of a WITH RECURSIVE.
    ``source``: match_id, frame_number, ts_sec, holder (null or 0: nobody), team."""
    has = "(n.holder IS NOT NULL AND n.holder <> 0)"
    over = f"r.start_ts <> 0 AND n.ts_sec - r.start_ts > {timeout}e0"
    taken = f"({has} AND (r.phase = 'none' OR (r.phase = 'held' AND n.holder <> r.player)))"
    return f"""n AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY frame_number) AS rn FROM {source}),
r AS (SELECT DISTINCT match_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS frame_number, CAST(NULL AS DOUBLE) AS ts_sec, 'none' AS phase,
  CAST(NULL AS DOUBLE) AS start_ts, CAST(NULL AS BIGINT) AS player, CAST(NULL AS VARCHAR) AS team, CAST(NULL AS BIGINT) AS lost, CAST(NULL AS BIGINT) AS gained, CAST(NULL AS BIGINT) AS timed_out FROM n
 UNION ALL SELECT n.match_id, n.rn, n.frame_number, n.ts_sec,
  CASE r.phase WHEN 'none' THEN CASE WHEN {has} THEN 'start' ELSE 'none' END WHEN 'start' THEN 'held'
   WHEN 'held' THEN CASE WHEN NOT {has} THEN 'ended' WHEN n.holder <> r.player THEN 'held' WHEN {over} THEN 'ended' ELSE 'held' END ELSE 'none' END,
  CASE WHEN r.phase = 'ended' THEN NULL WHEN r.phase = 'none' AND {has} THEN n.ts_sec ELSE r.start_ts END,
  CASE WHEN r.phase = 'ended' THEN NULL WHEN {taken} THEN n.holder ELSE r.player END,
  CASE WHEN r.phase = 'ended' THEN NULL WHEN {taken} THEN coalesce(n.team, r.team) ELSE r.team END,
  CASE WHEN r.phase = 'held' AND (NOT {has} OR n.holder <> r.player) THEN r.player END,
  CASE WHEN {taken} THEN n.holder END,
  CASE WHEN r.phase = 'held' AND {has} AND n.holder = r.player AND {over} THEN r.player END
 FROM r JOIN n ON n.match_id = r.match_id AND n.rn = r.rn + 1),
fsm AS (SELECT match_id, frame_number, ts_sec, lost AS player_id, coalesce(team, 'home') AS team, 'lost' AS event_type FROM r WHERE lost IS NOT NULL
 UNION ALL SELECT match_id, frame_number, ts_sec, gained, coalesce(team, 'home'), 'gained' FROM r WHERE gained IS NOT NULL
 UNION ALL SELECT match_id, frame_number, ts_sec, timed_out, coalesce(team, 'home'), 'timeout' FROM r WHERE timed_out IS NOT NULL)
"""


LABELS = smooth_sql("@possession_raw")
TRACKED = ASSIGNED + """, tr AS (SELECT match_id, frame_number, ts_sec, track_id AS raw_player, confidence AS raw_confidence
 FROM asg WHERE ball_count > 0 AND player_count > 0)""" + smooth_sql("tr", ", ")
VIOLATIONS = """, tv AS (SELECT s6.match_id, ep.player_id, ep.start_frame, s6.frame_number AS violation_frame,
  ep.start_ts AS start_timestamp, s6.ts_sec AS violation_timestamp, s6.ts_sec - ep.start_ts AS duration_seconds,
  ROW_NUMBER() OVER (PARTITION BY s6.match_id, s6.ep ORDER BY s6.frame_number) AS rn
  FROM s6 JOIN ep ON ep.match_id = s6.match_id AND ep.ep = s6.ep WHERE s6.ts_sec - ep.start_ts > 3)
"""
V_SELECT = """ SELECT match_id, player_id, start_frame, violation_frame, ROUND(start_timestamp, 6) AS start_timestamp,
 ROUND(violation_timestamp, 6) AS violation_timestamp, ROUND(duration_seconds, 6) AS duration_seconds,
 ROUND(duration_seconds - 3, 6) AS excess_seconds FROM tv WHERE rn = 1"""
TIMES = ["start_timestamp", "violation_timestamp", "duration_seconds", "excess_seconds"]


def assigned(t, mode="containment"):
    return P.assign_possession(t.detections, mode)


def smoothed_labels(t):
    return P.smooth_possession(t.possession_raw)


def smoothed_tracks(t):
    return P.smooth_possession(P.tracked_frames(assigned(t)))


@query(
    "ball_player_candidates",
    f"SELECT b.match_id, b.frame_number, b.det_no AS ball_no, p.det_no AS player_no, ROUND({DIST_SQL}, 6) AS distance {BP_JOIN} AND {DIST_SQL} <= 50",
)
def _candidates(t):
    df = P.ball_player_candidates(t.balls, t.players)
    return shown(df.select("match_id", "frame_number", "ball_no", "player_no", "distance"), "distance")


def _assign(t, mode):
    df = assigned(t, mode)
    kind = F.when(F.col("reason").startswith("no_"), F.col("reason")).otherwise(F.split("reason", "_")[0])
    df = df.withColumn("reason", kind)
    return shown(df, "ts_sec", "confidence", "distance", "score")


ASSIGN_SELECT = """ SELECT match_id, frame_number, ROUND(ts_sec, 6) AS ts_sec, ball_count, player_count, player_no, track_id,
 ROUND(confidence, 6) AS confidence, ROUND(distance, 6) AS distance, ROUND(score, 6) AS score, reason FROM asg"""


@query("assign_possession", ASSIGNED + ASSIGN_SELECT)
def _assign_containment(t):
    return _assign(t, "containment")


@query("assign_possession_iou", ASSIGNED_IOU + ASSIGN_SELECT)
def _assign_iou(t):
    return _assign(t, "iou")


@query("smooth_possession", LABELS + " SELECT match_id, frame_number, raw_player, smoothed FROM s4")
def _smooth(t):
    return smoothed_labels(t).select("match_id", "frame_number", "raw_player", "smoothed")


@query(
    "smooth_confidence",
    """WITH s AS (SELECT *, COUNT(raw_player) OVER (PARTITION BY match_id ORDER BY frame_number) > 0 AS started FROM @possession_raw),
l AS (SELECT match_id, frame_number, raw_confidence, started, list(CASE WHEN started THEN raw_confidence END) OVER
 (PARTITION BY match_id ORDER BY frame_number ROWS BETWEEN 33 PRECEDING AND CURRENT ROW) AS h FROM s)
SELECT match_id, frame_number, CASE WHEN started THEN
 list_reduce(list_filter(h, lambda x: x IS NOT NULL), lambda a, x: 0.7e0*x + (1e0-0.7e0)*a)
 ELSE raw_confidence END AS smoothed_confidence FROM l""",
)
def _ema(t):
    return P.smooth_confidence(t.possession_raw).select("match_id", "frame_number", "smoothed_confidence")


PC_SELECT = """ SELECT match_id, player_id, start_frame, end_frame, ROUND(start_ts, 6) AS start_timestamp,
 ROUND(end_ts, 6) AS end_timestamp, end_frame - start_frame AS duration_frames, ROUND(end_ts - start_ts, 6) AS duration_seconds,
 open_at_end FROM pc"""


@query("possession_changes", LABELS + PC_SELECT)
def _changes(t):
    return shown(P.possession_changes(smoothed_labels(t)), "start_timestamp", "end_timestamp", "duration_seconds")


@query("possession_changes_tracked", TRACKED + PC_SELECT)
def _changes_tracked(t):
    return shown(P.possession_changes(smoothed_tracks(t)), "start_timestamp", "end_timestamp", "duration_seconds")


@query(
    "possession_changes_unconfirmed",
    """WITH s AS (SELECT *, LAG(raw_player) OVER (PARTITION BY match_id ORDER BY frame_number) AS prev FROM @possession_raw),
c AS (SELECT * FROM s WHERE raw_player IS DISTINCT FROM prev),
l AS (SELECT match_id, raw_player AS player_id, frame_number AS start_frame,
 LEAD(frame_number) OVER (PARTITION BY match_id ORDER BY frame_number) AS nxt FROM c),
f AS (SELECT match_id, MAX(frame_number) AS f FROM @possession_raw GROUP BY 1)
SELECT l.match_id, player_id, start_frame, coalesce(nxt, f.f) AS end_frame FROM l JOIN f USING (match_id) WHERE player_id IS NOT NULL""",
)
def _changes_raw(t):
    df = P.possession_changes(P.smooth_possession(t.possession_raw, confirm=False))
    return df.select("match_id", "player_id", "start_frame", "end_frame")


@query("three_second_violations", TRACKED + VIOLATIONS + V_SELECT)
def _violations(t):
    return shown(P.three_second_violations(smoothed_tracks(t)), *TIMES)


@query("three_second_violations_labels", LABELS + VIOLATIONS + V_SELECT)
def _violations_labels(t):
    return shown(P.three_second_violations(smoothed_labels(t)), *TIMES)


@query(
    "current_possession_duration",
    LABELS
    + """ SELECT s6.match_id, s6.frame_number, s6.smoothed AS player_id, ROUND(s6.ts_sec - ep.start_ts, 6) AS duration_seconds
 FROM s6 JOIN ep ON ep.match_id = s6.match_id AND ep.ep = s6.ep""",
)
def _duration(t):
    return shown(P.current_possession_duration(smoothed_labels(t)), "duration_seconds")


@query(
    "possession_compliance",
    LABELS
    + VIOLATIONS
    + """, v AS (SELECT match_id, COUNT(*) AS n FROM tv WHERE rn = 1 GROUP BY 1)
SELECT pc.match_id, COUNT(*) AS possessions, coalesce(MAX(v.n), 0) AS violations, COUNT(*) - coalesce(MAX(v.n), 0) AS normal
FROM pc LEFT JOIN v USING (match_id) GROUP BY 1""",
)
def _compliance(t):
    s = smoothed_labels(t)
    return P.possession_compliance(P.possession_changes(s), P.three_second_violations(s))


TEAM_CASE = "CASE WHEN {c} <= 7 THEN 'home' ELSE 'away' END"
EDGES = TRACKED + f""", ed AS (SELECT match_id, player_id AS src, LEAD(player_id) OVER w AS dst, end_frame AS frame_number,
 {TEAM_CASE.format(c='player_id')} AS team, {TEAM_CASE.format(c='LEAD(player_id) OVER w')} AS team2
 FROM pc WINDOW w AS (PARTITION BY match_id ORDER BY start_frame))"""


def edges(t):
    teams = t.players.select("match_id", F.col("track_id").alias("player_id"), "team").distinct()
    return P.pass_edges(P.possession_changes(smoothed_tracks(t)), teams)


@query(
    "pass_edges",
    EDGES + " SELECT match_id, src, dst, frame_number, CASE WHEN team = team2 THEN 'pass' ELSE 'interception' END AS kind FROM ed WHERE dst IS NOT NULL",
)
def _edges(t):
    return edges(t)


@query(
    "passing_network",
    EDGES + " SELECT match_id, src, dst, COUNT(*) AS weight FROM ed WHERE dst IS NOT NULL AND team = team2 GROUP BY 1,2,3",
)
def _network(t):
    return P.passing_network(edges(t))


@query(
    "teammate_pairs",
    """WITH p AS (SELECT DISTINCT match_id, team, track_id FROM @detections WHERE class_name='player')
SELECT a.match_id, a.team, a.track_id, b.track_id AS other_id FROM p a JOIN p b
 ON a.match_id = b.match_id AND a.team = b.team AND a.track_id < b.track_id""",
)
def _pairs(t):
    return P.teammate_pairs(t.players)


PF = ASSIGNED + f""", pf AS (SELECT d.match_id, d.frame_number, d.det_no, d.track_id, d.team, d.position,
 coalesce(d.det_no = asg.player_no, false) AS poss, {HA_SQL} AS zone
 FROM @detections d JOIN asg USING (match_id, frame_number) WHERE d.class_name = 'player')"""
OK = """(CASE WHEN zone = 'centre_third' THEN position IN ('WA','C','WD','GA','GD') ELSE position IN ('GS','GA','GK','GD') END)"""


def player_frames(t):
    a = assigned(t).select("match_id", "frame_number", F.col("player_no").alias("holder_no"))
    df = Z.with_zone(t.players, home_away=True).join(a, ["match_id", "frame_number"])
    allowed = F.when(F.col("zone") == "centre_third", F.col("position").isin("WA", "C", "WD", "GA", "GD")).otherwise(
        F.col("position").isin("GS", "GA", "GK", "GD")
    )
    return df.withColumns(
        {"is_in_possession": F.coalesce(F.col("det_no") == F.col("holder_no"), F.lit(False)), "zone_ok": allowed}
    ).drop("holder_no")


@query(
    "shooting_positions",
    PF + " SELECT match_id, frame_number, det_no, track_id, zone FROM pf WHERE poss AND zone IN ('shooting_circle_home','shooting_circle_away') AND position IN ('GS','GA')",
)
def _shooting_positions(t):
    from courtflow.operators.filters import is_shooting_position

    return is_shooting_position(player_frames(t)).select("match_id", "frame_number", "det_no", "track_id", "zone")


@query(
    "shooter_of_frame",
    ASSIGNED
    + """ SELECT asg.match_id, asg.frame_number, asg.track_id AS possession_player_id, d.det_no, d.team, d.position
 FROM asg JOIN @detections d ON d.match_id = asg.match_id AND d.frame_number = asg.frame_number AND d.track_id = asg.track_id
 WHERE d.class_name = 'player'""",
)
def _shooter(t):
    balls = assigned(t).select("match_id", "frame_number", F.col("track_id").alias("possession_player_id"))
    players = t.players.select("match_id", "frame_number", "track_id", "det_no", "team", "position")
    return P.shooter_of_frame(balls, players)


STATS = PF + f""", ps AS (SELECT match_id, track_id AS player_id, COUNT(*) FILTER (WHERE poss)/30e0 AS possession_time,
 COUNT(*) FILTER (WHERE NOT {OK}) AS zone_violations FROM pf GROUP BY 1,2),
sh AS (SELECT match_id, shooter_id AS player_id, COUNT(*) AS sa, COUNT(*) FILTER (WHERE result='goal') AS sm FROM @shots GROUP BY 1,2)"""


@query(
    "player_stats",
    STATS
    + """ SELECT match_id, player_id, ROUND(coalesce(possession_time,0e0),6) AS possession_time,
 coalesce(zone_violations,0) AS zone_violations, coalesce(sa,0) AS shots_attempted, coalesce(sm,0) AS shots_made
 FROM ps FULL JOIN sh USING (match_id, player_id)""",
)
def _player_stats(t):
    return shown(P.player_stats(player_frames(t), t.shots), "possession_time")


def _player_time(t):
    return player_frames(t).groupBy("match_id", "team").agg(
        (F.count_if(F.col("is_in_possession")) / F.lit(30.0)).alias("possession_time")
    )


TEAM = PF + """, pt AS (SELECT match_id, team, COUNT(*) FILTER (WHERE poss)/30e0 AS possession_time FROM pf GROUP BY 1,2),
sh AS (SELECT match_id, team, COUNT(*) AS shots, COUNT(*) FILTER (WHERE result='goal') AS goals FROM @shots GROUP BY 1,2)"""


@query(
    "team_stats",
    TEAM
    + """, ev AS (SELECT match_id, unnest(['home','away']) AS team, SUM(possession_time)/2e0 AS possession_time FROM pt GROUP BY 1)
SELECT match_id, team, ROUND(coalesce(possession_time,0e0),6) AS possession_time, coalesce(shots,0) AS shots, coalesce(goals,0) AS goals
 FROM ev FULL JOIN sh USING (match_id, team)""",
)
def _team_stats(t):
    return shown(P.team_stats(t.shots, _player_time(t)), "possession_time")


@query(
    "team_stats_by_team",
    TEAM
    + """ SELECT match_id, team, ROUND(coalesce(possession_time,0e0),6) AS possession_time, coalesce(shots,0) AS shots,
 coalesce(goals,0) AS goals FROM pt FULL JOIN sh USING (match_id, team)""",
)
def _team_stats_by(t):
    return shown(P.team_stats(t.shots, _player_time(t), possession="by_team"), "possession_time")


@query(
    "final_score",
    "SELECT match_id, COUNT(*) FILTER (WHERE result='goal' AND team='home') AS home_score, COUNT(*) FILTER (WHERE result='goal' AND team<>'home') AS away_score FROM @shots GROUP BY 1",
)
def _final(t):
    return P.final_score(t.shots)


@query(
    "running_score",
    """SELECT match_id, frame_number, CAST(SUM(CASE WHEN result='goal' AND team='home' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS home_score,
 CAST(SUM(CASE WHEN result='goal' AND team<>'home' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS away_score
FROM @shots WINDOW w AS (PARTITION BY match_id ORDER BY frame_number ROWS UNBOUNDED PRECEDING)""",
)
def _running(t):
    return P.running_score(t.shots).select("match_id", "frame_number", "home_score", "away_score")


@query(
    "possession_by_player",
    LABELS + " SELECT match_id, player_id, COUNT(*) AS changes, CAST(SUM(end_frame - start_frame) AS BIGINT) AS frames_held FROM pc GROUP BY 1,2",
)
def _by_player(t):
    df = P.possession_changes(smoothed_labels(t))
    return df.groupBy("match_id", "player_id").agg(
        F.count(F.lit(1)).alias("changes"), F.sum("duration_frames").alias("frames_held")
    )
