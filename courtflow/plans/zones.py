"""Zone queries."""

from pyspark.sql import functions as F

from courtflow.constants import COURT_LENGTH, COURT_WIDTH
from courtflow.operators import zones as Z
from courtflow.plans.geometry import HA_SQL, ZONE_SQL
from courtflow.plans.registry import query, shown

ZONED = f"WITH z AS (SELECT *, {ZONE_SQL} AS zone FROM @detections WHERE class_name = 'player')"
HOME_AWAY = f"WITH z AS (SELECT *, {HA_SQL} AS zone FROM @detections WHERE class_name = 'player')"
VALID = """(CASE position WHEN 'GS' THEN zone IN ('goal_circle_left','goal_third_left')
 WHEN 'GA' THEN zone IN ('goal_circle_left','goal_third_left','center_third') WHEN 'WA' THEN zone IN ('goal_third_left','center_third')
 WHEN 'C' THEN zone IN ('center_third','center_circle') WHEN 'WD' THEN zone IN ('center_third','goal_third_right')
 WHEN 'GD' THEN zone IN ('goal_third_right','center_third') WHEN 'GK' THEN zone IN ('goal_circle_right','goal_third_right') ELSE true END)"""
ALLOWED = """(CASE WHEN zone = 'centre_third' THEN position IN ('WA','C','WD','GA','GD') ELSE position IN ('GS','GA','GK','GD') END)"""
LIMIT = "CASE WHEN zone = 'centre_third' THEN 5 ELSE 4 END"
PLACES = "court_x BETWEEN 0.5e0 AND 30e0 AND court_y BETWEEN 0.5e0 AND 14.75e0"
BASE_V = f"""
v AS (SELECT match_id, frame_number, det_no, track_id AS player_id, team, position, zone, court_x, court_y,
 CASE WHEN zone = 'out_of_bounds' THEN 'out_of_bounds' WHEN NOT {VALID} THEN 'position_restriction'
  WHEN NOT ({PLACES}) THEN 'sideline_proximity' END AS violation_type FROM z),
bv AS (SELECT *, CASE violation_type WHEN 'sideline_proximity' THEN 'minor' ELSE 'major' END AS severity,
 CASE violation_type WHEN 'out_of_bounds' THEN concat('Player ', player_id, ' is out of bounds')
  WHEN 'position_restriction' THEN concat('Player ', player_id, ' (', position, ') in restricted zone ', zone)
  ELSE concat('Player ', player_id, ' too close to court boundary') END AS description FROM v WHERE violation_type IS NOT NULL)"""
ENHANCED = ZONED + "," + BASE_V + f""",
hid AS (SELECT match_id, frame_number, track_id AS player_id, 'position_restriction' AS violation_type, zone, 'major' AS severity,
 concat('Player ', track_id, ' (', position, ') in restricted zone ', zone) AS description, court_x, court_y FROM z
 WHERE NOT {VALID} AND NOT EXISTS (SELECT 1 FROM bv WHERE bv.match_id = z.match_id AND bv.frame_number = z.frame_number
  AND bv.player_id = z.track_id AND bv.violation_type = 'position_restriction')),
cnt AS (SELECT *, COUNT(*) OVER (PARTITION BY match_id, frame_number, team, zone) AS n FROM z
 WHERE zone IN ('goal_circle_left','goal_circle_right','center_circle')),
ovf AS (SELECT match_id, frame_number, track_id AS player_id,
 CASE WHEN zone = 'center_circle' THEN 'center_circle_overflow' ELSE 'goal_circle_overflow' END AS violation_type, zone,
 'critical' AS severity, concat('Team ', team, ' has ', n, ' players in ',
  CASE WHEN zone = 'center_circle' THEN 'center circle (max 1)' ELSE 'goal circle (max 2)' END) AS description, court_x, court_y
 FROM cnt WHERE n > CASE WHEN zone = 'center_circle' THEN 1 ELSE 2 END),
ev AS (SELECT match_id, frame_number, player_id, violation_type, zone, severity, description, court_x, court_y FROM bv
 UNION ALL SELECT * FROM hid UNION ALL SELECT * FROM ovf)"""


def zoned(t):
    return Z.with_zone(t.players, home_away=True)


@query(
    "zone_violations",
    ZONED + "," + BASE_V + " SELECT match_id, frame_number, player_id, violation_type, zone, severity, description FROM bv",
)
def _violations(t):
    return Z.zone_violations(t.players).select(
        "match_id", "frame_number", "player_id", "violation_type", "zone", "severity", "description"
    )


@query(
    "enhanced_zone_violations",
    ENHANCED
    + """ SELECT match_id, frame_number, ROUND(frame_number/30e0, 6) AS timestamp, player_id, violation_type, zone AS zone_name,
 severity, description, court_x, court_y FROM ev""",
)
def _enhanced(t):
    return shown(Z.enhanced_zone_violations(t.players), "timestamp")


@query(
    "overflow_violations",
    ENHANCED + " SELECT match_id, frame_number, player_id, violation_type, zone, severity, description FROM ovf",
)
def _overflow(t):
    return Z.overflow_violations(t.players).select(
        "match_id", "frame_number", "player_id", "violation_type", "zone", "severity", "description"
    )


@query(
    "violation_marginals",
    ENHANCED
    + """ SELECT match_id, 'type' AS grouping, violation_type AS value, COUNT(*) AS n FROM ev GROUP BY 1, 3
 UNION ALL SELECT match_id, 'severity', severity, COUNT(*) FROM ev GROUP BY 1, 3
 UNION ALL SELECT match_id, 'player', CAST(player_id AS VARCHAR), COUNT(*) FROM ev GROUP BY 1, 3
 UNION ALL SELECT match_id, 'zone', zone, COUNT(*) FROM ev GROUP BY 1, 3
 UNION ALL SELECT match_id, 'frame', CAST(frame_number AS VARCHAR), COUNT(*) FROM ev GROUP BY 1, 3
 UNION ALL SELECT match_id, 'total', 'all', COUNT(*) FROM ev GROUP BY 1""",
)
def _marginals(t):
    return Z.violation_marginals(Z.enhanced_zone_violations(t.players))


@query(
    "violation_recommendations",
    ENHANCED
    + """ , m AS (SELECT DISTINCT match_id AS m FROM @detections WHERE class_name = 'player')
SELECT m AS match_id, CASE WHEN COUNT(violation_type) = 0 THEN 'No zone violations detected - system working correctly' ELSE concat_ws(' | ',
 CASE WHEN COUNT(*) FILTER (WHERE violation_type='out_of_bounds') > 0 THEN 'High out-of-bounds violations - check court boundary calibration' END,
 CASE WHEN COUNT(*) FILTER (WHERE violation_type='goal_circle_overflow') > 0 THEN 'Goal circle overflow violations - implement team counting logic' END,
 CASE WHEN COUNT(*) FILTER (WHERE violation_type='center_circle_overflow') > 0 THEN 'Center circle overflow violations - implement team counting logic' END,
 CASE WHEN COUNT(*) FILTER (WHERE violation_type='position_restriction') > 0 THEN 'Position restriction violations - improve position detection accuracy' END,
 CASE WHEN COUNT(*) FILTER (WHERE severity='critical') > COUNT(*)*0.5e0 THEN 'High number of critical violations - review rule implementation' END
 ) END AS recommendations FROM m LEFT JOIN ev ON match_id = m GROUP BY m""",
)
def _recommend(t):
    df = Z.violation_recommendations(Z.enhanced_zone_violations(t.players), t.players)
    return df.select("match_id", F.array_join("recommendations", " | ").alias("recommendations"))


@query(
    "zone_rule_violations",
    HOME_AWAY + f" SELECT match_id, frame_number, track_id, position, zone FROM z WHERE NOT {ALLOWED}",
)
def _rule(t):
    return Z.zone_rule_violations(zoned(t)).select("match_id", "frame_number", "track_id", "position", "zone")


@query(
    "max_players_violations",
    HOME_AWAY
    + f""" SELECT match_id, frame_number, zone, COUNT(*) AS current_count,
 array_to_string(list_sort(list(track_id)), ',') AS players FROM z GROUP BY 1,2,3 HAVING COUNT(*) > {LIMIT}""",
)
def _max_players(t):
    return Z.max_players_violations(zoned(t)).select(
        "match_id", "frame_number", "zone", "current_count", F.array_join(F.col("players").cast("array<string>"), ",").alias("players")
    )


@query(
    "home_away_zone_violations",
    HOME_AWAY
    + f""" SELECT match_id, frame_number, 'position_not_allowed' AS violation_type, zone, track_id AS player_id, position,
 CAST(NULL AS BIGINT) AS current_count, CAST(NULL AS BIGINT) AS max_players FROM z WHERE NOT {ALLOWED}
 UNION ALL SELECT match_id, frame_number, 'max_players_exceeded', zone, NULL, NULL, COUNT(*), {LIMIT} FROM z
 GROUP BY match_id, frame_number, zone HAVING COUNT(*) > {LIMIT}""",
)
def _home_away(t):
    return Z.home_away_zone_violations(zoned(t))


@query("position_validity", ZONED + f" SELECT match_id, frame_number, det_no, position, zone, {VALID} AS valid FROM z")
def _validity(t):
    from courtflow.functions.court import is_position_valid

    return Z.with_zone(t.players).select(
        "match_id", "frame_number", "det_no", "position", "zone", is_position_valid("position", "zone").alias("valid")
    )


@query("zone_occupancy", ZONED + " SELECT match_id, frame_number, zone, COUNT(*) AS players FROM z GROUP BY 1,2,3")
def _occupancy(t):
    return Z.zone_occupancy(t.players)


@query(
    "zone_team_stats",
    HOME_AWAY
    + """, g AS (SELECT f.match_id, f.frame_number, d.zone FROM @frames f CROSS JOIN (VALUES ('goal_third_home'),('centre_third'),
  ('goal_third_away'),('shooting_circle_home'),('shooting_circle_away')) d(zone))
SELECT g.match_id, g.frame_number, g.zone, COUNT(z.det_no) AS player_count,
 coalesce(array_to_string(list_sort(list(z.track_id) FILTER (WHERE z.det_no IS NOT NULL)), ','), '') AS player_ids,
 COUNT(*) FILTER (WHERE z.team = 'home') AS home, COUNT(*) FILTER (WHERE z.team = 'away') AS away
FROM g LEFT JOIN z ON z.match_id = g.match_id AND z.frame_number = g.frame_number AND z.zone = g.zone GROUP BY 1,2,3""",
)
def _team_stats(t):
    df = Z.zone_team_stats(zoned(t), t.frames)
    return df.withColumn("player_ids", F.array_join(F.col("player_ids").cast("array<string>"), ","))


@query(
    "zone_transitions_between",
    HOME_AWAY
    + """ SELECT a.match_id, a.track_id, a.zone AS from_zone, b.zone AS to_zone, b.team FROM z a JOIN z b
 ON a.match_id = b.match_id AND a.track_id = b.track_id AND b.frame_number = a.frame_number + 1
 WHERE a.zone IS DISTINCT FROM b.zone""",
)
def _between(t):
    z = zoned(t)
    # every frame against the next one: the frame number becomes part of the match key
    key = F.concat_ws(":", F.col("match_id"), F.col("frame_number"))
    before = z.withColumn("m", F.col("match_id")).withColumn("match_id", key)
    after = z.withColumn("match_id", F.concat_ws(":", F.col("match_id"), F.col("frame_number") - 1))
    return Z.zone_transitions_between(before, after).withColumn(
        "match_id", F.split("match_id", ":")[0].cast("long")
    )


@query(
    "zone_transitions",
    ZONED
    + """, l AS (SELECT *, LAG(zone) OVER (PARTITION BY match_id, track_id ORDER BY frame_number, det_no) AS from_zone FROM z)
SELECT match_id, track_id, frame_number, det_no, from_zone, zone AS to_zone FROM l WHERE from_zone <> zone""",
)
def _transitions(t):
    return Z.zone_transitions(t.players)


@query(
    "zone_transition_summary",
    ZONED
    + """, l AS (SELECT *, LAG(zone) OVER (PARTITION BY match_id, track_id ORDER BY frame_number, det_no) AS from_zone FROM z)
SELECT match_id, track_id, COUNT(*) FILTER (WHERE from_zone <> zone) AS total_transitions,
 array_to_string(list_sort(list_distinct(list(zone))), ',') AS zones_visited FROM l GROUP BY 1,2 HAVING COUNT(*) >= 2""",
)
def _transition_summary(t):
    df = Z.zone_transition_summary(t.players)
    return df.withColumn("zones_visited", F.array_join("zones_visited", ","))


@query(
    "heatmap",
    HOME_AWAY
    + """ SELECT match_id, CAST(CASE WHEN zone LIKE '%_home' THEN 3 WHEN zone LIKE '%_away' THEN 16 ELSE 10 END AS BIGINT) AS grid_x,
 CAST(10 AS BIGINT) AS grid_y, COUNT(*) AS n FROM z GROUP BY 1,2,3""",
)
def _heatmap(t):
    return Z.heatmap(zoned(t))


@query(
    "heatmap_binned",
    """WITH g AS (SELECT match_id, CAST(floor(court_x/(30.5e0/20)) AS BIGINT) AS grid_x, CAST(floor(court_y/(15.25e0/20)) AS BIGINT) AS grid_y
 FROM @detections WHERE class_name='player')
SELECT match_id, grid_x, grid_y, COUNT(*) AS n FROM g WHERE grid_x BETWEEN 0 AND 19 AND grid_y BETWEEN 0 AND 19 GROUP BY 1,2,3""",
)
def _heatmap_binned(t):
    return Z.heatmap_binned(t.players, COURT_LENGTH, COURT_WIDTH)


@query(
    "zone_distribution",
    ZONED + " SELECT match_id, zone, COUNT(*) AS n, ROUND(COUNT(*)/CAST(SUM(COUNT(*)) OVER (PARTITION BY match_id) AS DOUBLE)*100e0, 6) AS percentage FROM z GROUP BY 1, 2",
)
def _distribution(t):
    return shown(Z.zone_distribution(Z.with_zone(t.players)), "percentage")


@query(
    "zone_by_position",
    """SELECT position, CASE WHEN position IN ('GS','GA') THEN 'shooting_circle_home'
 WHEN position IN ('GD','GK') THEN 'shooting_circle_away' ELSE 'centre_third' END AS zone, COUNT(*) AS n
FROM @detections WHERE class_name = 'player' GROUP BY 1,2""",
)
def _by_position(t):
    from courtflow.functions.court import zone_for_position

    return t.players.groupBy("position", zone_for_position("position").alias("zone")).agg(F.count(F.lit(1)).alias("n"))
