"""Geometry, filter and scalar-function queries."""

from pyspark.sql import functions as F

from courtflow.functions import court as C
from courtflow.functions import geometry as G
from courtflow.functions import shots as H
from courtflow.functions import text as X
from courtflow.functions.service import eta_seconds, pagination_info
from courtflow.operators import filters as D
from courtflow.plans.registry import query, shown

KEY = ["match_id", "frame_number", "det_no"]
K = "match_id, frame_number, det_no"

ZONE_SQL = """CASE WHEN NOT (court_x BETWEEN 0 AND 30.5e0 AND court_y BETWEEN 0 AND 15.25e0) THEN 'out_of_bounds'
 WHEN sqrt(court_x*court_x + (court_y-7.625e0)*(court_y-7.625e0)) <= 4.9e0 THEN 'goal_circle_left'
 WHEN sqrt((court_x-30.5e0)*(court_x-30.5e0) + (court_y-7.625e0)*(court_y-7.625e0)) <= 4.9e0 THEN 'goal_circle_right'
 WHEN sqrt((court_x-15.25e0)*(court_x-15.25e0) + (court_y-7.625e0)*(court_y-7.625e0)) <= 0.9e0 THEN 'center_circle'
 WHEN court_x <= 30.5e0/3 THEN 'goal_third_left'
 WHEN court_x <= 2*(30.5e0/3) THEN 'center_third' ELSE 'goal_third_right' END"""
HA_SQL = """CASE WHEN court_x < 30.5e0/3 THEN
   CASE WHEN sqrt((court_x-30.5e0/3/2)*(court_x-30.5e0/3/2)+(court_y-7.625e0)*(court_y-7.625e0)) <= 4.9e0
   THEN 'shooting_circle_home' ELSE 'goal_third_home' END
 WHEN court_x > 2*(30.5e0/3) THEN
   CASE WHEN sqrt((court_x-2.5e0*(30.5e0/3))*(court_x-2.5e0*(30.5e0/3))+(court_y-7.625e0)*(court_y-7.625e0)) <= 4.9e0
   THEN 'shooting_circle_away' ELSE 'goal_third_away' END
 ELSE 'centre_third' END"""

BP_JOIN = """
FROM @detections b JOIN @detections p ON b.match_id = p.match_id AND b.frame_number = p.frame_number
WHERE b.class_name = 'ball' AND p.class_name = 'player'"""
IOU_SQL = """CASE WHEN least(b.x2,p.x2) > greatest(b.x1,p.x1) AND least(b.y2,p.y2) > greatest(b.y1,p.y1) THEN
 (least(b.x2,p.x2)-greatest(b.x1,p.x1))*(least(b.y2,p.y2)-greatest(b.y1,p.y1)) /
 ((b.x2-b.x1)*(b.y2-b.y1)+(p.x2-p.x1)*(p.y2-p.y1)
  -(least(b.x2,p.x2)-greatest(b.x1,p.x1))*(least(b.y2,p.y2)-greatest(b.y1,p.y1))) ELSE 0e0 END"""
DIST_SQL = """sqrt(((b.x1+b.x2)/2-(p.x1+p.x2)/2)*((b.x1+b.x2)/2-(p.x1+p.x2)/2)
 +((b.y1+b.y2)/2-(p.y1+p.y2)/2)*((b.y1+b.y2)/2-(p.y1+p.y2)/2))"""
CONTAIN_SQL = """CASE WHEN (b.x1+b.x2)/2 BETWEEN p.x1 AND p.x2 AND (b.y1+b.y2)/2 BETWEEN p.y1 AND p.y2 THEN 1e0 ELSE
 greatest(0e0, 1e0 - sqrt(
  greatest(0e0, p.x1-(b.x1+b.x2)/2, (b.x1+b.x2)/2-p.x2)*greatest(0e0, p.x1-(b.x1+b.x2)/2, (b.x1+b.x2)/2-p.x2)
 +greatest(0e0, p.y1-(b.y1+b.y2)/2, (b.y1+b.y2)/2-p.y2)*greatest(0e0, p.y1-(b.y1+b.y2)/2, (b.y1+b.y2)/2-p.y2))
 / greatest(p.x2-p.x1, p.y2-p.y1)) END"""


def pairs(t):
    """Ball-player pairs of a frame with prefixed box columns."""

    def side(df, p):
        return df.select(
            "match_id", "frame_number", F.col("det_no").alias(p + "no"), *[F.col(c).alias(p + c) for c in G.BOX]
        )

    return side(t.balls, "b_").join(side(t.players, "p_"), ["match_id", "frame_number"])


@query(
    "bbox_metrics",
    f"""SELECT {K}, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, x2-x1 AS width, y2-y1 AS height, (x2-x1)*(y2-y1) AS area,
 ROUND(CASE WHEN class_name = 'ball' THEN (x2-x1)/(y2-y1) ELSE (y2-y1)/(x2-x1) END, 6) AS aspect FROM @detections""",
)
def _bbox_metrics(t):
    b = G.box()
    df = t.detections.select(
        *KEY,
        G.center_x(b).alias("cx"),
        G.center_y(b).alias("cy"),
        G.width(b).alias("width"),
        G.height(b).alias("height"),
        G.area(b).alias("area"),
        F.when(F.col("class_name") == "ball", G.aspect_wh(b)).otherwise(G.aspect_hw(b)).alias("aspect"),
    )
    return shown(df, "aspect")


@query(
    "ball_player_geometry",
    f"""SELECT b.match_id, b.frame_number, b.det_no AS ball_no, p.det_no AS player_no, ROUND({IOU_SQL}, 6) AS iou,
 ROUND(CASE WHEN least(b.x2,p.x2) > greatest(b.x1,p.x1) AND least(b.y2,p.y2) > greatest(b.y1,p.y1) THEN
 (least(b.x2,p.x2)-greatest(b.x1,p.x1))*(least(b.y2,p.y2)-greatest(b.y1,p.y1)) / ((b.x2-b.x1)*(b.y2-b.y1)) ELSE 0e0 END, 6)
 AS overlap_fraction, ROUND({DIST_SQL}, 6) AS distance, ROUND({CONTAIN_SQL}, 6) AS containment {BP_JOIN}""",
)
def _pair_geometry(t):
    b, p = G.box("b_"), G.box("p_")
    df = pairs(t).select(
        "match_id",
        "frame_number",
        F.col("b_no").alias("ball_no"),
        F.col("p_no").alias("player_no"),
        G.iou(b, p).alias("iou"),
        G.overlap_fraction(b, p).alias("overlap_fraction"),
        G.euclidean(G.center_x(b), G.center_y(b), G.center_x(p), G.center_y(p)).alias("distance"),
        G.ball_containment(b, p).alias("containment"),
    )
    return shown(df, "iou", "overlap_fraction", "distance", "containment")


@query(
    "zone_classification",
    f"SELECT {K}, {ZONE_SQL} AS zone, {HA_SQL} AS zone_home_away, "
    "court_x BETWEEN 0 AND 30.5e0 AND court_y BETWEEN 0 AND 15.25e0 AS on_court, "
    "court_x BETWEEN 0.5e0 AND 30e0 AND court_y BETWEEN 0.5e0 AND 14.75e0 AS in_margin FROM @detections",
)
def _zone_classification(t):
    return t.detections.select(
        *KEY,
        C.classify_zone("court_x", "court_y").alias("zone"),
        C.classify_zone_home_away("court_x", "court_y").alias("zone_home_away"),
        C.is_on_court("court_x", "court_y").alias("on_court"),
        C.in_court_margin("court_x", "court_y").alias("in_margin"),
    )


RANGE_D = "CASE WHEN court_x < 15 THEN dl ELSE dr END"


@query(
    "shooting_range",
    f"""WITH d AS (SELECT {K}, court_x, court_y, sqrt(court_x*court_x+(court_y-7.5e0)*(court_y-7.5e0)) AS dl,
 sqrt((court_x-30)*(court_x-30)+(court_y-7.5e0)*(court_y-7.5e0)) AS dr FROM @detections)
SELECT {K}, concat(CASE WHEN court_x < 15 THEN 'left_' ELSE 'right_' END,
 CASE WHEN {RANGE_D} <= 4.9e0 THEN 'goal_circle' WHEN {RANGE_D} <= 4.9e0*1.5e0 THEN 'close_range'
 WHEN {RANGE_D} <= 4.9e0*2.5e0 THEN 'medium_range' ELSE 'long_range' END) AS range_zone,
 ROUND(least(dl, dr), 6) AS goal_distance,
 ROUND(degrees(atan2(abs(court_y-7.5e0), abs(court_x - CASE WHEN dl < dr THEN 0 ELSE 30 END))), 6) AS goal_angle FROM d""",
)
def _shooting_range(t):
    df = t.detections.select(
        *KEY,
        H.shooting_range_zone("court_x", "court_y").alias("range_zone"),
        H.nearest_goal_distance("court_x", "court_y").alias("goal_distance"),
        H.nearest_goal_angle("court_x", "court_y").alias("goal_angle"),
    )
    return shown(df, "goal_distance", "goal_angle")


@query(
    "shot_scores",
    """WITH s AS (SELECT frame_number, match_id, position, distance_to_goal AS d, abs(angle_to_goal) AS a,
 team, ball_x, ball_y FROM @shots)
SELECT match_id, frame_number,
 ROUND(greatest(0e0, least(1e0, 0.5e0 + CASE WHEN d < 3 THEN 0.2e0 WHEN d > 6 THEN -0.2e0 ELSE 0e0 END
  + CASE WHEN a < 30 THEN 0.1e0 WHEN a > 60 THEN -0.1e0 ELSE 0e0 END
  + CASE position WHEN 'GS' THEN 0.1e0 WHEN 'GA' THEN 0.05e0 ELSE 0e0 END)), 6) AS confidence_prior,
 ROUND(0.6e0 * CASE WHEN d > 5 THEN 0.8e0 WHEN d < 2 THEN 1.2e0 ELSE 1e0 END
  * CASE WHEN a > 45 THEN 0.9e0 ELSE 1e0 END * CASE WHEN position = 'GS' THEN 1.1e0 ELSE 1e0 END, 6) AS success_probability,
 ROUND(sqrt((ball_x - CASE WHEN team='home' THEN 25.4e0 ELSE 5.1e0 END)*(ball_x - CASE WHEN team='home' THEN 25.4e0 ELSE 5.1e0 END)
  + (ball_y-7.6e0)*(ball_y-7.6e0)), 6) AS distance_to_posts,
 ROUND(degrees(atan2(7.6e0-ball_y, CASE WHEN team='home' THEN 25.4e0 ELSE 5.1e0 END - ball_x)), 6) AS angle_to_posts FROM s""",
)
def _shot_scores(t):
    goals = ((5.1, 7.6), (25.4, 7.6))
    df = t.shots.select(
        "match_id",
        "frame_number",
        H.shot_confidence_prior("distance_to_goal", "angle_to_goal", "position").alias("confidence_prior"),
        H.shot_success_probability("distance_to_goal", "angle_to_goal", "position").alias("success_probability"),
        H.distance_to_goal("team", "ball_x", "ball_y", *goals).alias("distance_to_posts"),
        H.angle_to_goal("team", "ball_x", "ball_y", *goals).alias("angle_to_posts"),
    )
    return shown(df, "confidence_prior", "success_probability", "distance_to_posts", "angle_to_posts")


@query(
    "circle_shot_geometry",
    """WITH s AS (SELECT match_id, frame_number, ball_x, ball_y, distance_to_goal AS bpd,
  CASE WHEN team = 'home' THEN 30.5e0 ELSE 0e0 END AS gx FROM @shots),
e AS (SELECT *, greatest(0e0, sqrt((ball_x-gx)*(ball_x-gx)+(ball_y-7.625e0)*(ball_y-7.625e0)) - 4.9e0) AS edge FROM s)
SELECT match_id, frame_number, ROUND(edge, 6) AS shot_distance,
 ROUND(degrees(atan2(7.625e0-ball_y, gx-ball_x)), 6) AS shot_angle,
 ROUND(greatest(0e0, 1e0-bpd/30e0)*0.6e0 + CASE WHEN edge < 2 THEN 1e0 ELSE greatest(0e0, 1e0-(edge-2e0)/3e0) END*0.4e0, 6)
  AS attempt_confidence FROM e""",
)
def _circle_geometry(t):
    circle = F.when(F.col("team") == "home", "shooting_circle_right").otherwise("shooting_circle_left")
    edge = H.shot_distance_edge(circle, "ball_x", "ball_y")
    df = t.shots.select(
        "match_id",
        "frame_number",
        edge.alias("shot_distance"),
        H.shot_angle(circle, "ball_x", "ball_y").alias("shot_angle"),
        H.shot_attempt_confidence("distance_to_goal", edge).alias("attempt_confidence"),
    )
    return shown(df, "shot_distance", "shot_angle", "attempt_confidence")


W, HT = "(x2-x1)", "(y2-y1)"


def _keys(df):
    return df.select(*KEY)


@query(
    "filter_players",
    f"SELECT {K} FROM @detections WHERE class_name IN ('player', 'referee') AND {W}*{HT} BETWEEN 900 AND 60000 AND {HT}/{W} >= 1.1e0 AND {W} > 16 AND {HT} > 32",
)
def _fp(t):
    return _keys(D.filter_players(t.detections))


@query(
    "filter_balls",
    f"SELECT {K} FROM @detections WHERE class_name = 'ball' AND confidence >= 0.3e0 AND {W}*{HT} BETWEEN 500 AND 3000 AND {HT}/{W} BETWEEN 0.8e0 AND 1.5e0 AND {W} BETWEEN 10 AND 100 AND {HT} BETWEEN 10 AND 100",
)
def _fb(t):
    return _keys(D.filter_balls(t.detections))


@query(
    "filter_hoops",
    f"SELECT {K} FROM @detections WHERE class_name='hoop' AND y1 >= 72 AND x1 BETWEEN 25.6e0 AND 1254.4e0 AND {W}*{HT} > 1000 AND {W}*{HT} < 100000 AND {HT}/{W} > 0.3e0 AND {HT}/{W} < 5 AND {HT} > 20 AND {W} > 10",
)
def _fh(t):
    return _keys(D.filter_hoops(t.hoops))


@query(
    "filter_numbers",
    f"SELECT {K} FROM @detections WHERE {W}*{HT} BETWEEN 20 AND 2000 AND {W}/{HT} BETWEEN 0.3e0 AND 3 AND {W} > 5 AND {HT} > 5 AND {W} < 100 AND {HT} < 100",
)
def _fn(t):
    return _keys(D.filter_numbers(t.detections))


@query(
    "filter_ball_reads",
    f"SELECT {K} FROM @detections WHERE class_name='ball' AND confidence > 0.3e0 AND {W} BETWEEN 10 AND 100 AND {HT} BETWEEN 10 AND 100 AND {W}/{HT} BETWEEN 0.5e0 AND 2e0",
)
def _fbr(t):
    return _keys(D.filter_ball_reads(t.balls))


@query(
    "drop_off_court",
    f"SELECT {K} FROM @detections WHERE class_name <> 'player' OR (court_x BETWEEN 0.5e0 AND 30e0 AND court_y BETWEEN 0.5e0 AND 14.75e0)",
)
def _doc(t):
    return _keys(D.drop_off_court(t.detections))


@query(
    "balls_not_on_bodies",
    f"""SELECT {K} FROM @detections b WHERE class_name = 'ball' AND NOT EXISTS (SELECT 1 FROM @detections p
 WHERE p.class_name = 'player' AND p.match_id = b.match_id AND p.frame_number = b.frame_number
 AND (b.x1+b.x2)/2 BETWEEN p.x1 AND p.x2 AND (b.y1+b.y2)/2 BETWEEN p.y1 AND p.y2
 AND ((b.y1+b.y2)/2 - p.y1)/(p.y2-p.y1) > 0.1e0)""",
)
def _bnb(t):
    return _keys(D.balls_not_on_bodies(t.balls, t.players))


@query("frame_range", f"SELECT {K} FROM @detections WHERE frame_number >= 45 AND frame_number < 240 AND frame_number < 195")
def _frame_range(t):
    return _keys(D.frame_range(t.detections, 1.5, 8.0, max_frames=150))


@query(
    "normalise_fps",
    """WITH f AS (SELECT match_id, frame_number, CAST(frame_number % 130 - 5 AS DOUBLE) AS fps FROM @frames),
g AS (SELECT match_id, frame_number, CASE WHEN fps <= 0 OR fps > 100 THEN 30e0 ELSE fps END AS fps FROM f)
SELECT match_id, frame_number, fps, ROUND(frame_number / fps, 6) AS ts_sec FROM g""",
)
def _fps(t):
    df = t.frames.select("match_id", "frame_number", (F.col("frame_number") % 130 - 5).cast("double").alias("fps"))
    return shown(D.normalise_fps(df), "ts_sec")


@query(
    "pagination_info",
    """SELECT o_custkey % 20 AS owner, COUNT(*) AS total, CAST(2 AS BIGINT) AS page, CAST(50 AS BIGINT) AS page_size,
 CAST(floor((COUNT(*)+49)/50e0) AS BIGINT) AS total_pages, 2 < floor((COUNT(*)+49)/50e0) AS has_next, true AS has_prev
FROM @orders GROUP BY 1""",
)
def _pages(t):
    total = t.orders.groupBy((F.col("o_custkey") % 20).alias("owner")).agg(F.count(F.lit(1)).alias("total"))
    return total.withColumns(pagination_info("total", 2, 50))


@query(
    "eta_seconds",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_custkey % 101 > 0 AND o_custkey % 101 < 100 THEN
 CAST(floor((100e0 - o_custkey % 101)/(o_custkey % 101)*300e0) AS BIGINT) END AS eta FROM @orders""",
)
def _eta(t):
    status = F.when(F.col("o_orderstatus") == "O", "processing").otherwise("completed")
    return t.orders.select("o_orderkey", eta_seconds(status, (F.col("o_custkey") % 101).cast("double")).alias("eta"))


@query(
    "color_distances",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey % 256 AS r, l_suppkey * 3 % 256 AS g, l_orderkey % 256 AS b FROM @lineitem),
n AS (SELECT *, greatest(r,g,b)/255e0 AS v, least(r,g,b)/255e0 AS lo, r/255e0 AS rr, g/255e0 AS gg, b/255e0 AS bb FROM c),
h AS (SELECT *, CASE WHEN v = lo THEN 0e0 ELSE (v-lo)/v END AS s, CASE WHEN v = lo THEN 0e0 ELSE
  CASE WHEN rr = v THEN (v-bb)/(v-lo)-(v-gg)/(v-lo) WHEN gg = v THEN 2e0+(v-rr)/(v-lo)-(v-bb)/(v-lo)
   ELSE 4e0+(v-gg)/(v-lo)-(v-rr)/(v-lo) END / 6e0 END AS h6 FROM n),
w AS (SELECT *, abs(h6 - floor(h6) - 0e0) AS dh FROM h)
SELECT l_orderkey, l_linenumber, ROUND(sqrt((r-255e0)*(r-255e0)+g*1e0*g+b*1e0*b), 6) AS rgb_distance,
 ROUND(sqrt(least(dh,1e0-dh)*least(dh,1e0-dh)+(s-1e0)*(s-1e0)+(v-1e0)*(v-1e0)), 6) AS hsv_distance FROM w""",
)
def _colors(t):
    c = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_partkey") % 256).alias("r"),
        (F.col("l_suppkey") * 3 % 256).alias("g"),
        (F.col("l_orderkey") % 256).alias("b"),
    )
    red = (F.lit(255), F.lit(0), F.lit(0))
    df = c.select(
        "l_orderkey",
        "l_linenumber",
        X.color_distance_rgb(("r", "g", "b"), red).alias("rgb_distance"),
        X.color_distance_hsv(("r", "g", "b"), red).alias("hsv_distance"),
    )
    return shown(df, "rgb_distance", "hsv_distance")
