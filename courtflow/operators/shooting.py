"""Shot attempts, outcomes and shooting statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtflow.constants import COURT_LENGTH, COURT_WIDTH, GOAL_CIRCLE_RADIUS
from courtflow.functions import geometry as G
from courtflow.functions.geometry import safe_div
from courtflow.functions.shots import (
    circle_centre_x,
    shot_angle,
    shot_attempt_confidence,
    shot_distance_edge,
    shot_success_probability,
)
from courtflow.operators.ordered import CHUNK_FRAMES, last_before, with_lookback

FRAME = ["match_id", "frame_number"]
TRAJECTORY_POINTS = 30


def best_ball_per_frame(balls: DataFrame) -> DataFrame:
    """The most confident ball of each frame; ties keep the first detection.
    An aggregate, so no frame is sorted."""
    cols = [c for c in balls.columns if c not in FRAME]
    best = F.max_by(F.struct(*cols), F.struct(F.col("confidence"), -F.col("det_no"))).alias("b")
    return balls.groupBy(*FRAME).agg(best).select(*FRAME, "b.*")


def ball_points(balls: DataFrame) -> DataFrame:
    """One ball centre per frame: match_id, frame_number, ts_sec, x, y."""
    b = G.box()
    return best_ball_per_frame(balls).select(
        *FRAME, "ts_sec", G.center_x(b).alias("x"), G.center_y(b).alias("y")
    )


def _centre_distance(a: str, b: str):
    x, y = G.box(a), G.box(b)
    return G.euclidean(G.center_x(x), G.center_y(x), G.center_x(y), G.center_y(y))


def _boxes(df, prefix, *extra):
    return df.select(
        *FRAME,
        F.col("det_no").alias(prefix + "no"),
        *[F.col(c).alias(prefix + c) for c in (*G.BOX, *extra)],
    )


def nearest_player(balls: DataFrame, players: DataFrame) -> DataFrame:
    """The closest player to each ball of a frame."""
    d = _boxes(balls, "b_").join(_boxes(players, "p_", "track_id", "confidence"), FRAME)
    d = d.withColumn("distance", _centre_distance("b_", "p_"))
    near = F.min_by(F.struct("p_no", "p_track_id", "p_confidence", "distance"), F.struct("distance", "p_no"))
    return d.groupBy(*FRAME, F.col("b_no").alias("ball_no")).agg(near.alias("n")).select(
        *FRAME,
        "ball_no",
        F.col("n.p_no").alias("player_no"),
        F.col("n.p_track_id").alias("track_id"),
        F.col("n.p_confidence").alias("confidence"),
        F.col("n.distance").alias("distance_to_ball"),
    )


def shot_outcome_by_hoop_radius(balls: DataFrame, hoops: DataFrame) -> DataFrame:
    """Closest hoop per ball: a goal within 1.2 radii, unknown without hoops."""
    b = _boxes(balls, "b_")
    d = b.join(_boxes(hoops, "h_"), FRAME).withColumn("distance", _centre_distance("b_", "h_"))
    hoop = G.box("h_")
    radius = F.greatest(G.width(hoop), G.height(hoop)) / F.lit(2.0)
    near = (
        d.withColumn("radius", radius)
        .groupBy(*FRAME, "b_no")
        .agg(F.min_by(F.struct("h_no", "distance", "radius"), F.struct("distance", "h_no")).alias("n"))
    )
    out = b.select(*FRAME, "b_no").join(near, [*FRAME, "b_no"], "left")
    dist, r = F.col("n.distance"), F.col("n.radius")
    goal = dist < r * F.lit(1.2)
    return out.select(
        *FRAME,
        F.col("b_no").alias("ball_no"),
        F.col("n.h_no").alias("hoop_no"),
        dist.alias("hoop_proximity"),
        F.when(dist.isNull(), "unknown").when(goal, "goal").otherwise("miss").alias("result"),
        F.when(dist.isNull(), F.lit(0.0))
        .when(goal, F.greatest(F.lit(0.7), F.lit(1.0) - safe_div(dist, r)))
        .otherwise(F.least(F.lit(0.8), safe_div(dist, r * F.lit(3.0), None)))
        .alias("confidence"),
    )


def shot_outcome_by_proximity(
    attempts: DataFrame, balls: DataFrame, hoops: DataFrame, min_hoop_confidence: float = 0.5
) -> DataFrame:
    """Outcome of attempts (match_id, frame_number, player_id, shooting_circle) from
    the balls of that frame around the hoop nearest the target, in court metres."""
    a = attempts.select(*FRAME, "player_id", "shooting_circle")
    hx = hoops.filter(F.col("confidence") >= min_hoop_confidence).select(
        *FRAME, F.col("det_no").alias("hoop_no"), F.col("court_x").alias("hx"), F.col("court_y").alias("hy")
    )
    to_target = G.euclidean("hx", "hy", circle_centre_x("shooting_circle"), F.lit(COURT_WIDTH / 2))
    hoop = (
        a.join(hx, FRAME)
        .withColumn("off", to_target)
        .groupBy(*FRAME, "player_id", "shooting_circle")
        .agg(F.min_by(F.struct("hoop_no", "hx", "hy"), F.struct("off", "hoop_no")).alias("h"))
    )
    bx = balls.select(*FRAME, F.col("court_x").alias("bx"), F.col("court_y").alias("by"))
    gap = (
        hoop.join(bx, FRAME)
        .groupBy(*FRAME, "player_id", "shooting_circle")
        .agg(F.min(G.euclidean("bx", "by", "h.hx", "h.hy")).alias("gap"), F.first("h.hoop_no").alias("hoop_no"))
    )
    out = a.join(gap, [*FRAME, "player_id", "shooting_circle"], "left")
    gap_c = F.col("gap")
    return out.select(
        *FRAME,
        "player_id",
        "shooting_circle",
        "hoop_no",
        gap_c.alias("ball_hoop_distance"),
        F.when(gap_c.isNull(), "unknown").when(gap_c < 2.0, "goal").otherwise("miss").alias("result"),
        F.when(gap_c.isNull(), F.lit(0.3))
        .when(gap_c < 2.0, F.greatest(F.lit(0.5), F.lit(1.0) - gap_c / F.lit(2.0)))
        .otherwise(F.lit(0.7))
        .alias("confidence"),
    )


def ball_velocity(points: DataFrame, threshold: float = 2.0, size: int = CHUNK_FRAMES) -> DataFrame:
    """Mean speed of the last two steps, and whether it looks like a shot: three
    points, faster than the threshold, and higher (smaller y) than two points ago."""

    def steps(df, w):
        dt = F.col("ts_sec") - F.lag("ts_sec").over(w)
        dist = G.euclidean("x", "y", F.lag("x").over(w), F.lag("y").over(w))
        df = df.withColumn("step", F.when(dt > 0, dist / F.when(dt > 0, dt)))
        near = w.rowsBetween(-1, 0)
        return df.withColumns(
            {
                "rise": F.col("y") - F.lag("y", 2).over(w),
                "velocity": F.avg("step").over(near),
                "points": F.count(F.lit(1)).over(w.rowsBetween(-2, 0)),
            }
        )

    d = with_lookback(points, ["match_id"], ["frame_number"], 2, steps, size)
    full = F.col("points") == 3
    d = d.withColumn("velocity", F.when(full, F.coalesce("velocity", F.lit(0.0))).otherwise(F.lit(0.0)))
    shot = full & (F.col("velocity") > threshold) & (F.col("rise") < 0)
    return d.withColumns(
        {
            "is_shot": F.coalesce(shot, F.lit(False)),
            "confidence": F.when(shot, F.least(F.col("velocity") / F.lit(10.0), F.lit(1.0))).otherwise(F.lit(0.0)),
        }
    ).drop("step", "rise", "points")


def velocity_shots(points: DataFrame, threshold: float = 2.0, size: int = CHUNK_FRAMES) -> DataFrame:
    return ball_velocity(points, threshold, size).filter("is_shot").drop("is_shot")


def trajectory_quality(points: DataFrame, window: int = TRAJECTORY_POINTS, size: int = CHUNK_FRAMES) -> DataFrame:
    """Speed profile, smoothness 1 / (1 + variance) and sharp turns over the last
    ``window`` points; zero / empty with fewer than five points."""

    def walk(df, w):
        dt = F.col("ts_sec") - F.lag("ts_sec").over(w)
        df = df.withColumns({"dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w), "dt": dt})
        df = df.withColumn(
            "step", F.when(F.col("dt") > 0, G.euclidean("dx", "dy", 0, 0) / F.when(F.col("dt") > 0, F.col("dt")))
        )
        px, py = F.lag("dx").over(w), F.lag("dy").over(w)
        m1, m2 = F.sqrt(px * px + py * py), F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
        cos = safe_div(px * F.col("dx") + py * F.col("dy"), m1 * m2, None)
        angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))
        df = df.withColumn("turn", F.when((m1 > 0) & (m2 > 0) & (angle > 30), 1).otherwise(0))
        steps = w.rowsBetween(-(window - 2), 0)
        return df.withColumns(
            {
                "points": F.count(F.lit(1)).over(w.rowsBetween(-(window - 1), 0)),
                "velocity_profile": F.collect_list("step").over(steps),
                "variance": F.var_pop("step").over(steps),
                "direction_changes": F.sum("turn").over(w.rowsBetween(-(window - 3), 0)).cast("long"),
            }
        )

    d = with_lookback(points, ["match_id"], ["frame_number"], window - 1, walk, size)
    enough = F.col("points") >= 5
    return d.select(
        *FRAME,
        F.when(enough, F.col("velocity_profile")).otherwise(F.array().cast("array<double>")).alias("velocity_profile"),
        F.when(enough & F.col("variance").isNotNull(), F.lit(1.0) / (F.lit(1.0) + F.col("variance")))
        .otherwise(F.lit(0.0))
        .alias("smoothness"),
        F.when(enough, F.col("direction_changes")).otherwise(F.lit(0).cast("long")).alias("direction_changes"),
    )


def shot_rhythm(shots: DataFrame, size: int = CHUNK_FRAMES) -> DataFrame:
    """Shots per minute and how regular the intervals are, per match."""
    d = last_before(
        shots.select("match_id", "frame_number", "ts_sec"),
        ["match_id"],
        ["frame_number"],
        {"prev_ts": F.col("ts_sec")},
        size,
    ).withColumn("gap", F.col("ts_sec") - F.col("prev_ts"))
    total = d.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("shots"),
        (F.max("ts_sec") - F.min("ts_sec")).alias("span"),
        F.avg("gap").alias("mean_interval"),
        F.var_pop("gap").alias("interval_variance"),
    )
    mean, var = F.col("mean_interval"), F.col("interval_variance")
    return total.select(
        "match_id",
        F.when(F.col("span") > 0, F.col("shots") / (F.when(F.col("span") > 0, F.col("span")) / F.lit(60.0)))
        .otherwise(F.lit(0.0))
        .alias("shots_per_minute"),
        "mean_interval",
        "interval_variance",
        F.when(mean.isNull(), "unknown")
        .when(var < mean * F.lit(0.5), "consistent")
        .when(var > mean * F.lit(2.0), "sporadic")
        .otherwise("moderate")
        .alias("rhythm"),
    )


def recent_shots(shots: DataFrame, limit: int = 10) -> DataFrame:
    """Last ``limit`` shots per match (the rank limit is applied before the shuffle)."""
    w = Window.partitionBy("match_id").orderBy(F.desc("frame_number"))
    return shots.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= limit).drop("__rn")


def recent(shots: DataFrame, seconds: float = 60.0) -> DataFrame:
    """Shots within ``seconds`` of their match's last one."""
    last = shots.groupBy("match_id").agg(F.max("ts_sec").alias("__last"))
    return shots.join(last, "match_id").filter(F.col("__last") - F.col("ts_sec") <= seconds).drop("__last")


def ball_in_hand(balls: DataFrame, players: DataFrame) -> DataFrame:
    """Players inside a shooting circle or not, with the first ball they hold
    (within 50 px and overlapping by more than a tenth)."""
    p = players.select(*FRAME, "ts_sec", "det_no", "track_id", *G.BOX, "court_x", "court_y")
    b = _boxes(balls, "b_", "court_x", "court_y")
    d = b.join(p, FRAME)
    held = (_centre_distance("", "b_") < 50) & (G.iou(G.box(), G.box("b_")) > 0.1)
    first = F.min_by(
        F.struct("ts_sec", "det_no", "court_x", "court_y", "b_court_x", "b_court_y"), F.struct("det_no", "b_no")
    )
    return d.filter(held).groupBy(*FRAME, "track_id").agg(first.alias("r")).select(*FRAME, "track_id", "r.*")


def new_shot_attempts(
    balls: DataFrame,
    players: DataFrame,
    frames: DataFrame,
    min_confidence: float = 0.7,
    size: int = CHUNK_FRAMES,
) -> DataFrame:
    """First confident frame in a shooting circle of each spell a player holds the
    ball. A spell ends with the first frame of the match without it in hand."""
    order = last_before(
        frames.select(*FRAME), ["match_id"], ["frame_number"], {"prev_frame": F.col("frame_number")}, size
    )
    held = ball_in_hand(balls, players).join(order, FRAME)
    keys = ["match_id", "track_id"]
    held = last_before(held, keys, ["frame_number"], {"__before": F.col("frame_number")}, size)
    start = F.when(
        F.col("__before").isNull() | ~F.col("__before").eqNullSafe(F.col("prev_frame")), F.col("frame_number")
    )
    held = last_before(held, keys, ["frame_number"], {"__spell": start}, size)
    held = held.withColumn("spell", F.coalesce(start, F.col("__spell")))
    mid = F.lit(COURT_WIDTH / 2)
    circle = F.when(
        G.euclidean("court_x", "court_y", F.lit(0.0), mid) <= GOAL_CIRCLE_RADIUS, "shooting_circle_left"
    ).when(G.euclidean("court_x", "court_y", F.lit(COURT_LENGTH), mid) <= GOAL_CIRCLE_RADIUS, "shooting_circle_right")
    held = held.withColumn("shooting_circle", circle).filter(F.col("shooting_circle").isNotNull())
    held = held.withColumns(
        {
            "shot_distance": shot_distance_edge("shooting_circle", "b_court_x", "b_court_y"),
            "shot_angle": shot_angle("shooting_circle", "b_court_x", "b_court_y"),
        }
    ).withColumn(
        "confidence",
        shot_attempt_confidence(G.euclidean("b_court_x", "b_court_y", "court_x", "court_y"), "shot_distance"),
    )
    out = held.filter(F.col("confidence") >= min_confidence)
    cols = ["frame_number", "ts_sec", "shooting_circle", "b_court_x", "b_court_y", "court_x", "court_y",
            "shot_distance", "shot_angle", "confidence"]
    out = out.groupBy(*keys, "spell").agg(F.min_by(F.struct(*cols), F.col("frame_number")).alias("a"))
    return out.select(
        "match_id",
        F.col("a.frame_number").alias("frame_number"),
        F.col("a.ts_sec").alias("timestamp"),
        F.col("track_id").alias("player_id"),
        F.col("a.shooting_circle").alias("shooting_circle"),
        F.col("a.b_court_x").alias("ball_x"),
        F.col("a.b_court_y").alias("ball_y"),
        F.col("a.court_x").alias("player_x"),
        F.col("a.court_y").alias("player_y"),
        F.col("a.shot_distance").alias("shot_distance"),
        F.col("a.shot_angle").alias("shot_angle"),
        F.col("a.confidence").alias("confidence"),
    )


def _goals():
    return F.count_if(F.col("result") == "goal")


def shooting_summary(shots: DataFrame) -> DataFrame:
    """Totals of each match, overall and split by team, position and zone, in one pass: each shot
    is expanded to its four groups and combined map-side."""
    sets = [("all", F.lit("all")), ("team", F.col("team")), ("position", F.col("position")), ("zone", F.col("zone"))]
    keys = F.explode(F.array(*[F.struct(F.lit(n).alias("grouping"), c.alias("value")) for n, c in sets]))
    d = shots.select("match_id", keys.alias("k"), "result", "distance_to_goal", "angle_to_goal")
    return d.groupBy("match_id", "k.grouping", "k.value").agg(
        F.count(F.lit(1)).alias("shots"),
        _goals().alias("goals"),
        (F.count(F.lit(1)) - _goals()).alias("misses"),
        (_goals() / F.count(F.lit(1))).alias("success_rate"),
        F.avg("distance_to_goal").alias("average_distance"),
        F.avg("angle_to_goal").alias("average_angle"),
    )


def player_shooting_stats(shots: DataFrame) -> DataFrame:
    return shots.groupBy("match_id", F.col("shooter_id").alias("player_id")).agg(
        F.count(F.lit(1)).alias("total_shots"),
        _goals().alias("goals"),
        F.count_if(F.col("result") == "miss").alias("misses"),
        F.count_if(F.col("result") == "blocked").alias("blocked_shots"),
        (_goals() / F.count(F.lit(1))).alias("success_rate"),
        F.avg("distance_to_goal").alias("average_distance"),
        F.avg("angle_to_goal").alias("average_angle"),
    )


def shots_by(shots: DataFrame, *keys: str) -> DataFrame:
    """Attempts, goals and accuracy per key (zone or player)."""
    return shots.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"), _goals().alias("goals"), (_goals() / F.count(F.lit(1))).alias("accuracy")
    )


def shot_outcomes(shots: DataFrame) -> DataFrame:
    """Shots of each match per result, beside the match's share of goals."""
    d = shots.groupBy("match_id", "result").agg(F.count(F.lit(1)).alias("n"))
    match = Window.partitionBy("match_id")  # over a handful of results
    goals = F.sum(F.when(F.col("result") == "goal", F.col("n")).otherwise(0)).over(match)
    return d.withColumn("success_rate", goals / F.sum("n").over(match))


def expected_goals(shots: DataFrame) -> DataFrame:
    """Sum of success probabilities next to the goals scored, per match and team."""
    p = shot_success_probability("distance_to_goal", "angle_to_goal", "position")
    return shots.groupBy("match_id", "team").agg(F.sum(p).alias("expected_goals"), _goals().alias("goals"))


def success_rate_by_distance_bin(shots: DataFrame, bins: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Goal share in equal-width, right-closed distance bins over the range seen, for all shots
    or for each group of ``keys`` (a match)."""
    edge = shots.groupBy(*keys).agg(F.min("distance_to_goal").alias("lo"), F.max("distance_to_goal").alias("hi"))
    same = F.col("lo") == F.col("hi")
    pad = lambda c: F.when(F.col(c) == 0, F.lit(0.001)).otherwise(F.lit(0.001) * F.abs(F.col(c)))
    edge = edge.select(
        *keys,
        F.when(same, F.col("lo") - pad("lo")).otherwise(F.col("lo")).alias("lo"),
        F.when(same, F.col("hi") + pad("hi")).otherwise(F.col("hi")).alias("hi"),
    ).withColumn("step", (F.col("hi") - F.col("lo")) / F.lit(float(bins)))
    d = shots.join(edge, list(keys)) if keys else shots.crossJoin(F.broadcast(edge))  # one row
    case = F.when(F.col("distance_to_goal") <= F.col("lo") + F.col("step"), F.lit(0))
    for i in range(1, bins - 1):
        case = case.when(F.col("distance_to_goal") <= F.col("lo") + F.lit(float(i + 1)) * F.col("step"), F.lit(i))
    d = d.withColumn("bin", case.otherwise(F.lit(bins - 1)).cast("long"))
    return d.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("attempts"), (_goals() / F.count(F.lit(1))).alias("success_rate")
    )
