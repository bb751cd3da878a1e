"""Ball possession: per-frame assignment, smoothing, episodes, held-ball rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.constants import (
    CONFIDENCE_ALPHA,
    CONFIRM_FRAMES,
    FPS,
    HELD_BALL_SECONDS,
    POSSESSION_MAX_DISTANCE,
    POSSESSION_MIN_CONFIDENCE,
)
from courtflow.functions import geometry as G
from courtflow.functions.shots import possession_confidence, possession_reason
from courtflow.operators.ordered import CHUNK_FRAMES, blended, last_before, next_after, running_sum, with_lookback
from courtflow.session import cut_lineage

FRAME = ["match_id", "frame_number"]


def ball_player_candidates(
    balls: DataFrame, players: DataFrame, max_distance: float = POSSESSION_MAX_DISTANCE
) -> DataFrame:
    """Ball-player pairs of one frame within reach. The frame is the equi-join
    key, so the pairs stay those of a frame."""
    b = balls.select(*FRAME, F.col("det_no").alias("ball_no"), *[F.col(c).alias("ball_" + c) for c in G.BOX])
    p = players.select(*FRAME, F.col("det_no").alias("player_no"), "track_id", *G.BOX)
    bb, pb = G.box("ball_"), G.box()
    distance = G.euclidean(G.center_x(bb), G.center_y(bb), G.center_x(pb), G.center_y(pb))
    return b.join(p, FRAME).withColumn("distance", distance).filter(F.col("distance") <= max_distance)


def assign_possession(
    detections: DataFrame,
    mode: str = "containment",
    max_distance: float = POSSESSION_MAX_DISTANCE,
    min_confidence: float = POSSESSION_MIN_CONFIDENCE,
) -> DataFrame:
    """The best player for the ball in every frame that has detections, with a
    reason when there is none.

    Ties go to the first ball, then the first player. The best pair is an
    aggregate (``max_by``), so nothing is sorted and it reuses the join's
    partitioning by frame.
    """
    score = G.ball_containment if mode == "containment" else G.iou
    balls = detections.filter(F.col("class_name") == "ball")
    players = detections.filter(F.col("class_name") == "player")
    pairs = ball_player_candidates(balls, players, max_distance)
    pairs = pairs.withColumn("score", score(G.box("ball_"), G.box()))
    pairs = pairs.withColumn("confidence", possession_confidence("distance", "score", mode, max_distance))
    best = (
        pairs.filter(F.col("confidence") > min_confidence)
        .groupBy(*FRAME)
        .agg(
            F.max_by(
                F.struct("player_no", "track_id", "ball_no", "confidence", "distance", "score"),
                F.struct("confidence", -F.col("ball_no"), -F.col("player_no")),
            ).alias("best")
        )
    )
    counts = detections.groupBy(*FRAME).agg(
        F.max("ts_sec").alias("ts_sec"),
        F.count_if(F.col("class_name") == "ball").alias("ball_count"),
        F.count_if(F.col("class_name") == "player").alias("player_count"),
    )
    none = (
        F.when(F.col("ball_count") == 0, "no_ball_detected")
        .when(F.col("player_count") == 0, "no_players_detected")
        .otherwise("no_clear_possession")
    )
    out = counts.join(best, FRAME, "left")
    return out.select(
        *FRAME,
        "ts_sec",
        "ball_count",
        "player_count",
        F.col("best.player_no").alias("player_no"),
        F.col("best.track_id").alias("track_id"),
        F.coalesce(F.col("best.confidence"), F.lit(0.0)).alias("confidence"),
        F.col("best.distance").alias("distance"),
        F.col("best.score").alias("score"),
        F.when(F.col("best").isNull(), none)
        .otherwise(possession_reason("best.distance", "best.score", mode))
        .alias("reason"),
    )


def tracked_frames(assigned: DataFrame, key: str = "track_id") -> DataFrame:
    """Frames that take part in smoothing: those with a ball and a player."""
    return assigned.filter((F.col("ball_count") > 0) & (F.col("player_count") > 0)).select(
        *FRAME, "ts_sec", F.col(key).alias("raw_player"), F.col("confidence").alias("raw_confidence")
    )


def smooth_possession(
    raw: DataFrame, k: int = CONFIRM_FRAMES, confirm: bool = True, size: int = CHUNK_FRAMES
) -> DataFrame:
    """Add ``smoothed`` and ``prev_smoothed`` (the value one row earlier).

    The first player seen is adopted at once; after that a player takes over at
    the k-th consecutive frame. Losing the ball is never confirmed for k >= 2.
    The result (one narrow row per frame) is written to the shared folder, since
    every operator on episodes reads it more than once.
    """
    if k == 1 or not confirm:
        out = last_before(raw, ["match_id"], ["frame_number"], {"__p": F.struct("raw_player")}, size)
        out = out.withColumns({"smoothed": F.col("raw_player"), "prev_smoothed": F.col("__p.raw_player")})
        return cut_lineage(out.drop("__p"), "smoothed")

    def confirmed(df, w):
        same = F.col("raw_player").isNotNull()
        for n in range(1, k):
            same = same & F.coalesce(F.lag("raw_player", n).over(w) == F.col("raw_player"), F.lit(False))
        return df.withColumn("__cand", F.when(same, F.col("raw_player")))

    d = with_lookback(raw, ["match_id"], ["frame_number"], k - 1, confirmed, size)
    d = last_before(
        d,
        ["match_id"],
        ["frame_number"],
        {"__conf": F.col("__cand"), "__first": F.col("raw_player")},
        size,
        earliest=["__first"],
    )
    before = F.coalesce("__conf", "__first")
    d = d.withColumns(
        {"smoothed": F.coalesce(F.col("__cand"), before, F.col("raw_player")), "prev_smoothed": before}
    )
    return cut_lineage(d.drop("__cand", "__conf", "__first"), "smoothed")


def smooth_confidence(raw: DataFrame, alpha: float = CONFIDENCE_ALPHA, size: int = 1 << 10) -> DataFrame:
    """Add ``smoothed_confidence``: a moving average of all rows since the first adopted player."""
    d = last_before(raw, ["match_id"], ["frame_number"], {"__seen": F.col("raw_player")}, size)
    d = d.withColumn("__on", F.col("raw_player").isNotNull() | F.col("__seen").isNotNull()).drop("__seen")
    value = F.when(F.col("__on") & F.col("raw_confidence").isNotNull(), F.array("raw_confidence"))
    d = blended(d, ["match_id"], ["frame_number"], value, F.lit(alpha), "__x", size)
    average = F.when(F.col("__on"), F.element_at("__x", 1)).otherwise(F.col("raw_confidence"))
    return d.withColumn("smoothed_confidence", average).drop("__on", "__x")


def _is_change():
    return ~F.col("smoothed").eqNullSafe(F.col("prev_smoothed"))


def possession_changes(smoothed: DataFrame, size: int = CHUNK_FRAMES) -> DataFrame:
    """Episodes: from the frame a player takes the ball to the frame another does;
    the last one is closed at the match's last frame."""
    changes = smoothed.filter(_is_change()).select(*FRAME, "ts_sec", "smoothed")
    ends = next_after(changes, ["match_id"], ["frame_number"], {"end": F.struct("frame_number", "ts_sec")}, size)
    last = smoothed.groupBy("match_id").agg(
        F.max_by(F.struct("frame_number", "ts_sec"), F.col("frame_number")).alias("last")
    )
    out = ends.filter(F.col("smoothed").isNotNull()).join(last, "match_id")
    out = out.withColumn("e", F.coalesce("end", "last"))
    return out.select(
        "match_id",
        F.col("smoothed").alias("player_id"),
        F.col("frame_number").alias("start_frame"),
        F.col("e.frame_number").alias("end_frame"),
        F.col("ts_sec").alias("start_timestamp"),
        F.col("e.ts_sec").alias("end_timestamp"),
        (F.col("e.frame_number") - F.col("frame_number")).alias("duration_frames"),
        (F.col("e.ts_sec") - F.col("ts_sec")).alias("duration_seconds"),
        F.col("end").isNull().alias("open_at_end"),
    )


def with_episode(smoothed: DataFrame, size: int = CHUNK_FRAMES) -> DataFrame:
    """Rows in possession with their episode's start and the time held so far."""
    start = F.when(_is_change(), F.struct("frame_number", "ts_sec"))
    d = last_before(smoothed, ["match_id"], ["frame_number"], {"__start": start}, size)
    d = d.withColumn("__s", F.coalesce(start, F.col("__start"))).filter(F.col("smoothed").isNotNull())
    return d.withColumns(
        {
            "start_frame": F.col("__s.frame_number"),
            "start_timestamp": F.col("__s.ts_sec"),
            "held_seconds": F.col("ts_sec") - F.col("__s.ts_sec"),
        }
    ).drop("__s", "__start")


def current_possession_duration(smoothed: DataFrame, size: int = CHUNK_FRAMES) -> DataFrame:
    return with_episode(smoothed, size).select(
        *FRAME, F.col("smoothed").alias("player_id"), F.col("held_seconds").alias("duration_seconds")
    )


def three_second_violations(
    smoothed: DataFrame, limit: float = HELD_BALL_SECONDS, size: int = CHUNK_FRAMES
) -> DataFrame:
    """First frame of each episode held longer than the limit."""
    late = with_episode(smoothed, size).filter(F.col("held_seconds") > limit)
    first = late.groupBy("match_id", "start_frame").agg(
        F.min_by(
            F.struct("smoothed", "frame_number", "start_timestamp", "ts_sec", "held_seconds"), F.col("frame_number")
        ).alias("v")
    )
    return first.select(
        "match_id",
        F.col("v.smoothed").alias("player_id"),
        "start_frame",
        F.col("v.frame_number").alias("violation_frame"),
        F.col("v.start_timestamp").alias("start_timestamp"),
        F.col("v.ts_sec").alias("violation_timestamp"),
        F.col("v.held_seconds").alias("duration_seconds"),
        (F.col("v.held_seconds") - F.lit(limit)).alias("excess_seconds"),
    )


def pass_edges(changes: DataFrame, teams: DataFrame, size: int = CHUNK_FRAMES) -> DataFrame:
    """Ball movements between consecutive episodes: a pass within a team, an
    interception between teams. ``teams``: match_id, player_id, team."""
    d = changes.withColumn("frame_number", F.col("start_frame")).join(teams, ["match_id", "player_id"], "left")
    d = next_after(
        d, ["match_id"], ["frame_number"], {"nxt": F.struct("player_id", "team", "start_frame")}, size
    ).filter(F.col("nxt").isNotNull() & (F.col("end_frame") == F.col("nxt.start_frame")))
    return d.select(
        "match_id",
        F.col("player_id").alias("src"),
        F.col("nxt.player_id").alias("dst"),
        F.col("end_frame").alias("frame_number"),
        F.when(F.col("team") == F.col("nxt.team"), "pass").otherwise("interception").alias("kind"),
    )


def passing_network(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("kind") == "pass").groupBy("match_id", "src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def teammate_pairs(players: DataFrame) -> DataFrame:
    """Distinct pairs of team-mates of a match (players are made distinct first)."""
    p = players.select("match_id", "team", "track_id").distinct()
    other = p.select("match_id", "team", F.col("track_id").alias("other_id"))
    return p.join(other, ["match_id", "team"]).filter(F.col("track_id") < F.col("other_id"))


def shooter_of_frame(ball_frames: DataFrame, player_frames: DataFrame) -> DataFrame:
    """The player row of the ball's holder."""
    p = player_frames.withColumnRenamed("track_id", "possession_player_id")
    return ball_frames.join(p, [*FRAME, "possession_player_id"])


def player_stats(player_frames: DataFrame, shots: DataFrame, fps: float = FPS) -> DataFrame:
    """Possession time, shots and zone violations per player. ``player_frames``
    carries is_in_possession and zone_ok; passes and interceptions come from
    ``pass_edges`` and are not counted here."""
    seen = player_frames.groupBy("match_id", F.col("track_id").alias("player_id")).agg(
        (F.count_if(F.col("is_in_possession")) / F.lit(fps)).alias("possession_time"),
        F.count_if(~F.col("zone_ok")).alias("zone_violations"),
    )
    shot = shots.groupBy("match_id", F.col("shooter_id").alias("player_id")).agg(
        F.count(F.lit(1)).alias("shots_attempted"), F.count_if(F.col("result") == "goal").alias("shots_made")
    )
    zero = F.lit(0).cast("long")
    return seen.join(shot, ["match_id", "player_id"], "full").withColumns(
        {
            "possession_time": F.coalesce("possession_time", F.lit(0.0)),
            "zone_violations": F.coalesce("zone_violations", zero),
            "shots_attempted": F.coalesce("shots_attempted", zero),
            "shots_made": F.coalesce("shots_made", zero),
        }
    )


def team_stats(shots: DataFrame, player_time: DataFrame, possession: str = "even") -> DataFrame:
    """Shots, goals and possession per match and team. ``player_time``: match_id,
    team, possession_time. 'even' halves each match's time between the teams."""
    shot = shots.groupBy("match_id", "team").agg(
        F.count(F.lit(1)).alias("shots"), F.count_if(F.col("result") == "goal").alias("goals")
    )
    both = F.explode(F.array(F.lit("home"), F.lit("away")))
    if possession == "even":
        time = player_time.groupBy("match_id").agg((F.sum("possession_time") / F.lit(2.0)).alias("possession_time"))
        time = time.select("match_id", both.alias("team"), "possession_time")
    else:
        time = player_time.groupBy("match_id", "team").agg(F.sum("possession_time").alias("possession_time"))
    zero = F.lit(0).cast("long")
    return time.join(shot, ["match_id", "team"], "full").withColumns(
        {
            "shots": F.coalesce("shots", zero),
            "goals": F.coalesce("goals", zero),
            "possession_time": F.coalesce("possession_time", F.lit(0.0)),
        }
    )


def final_score(shots: DataFrame) -> DataFrame:
    goal = F.col("result") == "goal"
    return shots.groupBy("match_id").agg(
        F.count_if(goal & (F.col("team") == "home")).alias("home_score"),
        F.count_if(goal & (F.col("team") != "home")).alias("away_score"),
    )


def running_score(shots: DataFrame, size: int = CHUNK_FRAMES) -> DataFrame:
    """Score after each shot of a match."""
    goal = F.col("result") == "goal"
    one = lambda cond: F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("long")
    return running_sum(
        shots,
        ["match_id"],
        ["frame_number"],
        {"home_score": one(goal & (F.col("team") == "home")), "away_score": one(goal & (F.col("team") != "home"))},
        size,
    )


def possession_compliance(changes: DataFrame, violations: DataFrame) -> DataFrame:
    """Episodes, those over the limit, and the rest, per match."""
    total = changes.groupBy("match_id").agg(F.count(F.lit(1)).alias("possessions"))
    over = violations.groupBy("match_id").agg(F.count(F.lit(1)).alias("violations"))
    zero = F.lit(0).cast("long")
    return total.join(over, "match_id", "left").select(
        "match_id",
        "possessions",
        F.coalesce("violations", zero).alias("violations"),
        (F.col("possessions") - F.coalesce("violations", zero)).alias("normal"),
    )
