"""Zone occupancy, rule violations and transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courtflow.constants import FPS, NO_VIOLATIONS, VIOLATION_ADVICE, ZONE_RULES
from courtflow.functions.court import (
    classify_zone,
    classify_zone_home_away,
    in_court_margin,
    is_on_court,
    is_position_valid,
    zone_to_grid,
)
from courtflow.functions.geometry import safe_div
from courtflow.operators.ordered import CHUNK_FRAMES, last_before

FRAME = ["match_id", "frame_number"]


def with_zone(df: DataFrame, home_away: bool = False) -> DataFrame:
    pick = classify_zone_home_away if home_away else classify_zone
    return df.withColumn("zone", pick("court_x", "court_y"))


def zone_rules(spark: SparkSession) -> DataFrame:
    """The five-row rule table (fixed size, safe to broadcast)."""
    rows = [(z, allowed, limit) for z, (allowed, limit) in ZONE_RULES.items()]
    return spark.createDataFrame(rows, "zone string, allowed array<string>, max_players long")


def zone_rule_violations(players: DataFrame) -> DataFrame:
    """Players in a zone whose rule does not list their position."""
    rules = F.broadcast(zone_rules(players.sparkSession))
    return (
        players.join(rules, "zone")
        .filter(F.col("position").isNull() | ~F.array_contains("allowed", F.col("position")))
        .drop("allowed", "max_players")
    )


def max_players_violations(players: DataFrame) -> DataFrame:
    """Zones holding more players in a frame than their rule permits."""
    rules = F.broadcast(zone_rules(players.sparkSession).select("zone", "max_players"))
    return (
        players.groupBy(*FRAME, "zone")
        .agg(F.count(F.lit(1)).alias("current_count"), F.sort_array(F.collect_list("track_id")).alias("players"))
        .join(rules, "zone")
        .filter(F.col("current_count") > F.col("max_players"))
    )


def home_away_zone_violations(players: DataFrame) -> DataFrame:
    """Position and head-count violations in one table."""
    one = zone_rule_violations(players).select(
        *FRAME,
        F.lit("position_not_allowed").alias("violation_type"),
        "zone",
        F.col("track_id").alias("player_id"),
        "position",
        F.lit(None).cast("long").alias("current_count"),
        F.lit(None).cast("long").alias("max_players"),
    )
    many = max_players_violations(players).select(
        *FRAME,
        F.lit("max_players_exceeded").alias("violation_type"),
        "zone",
        F.lit(None).cast("long").alias("player_id"),
        F.lit(None).cast("string").alias("position"),
        "current_count",
        "max_players",
    )
    return one.unionByName(many)


def _player_id():
    return F.coalesce(F.col("track_id"), F.lit(0)).cast("long")


def zone_violations(players: DataFrame) -> DataFrame:
    """At most one violation per player row: out of bounds, then position
    restriction, then sideline proximity. No shuffle: one pass over the rows."""
    d = with_zone(players).withColumn("player_id", _player_id())
    kind = (
        F.when(~is_on_court("court_x", "court_y"), "out_of_bounds")
        .when(~is_position_valid("position", "zone"), "position_restriction")
        .when(~in_court_margin("court_x", "court_y"), "sideline_proximity")
    )
    pid = F.col("player_id").cast("string")
    text = (
        F.when(F.col("violation_type") == "out_of_bounds", F.concat(F.lit("Player "), pid, F.lit(" is out of bounds")))
        .when(F.col("violation_type") == "position_restriction", _restricted(pid))
        .otherwise(F.concat(F.lit("Player "), pid, F.lit(" too close to court boundary")))
    )
    return (
        d.withColumn("violation_type", kind)
        .filter(F.col("violation_type").isNotNull())
        .withColumn("severity", F.when(F.col("violation_type") == "sideline_proximity", "minor").otherwise("major"))
        .withColumn("description", text)
    )


def _restricted(pid):
    return F.concat(F.lit("Player "), pid, F.lit(" ("), F.col("position"), F.lit(") in restricted zone "), F.col("zone"))


def overflow_violations(players: DataFrame) -> DataFrame:
    """More than two team-mates in a goal circle or one in the centre circle;
    one row per player involved. Only circle rows are shuffled."""
    d = with_zone(players).filter(F.col("zone").isin("goal_circle_left", "goal_circle_right", "center_circle"))
    crowd = d.groupBy(*FRAME, "team", "zone").agg(F.count(F.lit(1)).alias("n"))
    goal = F.col("zone") != "center_circle"
    over = crowd.filter(F.col("n") > F.when(goal, 2).otherwise(1))
    over = over.withColumnRenamed("team", "over_team")
    # players without team crowd a circle too: the team is compared null-safe after the join on the frame
    where = F.when(goal, "goal circle (max 2)").otherwise("center circle (max 1)")
    return (
        d.join(over, [*FRAME, "zone"])
        .filter(F.col("team").eqNullSafe(F.col("over_team")))
        .drop("over_team")
        .withColumn("player_id", _player_id())
        .withColumn("violation_type", F.when(goal, "goal_circle_overflow").otherwise("center_circle_overflow"))
        .withColumn("severity", F.lit("critical"))
        .withColumn(
            "description",
            F.concat(F.lit("Team "), F.coalesce("team", F.lit("None")), F.lit(" has "), F.col("n").cast("string"), F.lit(" players in "), where),
        )
    )


VIOLATION_COLUMNS = [
    "match_id", "frame_number", "timestamp", "player_id", "violation_type", "zone_name", "severity",
    "description", "court_x", "court_y",
]


def enhanced_zone_violations(players: DataFrame) -> DataFrame:
    """Base violations, position restrictions the base rule order hid, and
    circle overflows. A hidden restriction is not repeated when the same player
    id already has one in that frame."""
    base = zone_violations(players)
    zoned = with_zone(players).withColumn("player_id", _player_id())
    hidden = zoned.filter(~is_position_valid("position", "zone")).withColumns(
        {
            "violation_type": F.lit("position_restriction"),
            "severity": F.lit("major"),
            "description": _restricted(F.col("player_id").cast("string")),
        }
    )
    reported = base.filter(F.col("violation_type") == "position_restriction").select(*FRAME, "player_id").distinct()
    hidden = hidden.join(reported, [*FRAME, "player_id"], "left_anti")

    def shape(df):
        return df.withColumns({"timestamp": F.col("frame_number") / F.lit(FPS), "zone_name": F.col("zone")}).select(
            *VIOLATION_COLUMNS
        )

    return shape(base).unionByName(shape(hidden)).unionByName(shape(overflow_violations(players)))


def violation_marginals(violations: DataFrame) -> DataFrame:
    """Counts of each match by type, severity, player, zone and frame, and its total.

    Each row is expanded into six small keys and counted, so the counting is
    combined before the shuffle like any other aggregate."""
    sets = [
        ("type", F.col("violation_type")),
        ("severity", F.col("severity")),
        ("player", F.col("player_id").cast("string")),
        ("zone", F.col("zone_name")),
        ("frame", F.col("frame_number").cast("string")),
        ("total", F.lit("all")),
    ]
    keys = F.explode(F.array(*[F.struct(F.lit(n).alias("grouping"), c.alias("value")) for n, c in sets]))
    d = violations.select("match_id", keys.alias("k"))
    return d.groupBy("match_id", "k.grouping", "k.value").agg(F.count(F.lit(1)).alias("n"))


def zone_occupancy(players: DataFrame) -> DataFrame:
    return with_zone(players).groupBy(*FRAME, "zone").agg(F.count(F.lit(1)).alias("players"))


def zone_team_stats(players: DataFrame, frames: DataFrame) -> DataFrame:
    """Per frame and home / away zone, zero zones included: head count, ids, team split."""
    zones = F.explode(F.array(*[F.lit(z) for z in ZONE_RULES]))
    grid = frames.select(*FRAME, zones.alias("zone"))
    seen = players.groupBy(*FRAME, "zone").agg(
        F.count(F.lit(1)).alias("player_count"),
        F.sort_array(F.collect_list("track_id")).alias("player_ids"),
        F.count_if(F.col("team") == "home").alias("home"),
        F.count_if(F.col("team") == "away").alias("away"),
    )
    out = grid.join(seen, [*FRAME, "zone"], "left")
    return out.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("player_count", "home", "away")}
        | {"player_ids": F.coalesce(F.col("player_ids"), F.array().cast("array<bigint>"))}
    )


def zone_transitions_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """Players present in both frames whose zone differs (null counts as a zone)."""
    a = before.select("match_id", "track_id", F.col("zone").alias("from_zone"))
    b = after.select("match_id", "track_id", F.col("zone").alias("to_zone"), "team")
    return a.join(b, ["match_id", "track_id"]).filter(~F.col("from_zone").eqNullSafe(F.col("to_zone")))


def zone_transitions(
    players: DataFrame, order: Sequence[str] = ("frame_number", "det_no"), size: int = CHUNK_FRAMES
) -> DataFrame:
    """Rows where a player's zone differs from the row before."""
    d = with_zone(players).select("match_id", "track_id", *order, "zone")
    d = last_before(d, ["match_id", "track_id"], order, {"from_zone": F.col("zone")}, size)
    return d.filter(F.col("from_zone").isNotNull() & (F.col("from_zone") != F.col("zone"))).withColumnRenamed(
        "zone", "to_zone"
    )


def zone_transition_summary(players: DataFrame, size: int = CHUNK_FRAMES) -> DataFrame:
    """Per player seen at least twice: transitions and zones visited."""
    d = with_zone(players).select("match_id", "track_id", "frame_number", "det_no", "zone")
    d = last_before(d, ["match_id", "track_id"], ["frame_number", "det_no"], {"prev": F.col("zone")}, size)
    return (
        d.groupBy("match_id", "track_id")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("prev").isNotNull() & (F.col("prev") != F.col("zone"))).alias("total_transitions"),
            F.sort_array(F.collect_set("zone")).alias("zones_visited"),
        )
        .filter(F.col("rows") >= 2)
        .drop("rows")
    )


def heatmap(players: DataFrame, grid: int = 20) -> DataFrame:
    """Player counts of each match per grid cell of their home / away zone."""
    gx, gy = zone_to_grid("zone", grid)
    d = players.filter(F.col("zone").isNotNull()).select("match_id", gx.alias("grid_x"), gy.alias("grid_y"))
    return d.groupBy("match_id", "grid_x", "grid_y").agg(F.count(F.lit(1)).alias("n"))


def heatmap_binned(df: DataFrame, length: float, width: float, grid: int = 20) -> DataFrame:
    """Counts of each match per grid cell of the court coordinates, in-range rows only."""
    gx = F.floor(F.col("court_x") / F.lit(length / grid)).cast("long")
    gy = F.floor(F.col("court_y") / F.lit(width / grid)).cast("long")
    d = df.select("match_id", gx.alias("grid_x"), gy.alias("grid_y"))
    d = d.filter(F.col("grid_x").between(0, grid - 1) & F.col("grid_y").between(0, grid - 1))
    return d.groupBy("match_id", "grid_x", "grid_y").agg(F.count(F.lit(1)).alias("n"))


def zone_distribution(players: DataFrame) -> DataFrame:
    """Rows of each match per zone with their share of the match's rows, in percent."""
    per_zone = players.groupBy("match_id", "zone").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("match_id"))  # over a handful of zones
    return per_zone.withColumn("percentage", safe_div("n", total) * F.lit(100.0))


def violation_recommendations(violations: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Advice lines per match from its mix of violations. ``matches`` (match_id) names those
    that may have none."""
    advice = [(k, text) for k, text in VIOLATION_ADVICE.items() if k != "critical"]
    counts = violations.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        *[F.count_if(F.col("violation_type") == k).alias(k) for k, _ in advice],
    )
    lines = [F.when(F.col(k) > 0, F.lit(text)) for k, text in advice]
    lines.append(
        F.when(
            F.col("critical") > F.col("n") * F.lit(0.5),
            F.lit(VIOLATION_ADVICE["critical"]),
        )
    )
    if matches is not None:
        counts = matches.select("match_id").distinct().join(counts, "match_id", "left").fillna(0, ["n", "critical", *[k for k, _ in advice]])
    none = F.array(F.lit(NO_VIOLATIONS))
    return counts.select(
        "match_id",
        F.when(F.col("n") == 0, none).otherwise(F.array_compact(F.array(*lines))).alias("recommendations")
    )
