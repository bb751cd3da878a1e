"""Result tables in their fixed layouts, and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.functions.geometry import BOX
from courtflow.operators import ocr, possession, shooting, zones
from courtflow.session import cut_lineage

FRAME = ["match_id", "frame_number"]


def events_table(shots: DataFrame, possessions: DataFrame) -> DataFrame:
    """Shots and possession events in one seven-column table, blanks where a column
    does not apply."""
    s = shots.select(
        "match_id",
        F.col("ts_sec").alias("timestamp"),
        F.lit("shot").alias("event_type"),
        F.col("shooter_id").alias("player_id"),
        "team",
        "result",
        "zone",
        F.col("distance_to_goal").alias("distance"),
    )
    p = possessions.select(
        "match_id",
        F.col("ts_sec").alias("timestamp"),
        F.concat(F.lit("possession_"), F.col("event_type")).alias("event_type"),
        "player_id",
        "team",
        F.lit("").alias("result"),
        (F.coalesce("zone", F.lit("")) if "zone" in possessions.columns else F.lit("")).alias("zone"),
    )
    return s.unionByName(p, allowMissingColumns=True)


def player_stats_table(stats: DataFrame) -> DataFrame:
    """Seven columns per player; what is missing counts as 0."""
    wanted = ["possession_time", "shots_attempted", "shots_made", "passes", "interceptions", "zone_violations"]
    cols = [
        (F.coalesce(F.col(c), F.lit(0)) if c in stats.columns else F.lit(0)).cast(
            "double" if c == "possession_time" else "long"
        ).alias(c)
        for c in wanted
    ]
    return stats.select("match_id", "player_id", *cols)


def per_frame_detections_json(detections: DataFrame) -> DataFrame:
    """One row per frame: counts and JSON arrays by class, in detection order."""
    item = F.struct(*BOX, "confidence", "class_name")
    rows = F.array_sort(F.collect_list(F.struct("det_no", item.alias("d"))))
    d = detections.groupBy(*FRAME).agg(F.max("ts_sec").alias("timestamp"), rows.alias("all"))
    of = lambda c: F.transform(F.filter("all", lambda x: x["d"]["class_name"] == c), lambda x: x["d"])
    classes = ("player", "ball", "hoop")
    return d.select(
        *FRAME,
        "timestamp",
        *[F.size(of(c)).cast("long").alias(f"{c}_count") for c in classes],
        *[F.to_json(of(c)).alias(f"{c}_detections_json") for c in classes],
    )


def analysis_documents(
    players: DataFrame,
    shots: DataFrame,
    events: DataFrame,
    frames: DataFrame,
    processing_time: float,
    fps: float = 30.0,
    part_seconds: float = 36_000.0,
) -> DataFrame:
    """Nested result documents, lists in time order. ``players`` has one row per
    player of the match. A document covers at most ``part_seconds`` of a match (ten
    hours: any real match is one document), so no list grows without bound."""
    at = F.floor(F.col("ts_sec") / F.lit(part_seconds)).cast("long").alias("part")
    key = ["match_id", "part"]
    shots, events, frames = (d.select("*", at) for d in (shots, events, frames))
    p = players.groupBy("match_id").agg(
        F.sort_array(
            F.collect_list(F.struct("track_id", "team", "position", "possession_time", "is_in_possession"))
        ).alias("players")
    )
    shot = F.struct(
        F.col("ts_sec").alias("timestamp"),
        "shooter_id",
        "team",
        F.struct(F.col("ball_x").alias("x"), F.col("ball_y").alias("y")).alias("position"),
        "result",
        "zone",
        "distance_to_goal",
    )
    goal = F.col("result") == "goal"
    s = shots.groupBy(*key).agg(
        F.sort_array(F.collect_list(shot)).alias("shot_events"),
        F.count_if(goal & (F.col("team") == "home")).alias("home_score"),
        F.count_if(goal & (F.col("team") != "home")).alias("away_score"),
    )
    event = F.struct(F.col("ts_sec").alias("timestamp"), "player_id", "team", "event_type")
    e = events.groupBy(*key).agg(F.sort_array(F.collect_list(event)).alias("possession_events"))
    f = frames.groupBy(*key).agg(F.count(F.lit(1)).alias("frame_count"), F.max("ts_sec").alias("last"))
    d = f.join(s, key, "full").join(e, key, "full").join(p, "match_id", "left")
    zero = F.lit(0).cast("long")
    state = F.struct(
        F.col("last").alias("timestamp"),
        F.lit(1).alias("period"),
        F.coalesce("home_score", zero).alias("home_score"),
        F.coalesce("away_score", zero).alias("away_score"),
    )
    return d.select(
        "match_id",
        F.col("match_id").cast("string").alias("game_id"),
        "part",
        "players",
        "possession_events",
        "shot_events",
        state.alias("game_state"),
        F.lit(processing_time).alias("processing_time"),
        F.coalesce("frame_count", zero).alias("frame_count"),
        F.lit(fps).alias("fps"),
    )


def calibrated_run_tables(detections: DataFrame, frames: DataFrame, reads: DataFrame) -> dict[str, DataFrame]:
    """The ten tables of a calibrated run. Possession, shot attempts and their results stand in several of them,
    so these are written to the shared folder once (a row per frame or less)."""
    of = lambda c: detections.filter(F.col("class_name") == c)
    players, balls, hoops = of("player"), of("ball"), of("hoop")
    assigned = cut_lineage(possession.assign_possession(detections), "assigned")
    smoothed = possession.smooth_possession(possession.tracked_frames(assigned))
    attempts = cut_lineage(shooting.new_shot_attempts(balls, players, frames), "attempts")
    results = shooting.shot_outcome_by_proximity(attempts, balls, hoops)
    # shooters without track id keep their shot: the ids are compared null-safe after the join on the frame
    results = results.select(*FRAME, F.col("player_id").alias("of_player"), "result")
    results = cut_lineage(results, "results")
    scored = attempts.join(results, FRAME).filter(F.col("player_id").eqNullSafe(F.col("of_player"))).select(
        "match_id",
        F.col("player_id").alias("shooter_id"),
        "result",
        F.col("shot_distance").alias("distance_to_goal"),
        F.col("shot_angle").alias("angle_to_goal"),
    )
    zoned = zones.with_zone(detections)
    from courtflow.functions.court import is_on_court

    when = F.col("ts_sec").alias("timestamp")
    return {
        "detections": zoned.select(
            *FRAME, when, F.col("class_name").alias("class"), *BOX, "confidence", "court_x", "court_y", "zone",
            is_on_court("court_x", "court_y").alias("is_valid_position"),
        ),
        "zone_violations": zones.zone_violations(players).select(
            *FRAME, when, "player_id", "violation_type", F.col("zone").alias("zone_name"), "severity", "description"
        ),
        "zone_statistics": zones.with_zone(players).groupBy(*FRAME, F.col("zone").alias("zone_name")).agg(
            F.max("ts_sec").alias("timestamp"), F.count(F.lit(1)).alias("player_count")
        ),
        "possession_data": assigned.select(
            *FRAME, when, F.col("track_id").alias("possession_player_id"), F.col("confidence").alias("possession_confidence"),
            F.col("reason").alias("possession_reason"), "ball_count", "player_count",
        ),
        "possession_changes": possession.possession_changes(smoothed).drop("open_at_end"),
        "three_second_violations": possession.three_second_violations(smoothed),
        "shot_attempts": attempts,
        "shot_results": results,
        "shooting_statistics": shooting.player_shooting_stats(scored),
        "bib_positions": ocr.bib_positions(reads),
    }


def final_run_tables(detections: DataFrame, reads: DataFrame) -> dict[str, DataFrame]:
    """The tables of a text-read run: detections with jersey, per-frame counts,
    number reads, position reads, zone statistics."""
    from courtflow.operators.quality import frame_statistics

    of = lambda c: detections.filter(F.col("class_name") == c)
    players = ocr.jersey_on_detections(of("player"), reads)
    rest = detections.filter(F.col("class_name") != "player")
    every = zones.with_zone(players.unionByName(rest, allowMissingColumns=True))
    numbers = ocr.clean_reads(reads).filter(F.col("jersey_number").isNotNull())
    return {
        "detections": every.select(
            *FRAME, "ts_sec", F.col("class_name").alias("object_type"), F.col("det_no").alias("object_id"), "confidence",
            *BOX, "court_x", "court_y", "zone", F.col("court_x").isNotNull().alias("is_calibrated"),
            "jersey_number", "jersey_confidence",
        ),
        "frame_statistics": frame_statistics(detections, reads),
        "jersey_data": numbers.select(*FRAME, "timestamp", "jersey_number", "confidence", *BOX),
        "position_data": ocr.bib_positions(reads),
        "zone_statistics": zones.zone_distribution(zones.with_zone(of("player"))),
    }


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write each table below ``path``, partitioned by match where it has one."""
    for name, df in tables.items():
        w = df.write.mode(mode)
        if "match_id" in df.columns:
            w = w.partitionBy("match_id")
        if fmt == "csv":
            w = w.option("header", True)
        w.format(fmt).save(f"{path}/{name}")


def write_standings(table: DataFrame, path: str) -> None:
    """One CSV folder per category, rows in table order within a file."""
    d = table.repartition("category").sortWithinPartitions("category", "position")
    d.write.mode("overwrite").partitionBy("category").option("header", True).csv(path)


def write_analysis_documents(documents: DataFrame, path: str) -> None:
    documents.drop("match_id").write.mode("overwrite").json(path)


def write_detections_bucketed(detections: DataFrame, table: str, buckets: int = 1024, path: str | None = None) -> None:
    """A table bucketed by frame: the per-frame joins and aggregates of this library
    then run without shuffling it."""
    w = detections.write.mode("overwrite").bucketBy(buckets, *FRAME).sortBy(*FRAME)
    if path is not None:
        w = w.option("path", path)
    w.saveAsTable(table)
