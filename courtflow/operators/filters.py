"""Row filters on detections and text reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.constants import FPS, POSITIONS, SHOOTERS
from courtflow.functions import geometry as G
from courtflow.functions.court import in_court_margin, in_court_polygon
from courtflow.functions.text import is_numeric


def filter_players(df: DataFrame) -> DataFrame:
    """Players and referees of plausible size."""
    b = G.box()
    return df.filter(
        F.col("class_name").isin("player", "referee")
        & G.area(b).between(900, 60000) & (G.aspect_hw(b) >= 1.1) & (G.width(b) > 16) & (G.height(b) > 32)
    )


def filter_balls(df: DataFrame) -> DataFrame:
    """Balls of plausible size and confidence."""
    b = G.box()
    return df.filter(
        (F.col("class_name") == "ball")
        & (F.col("confidence") >= 0.3)
        & G.area(b).between(500, 3000)
        & G.aspect_hw(b).between(0.8, 1.5)
        & G.width(b).between(10, 100)
        & G.height(b).between(10, 100)
    )


def filter_hoops(df: DataFrame, frame_width: float = 1280.0, frame_height: float = 720.0) -> DataFrame:
    """Hoop-sized boxes away from the score overlays at the top and side edges."""
    b = G.box()
    return df.filter(
        (b[1] >= frame_height * 0.1)
        & b[0].between(frame_width * 0.02, frame_width * 0.98)
        & (G.area(b) > 1000)
        & (G.area(b) < 100000)
        & (G.aspect_hw(b) > 0.3)
        & (G.aspect_hw(b) < 5.0)
        & (G.height(b) > 20)
        & (G.width(b) > 10)
    )


def filter_numbers(df: DataFrame) -> DataFrame:
    b = G.box()
    return df.filter(
        G.area(b).between(20, 2000)
        & G.aspect_wh(b).between(0.3, 3.0)
        & (G.width(b) > 5)
        & (G.height(b) > 5)
        & (G.width(b) < 100)
        & (G.height(b) < 100)
    )


def filter_ball_reads(df: DataFrame) -> DataFrame:
    """The looser ball filter of the detection report; its bounds are inclusive."""
    b = G.box()
    return df.filter(
        (F.col("confidence") > 0.3)
        & G.width(b).between(10, 100)
        & G.height(b).between(10, 100)
        & G.aspect_wh(b).between(0.5, 2.0)
    )


def _readable(min_confidence: float):
    return (
        (F.col("confidence") >= min_confidence)
        & (F.length("text") <= 3)
        & G.area(G.box()).between(100, 10000)
    )


def filter_ocr_jersey(df: DataFrame, min_confidence: float = 0.2) -> DataFrame:
    return df.filter(_readable(min_confidence) & (is_numeric("text") | (F.col("confidence") >= 0.8)))


def filter_ocr_bib(df: DataFrame, min_confidence: float = 0.2) -> DataFrame:
    return df.filter(_readable(min_confidence) & F.col("text").isin(POSITIONS))


def likely_jersey_number(df: DataFrame, min_confidence: float = 0.3) -> DataFrame:
    n = F.when(is_numeric("text"), F.col("text").try_cast("bigint"))
    return df.filter((F.col("confidence") >= min_confidence) & n.between(1, 99))


def drop_off_court(df: DataFrame, calibrated: bool = False) -> DataFrame:
    """Keep detections inside the court inset; with the ``outline`` of the matrix in
    force also those inside it. Only players are ever dropped."""
    b = G.box()
    keep = in_court_margin("court_x", "court_y")
    if calibrated:
        keep = keep & in_court_polygon("outline", G.center_x(b), G.center_y(b))
    return df.filter((F.col("class_name") != "player") | keep)


def balls_not_on_bodies(balls: DataFrame, players: DataFrame) -> DataFrame:
    """Drop balls whose centre lies in a player box below its top tenth."""
    p = players.select("match_id", "frame_number", *[F.col(c).alias("p_" + c) for c in G.BOX])
    b, pb = G.box(), G.box("p_")
    x, y = G.center_x(b), G.center_y(b)
    on_body = G.contains_point(pb, x, y) & (G.safe_div(y - pb[1], G.height(pb)) > 0.1)
    cond = (
        (balls["match_id"] == p["match_id"]) & (balls["frame_number"] == p["frame_number"]) & on_body
    )
    return balls.join(p, cond, "left_anti")


def is_shooting_position(df: DataFrame) -> DataFrame:
    return df.filter(
        F.col("zone").isin("shooting_circle_home", "shooting_circle_away")
        & F.col("is_in_possession")
        & F.col("position").isin(SHOOTERS)
    )


def frame_range(
    df: DataFrame, start_sec: float, end_sec: float | None = None, fps: float = FPS, max_frames: int | None = None
) -> DataFrame:
    """Frames ``[int(start * fps), int(end * fps))``, at most ``max_frames`` of them."""
    start = max(0, int(start_sec * fps))
    cond = F.col("frame_number") >= start
    if end_sec is not None:
        cond = cond & (F.col("frame_number") < int(end_sec * fps))
    if max_frames is not None:
        cond = cond & (F.col("frame_number") < start + max_frames)
    return df.filter(cond)


def normalise_fps(df: DataFrame, fps: str = "fps") -> DataFrame:
    """Frame rates outside (0, 100] count as 30; the timestamp follows from it."""
    rate = F.when((F.col(fps) <= 0) | (F.col(fps) > 100) | F.col(fps).isNull(), F.lit(FPS)).otherwise(F.col(fps))
    return df.withColumn(fps, rate).withColumn("ts_sec", F.col("frame_number") / F.col(fps))
