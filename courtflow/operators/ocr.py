"""Jersey numbers, bib letters and team colours from text and colour reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.functions import geometry as G
from courtflow.functions.geometry import safe_div
from courtflow.functions.text import color_distance_rgb, confidence_level, is_numeric, ocr_clean
from courtflow.operators.filters import likely_jersey_number
from courtflow.session import cut_lineage

FRAME = ["match_id", "frame_number"]
PLAYER = ["match_id", "player_id"]


def clean_reads(reads: DataFrame, max_len: int = 3) -> DataFrame:
    """Cleaned text with its number (null unless all digits) and confidence level."""
    d = reads.withColumn("text", ocr_clean("text", max_len))
    return d.withColumns(
        {
            "jersey_number": F.when(is_numeric("text"), F.col("text").try_cast("bigint")),
            "confidence_level": confidence_level("confidence"),
        }
    )


def _weight(c):
    # summed as a decimal: the vote must not depend on the order rows arrive in
    return F.sum(c.cast("decimal(28,9)"))


def jersey_vote(reads: DataFrame) -> DataFrame:
    """Per player: the number with most summed confidence (first seen wins ties),
    how sure that is, the frames it was seen in, and the team by number parity.

    Two aggregates; the first one, per (player, number), absorbs long histories."""
    d = clean_reads(reads)
    per_number = d.groupBy(*PLAYER, "jersey_number").agg(
        F.count(F.lit(1)).alias("n"),
        _weight(F.col("confidence")).alias("w"),
        F.max("confidence").alias("top"),
        F.min(F.struct("frame_number", "det_no")).alias("seen"),
        F.max("frame_number").alias("last"),
    )
    num = F.col("jersey_number").isNotNull()
    early = (-F.col("seen.frame_number"), -F.col("seen.det_no"))
    voted = per_number.groupBy(*PLAYER).agg(
        F.max_by("jersey_number", F.when(num, F.struct("w", *early))).alias("jersey_number"),
        F.max(F.when(num, F.col("w"))).alias("best"),
        F.sum(F.when(num, F.col("w"))).alias("total"),
        F.coalesce(F.sum(F.when(num, F.col("n"))), F.lit(0)).alias("numeric_count"),
        F.max_by("jersey_number", F.when(num, F.struct("n", *early))).alias("modal_number"),
        F.max("top").alias("top"),
        F.min("seen.frame_number").alias("first_detected_frame"),
        F.max("last").alias("last_detected_frame"),
        F.sum("n").alias("detection_count"),
    )
    share = safe_div(F.col("best").cast("double"), F.col("total").cast("double"))
    sure = F.lit(0.7) * share + F.lit(0.3) * F.least(F.col("numeric_count") / F.lit(10.0), F.lit(1.0))
    span = F.col("last_detected_frame") - F.col("first_detected_frame") + 1
    out = voted.withColumns(
        {
            "confidence": F.when(F.col("numeric_count") > 0, sure).otherwise(F.col("top")),
            "team_assignment": F.when(F.col("modal_number") % 2 == 0, "home").when(F.col("modal_number") % 2 == 1, "away"),
            "detection_frequency": F.col("detection_count") / span,
        }
    )
    out = out.withColumns(
        {
            "is_confident": (F.col("confidence") >= 0.5) & (F.col("detection_count") >= 3),
            "is_reliable": F.col("jersey_number").isNotNull()
            & (F.col("confidence") >= 0.6)
            & (F.col("detection_count") >= 5),
        }
    )
    return out.drop("best", "total", "top", "numeric_count", "modal_number")


def confident_players(votes: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    return votes.filter(F.col("is_confident") & (F.col("confidence") >= min_confidence))


def jersey_summary(votes: DataFrame) -> DataFrame:
    """Confident players per number."""
    d = votes.filter(F.col("is_confident") & F.col("jersey_number").isNotNull())
    return d.groupBy("match_id", "jersey_number").agg(F.count(F.lit(1)).alias("players"))


def tracking_statistics(votes: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    return votes.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("total_players_tracked"),
        F.count_if(F.col("is_confident") & (F.col("confidence") >= min_confidence)).alias("confident_players"),
        F.sum("detection_count").alias("total_detections"),
        (F.sum("detection_count") / F.count(F.lit(1))).alias("average_detections_per_player"),
    )


def jersey_expiry(reads: DataFrame, max_age: int = 100) -> DataFrame:
    """Reads no older than ``max_age`` frames before their match's last read."""
    last = reads.groupBy("match_id").agg(F.max("frame_number").alias("__last"))
    return reads.join(last, "match_id").filter(F.col("__last") - F.col("frame_number") <= max_age).drop("__last")


def _expanded(prefix: str, by: float = 0.1):
    b = G.box(prefix)
    dw, dh = G.width(b) * F.lit(by), G.height(b) * F.lit(by)
    return b[0] - dw, b[1] - dh, b[2] + dw, b[3] + dh


def ocr_in_player_region(reads: DataFrame, players: DataFrame) -> DataFrame:
    """Likely numbers whose centre lies in a player box widened by a tenth."""
    r = likely_jersey_number(reads)
    p = players.select(*FRAME, *[F.col(c).alias("p_" + c) for c in G.BOX])
    b = G.box()
    inside = G.contains_point(_expanded("p_"), G.center_x(b), G.center_y(b))
    cond = (r["match_id"] == p["match_id"]) & (r["frame_number"] == p["frame_number"]) & inside
    return r.join(p, cond, "left_semi")


def ocr_player_match(reads: DataFrame, players: DataFrame) -> DataFrame:
    """The same reads with the first player (by detection number) containing them."""
    r = likely_jersey_number(reads)
    p = players.select(*FRAME, F.col("det_no").alias("player_no"), "track_id", *[F.col(c).alias("p_" + c) for c in G.BOX])
    b = G.box()
    hit = r.join(p, FRAME).filter(G.contains_point(_expanded("p_"), G.center_x(b), G.center_y(b)))
    first = F.min_by(F.struct("player_no", "track_id", "text", "confidence"), F.col("player_no")).alias("p")
    return hit.groupBy(*FRAME, "det_no").agg(first).select(*FRAME, "det_no", "p.*")


def jersey_on_detections(players: DataFrame, reads: DataFrame) -> DataFrame:
    """Player rows with the frame's first non-zero number."""
    d = clean_reads(reads).filter(F.coalesce("jersey_number", F.lit(0)) != 0)
    first = d.groupBy(*FRAME).agg(
        F.min_by(F.struct("jersey_number", F.col("confidence").alias("jersey_confidence")), F.col("det_no")).alias("j")
    )
    return players.join(first, FRAME, "left").select(*players.columns, "j.jersey_number", "j.jersey_confidence")


def bib_positions(reads: DataFrame) -> DataFrame:
    """Position codes read, in the fixed layout of the bib table."""
    from courtflow.functions.text import bib_token

    d = reads.withColumn("position", bib_token("text")).filter(F.col("position").isNotNull())
    return d.select(*FRAME, "timestamp", "position", "confidence", *G.BOX, "player_id")


def jersey_table(votes: DataFrame) -> DataFrame:
    """Per-player vote table in its fixed layout."""
    return votes.select(
        "match_id", "player_id", "jersey_number", "confidence", "team_assignment",
        "first_detected_frame", "last_detected_frame", "detection_count", "is_confident",
    )


# -- team colours ------------------------------------------------------------------


def nearest_team_color(
    colors: DataFrame, home: tuple[int, int, int], away: tuple[int, int, int]
) -> DataFrame:
    """Team per player row from its closest colour; a tie goes to away.
    ``colors``: match_id, frame_number, det_no, r, g, b (one row per colour)."""
    rgb = ("r", "g", "b")
    to = lambda c: F.min(color_distance_rgb(rgb, tuple(F.lit(v) for v in c)))
    d = colors.groupBy(*FRAME, "det_no").agg(to(home).alias("home_distance"), to(away).alias("away_distance"))
    return d.withColumn("team", F.when(F.col("home_distance") < F.col("away_distance"), "home").otherwise("away"))


def team_color_stats(colors: DataFrame) -> DataFrame:
    """Colour count and whole-number channel means per match and team."""
    mean = lambda c: F.floor(F.sum(c) / F.count(F.lit(1))).cast("long")
    return colors.groupBy("match_id", "team").agg(
        F.count(F.lit(1)).alias("color_count"), *[mean(c).alias(f"avg_{c}") for c in ("r", "g", "b")]
    )


def cluster_teams(colors: DataFrame, iterations: int = 20, epsilon: float = 1.0) -> DataFrame:
    """Two teams per match by clustering its colours; a player takes the cluster of its last
    colour. The darker centre is called home.

    All matches are clustered at once. A match starts from its darkest colour and the one farthest from
    it; each round takes the means of both clusters as sums combined before the shuffle, and a match is
    done when no centre moved more than ``epsilon``. Distinct colours are counted once."""
    rgb = ["r", "g", "b"]
    tint = F.struct(*[F.col(c).cast("double").alias(c) for c in rgb])
    tones = colors.filter(F.greatest(*rgb).isNotNull()).groupBy("match_id", tint.alias("c")).agg(F.count(F.lit(1)).alias("n"))
    tones = cut_lineage(tones, "tones")
    off = lambda a, b: sum((a[x] - b[x]) * (a[x] - b[x]) for x in rgb)
    sum_of = lambda c: c["r"] + c["g"] + c["b"]
    same = lambda d: F.col("t.match_id").eqNullSafe(F.col(f"{d}.match_id"))
    dark = tones.groupBy("match_id").agg(F.min(F.struct(sum_of(F.col("c")).alias("s"), "c")).alias("d")).select("match_id", F.col("d.c").alias("c0"))
    far = tones.alias("t").join(dark.alias("d"), same("d")).groupBy("d.match_id", "d.c0")
    centres = far.agg(F.max(F.struct(off(F.col("t.c"), F.col("d.c0")).alias("far"), "t.c")).alias("f"))
    centres = cut_lineage(centres.select("match_id", "c0", F.col("f.c").alias("c1"), F.lit(False).alias("done")), "centres")
    nearer = F.col("k") == 0
    for _ in range(iterations):
        open_ = centres.filter(~F.col("done"))
        d = tones.alias("t").join(open_.alias("o"), same("o"))
        d = d.select("o.match_id", "o.c0", "o.c1", "t.c", "t.n", F.when(off(F.col("t.c"), F.col("o.c0")) <= off(F.col("t.c"), F.col("o.c1")), 0).otherwise(1).alias("k"))
        sums = {f"{x}{k}": F.sum(F.when(nearer if k == 0 else ~nearer, F.col(f"c.{x}") * F.col("n"))) for x in rgb for k in (0, 1)}
        sums |= {f"n{k}": F.sum(F.when(nearer if k == 0 else ~nearer, F.col("n"))) for k in (0, 1)}
        d = d.groupBy("match_id", "c0", "c1").agg(*[c.alias(name) for name, c in sums.items()])
        mean = lambda k: F.coalesce(F.when(F.col(f"n{k}") > 0, F.struct(*[(F.col(f"{x}{k}") / F.col(f"n{k}")).alias(x) for x in rgb])), F.col(f"c{k}"))
        d = d.withColumns({"m0": mean(0), "m1": mean(1)})
        moved = F.greatest(off(F.col("m0"), F.col("c0")), off(F.col("m1"), F.col("c1")))
        d = d.select("match_id", F.col("m0").alias("c0"), F.col("m1").alias("c1"), (moved <= epsilon * epsilon).alias("done"))
        centres = cut_lineage(centres.filter("done").unionByName(d), "centres")
        if centres.filter(~F.col("done")).isEmpty():
            break
    latest = colors.filter(F.greatest(*rgb).isNotNull()).groupBy(*PLAYER)
    latest = latest.agg(F.max_by(tint, F.struct("frame_number", "det_no", "color_no")).alias("c"))
    d = latest.alias("t").join(centres.alias("o"), same("o"))
    first = off(F.col("t.c"), F.col("o.c0")) <= off(F.col("t.c"), F.col("o.c1"))
    home = sum_of(F.col("o.c0")) <= sum_of(F.col("o.c1"))
    return d.select(*[f"t.{k}" for k in PLAYER], F.when(first == home, "home").otherwise("away").alias("team"))
