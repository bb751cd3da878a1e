"""Hand-written cases for standings, zones, geometry, shots and text reads."""

import math

import pytest
from pyspark.sql import functions as F

from courtflow.functions import court, geometry, shots, text
from courtflow.operators import calibration, filters, ocr, possession, quality, shooting, standings, zones
from courtflow.sources import readers, sinks


def games(spark, rows):
    data = [(i, h, a, hs, as_, c) for i, (h, a, hs, as_, c) in enumerate(rows)]
    return spark.createDataFrame(data, "game_id long, home_team string, away_team string, home_score long, away_score long, category string").withColumn("game_date", F.lit("2025-01-01").cast("date"))


LEAGUE = [
    ("A", "B", 15, 12, "U15"), ("C", "D", 18, 14, "U15"), ("A", "C", 16, 13, "U15"), ("B", "D", 14, 16, "U15"),
    ("A", "D", 17, 15, "U15"), ("B", "C", 13, 19, "U15"), ("E", "F", 12, 10, "U18"), ("G", "H", 20, 18, "U18"),
]


def test_league(spark):
    table = standings.league_table(standings.standings(games(spark, LEAGUE)))
    rows = {r.team: r for r in table.collect()}
    a = rows["A"]
    assert (a.position, a.won, a.points, a.goals_for, a.goals_against) == (1, 3, 6, 48, 40)
    assert {r.team for r in rows.values() if r.category == "U18" and r.position == 1} == {"E"}  # better goal average
    assert sum(r.won for r in rows.values()) == sum(r.lost for r in rows.values()) == 8
    stats = standings.team_statistics(table).filter("team = 'A'").first()
    assert stats.win_rate == 1.0 and stats.goals_per_game == 16.0


def test_goal_average(spark):
    rows = {r.team: r for r in standings.standings(games(spark, [("A", "B", 20, 10, "x"), ("B", "A", 20, 10, "x"), ("C", "D", 10, 0, "x")])).collect()}
    assert rows["A"].goal_average == 1.0 and math.isinf(rows["C"].goal_average) and rows["D"].goal_average == 0.0


def test_full_tie_keeps_first_appearance(spark):
    table = standings.league_table(standings.standings(games(spark, [("Z", "Y", 5, 5, "x"), ("B", "A", 5, 5, "x")])))
    assert [r.team for r in table.orderBy("position").collect()] == ["Z", "Y", "B", "A"]
    assert {r.tie_rank for r in standings.tie_breaker(table).collect()} == {1}


def test_head_to_head(spark):
    g = games(spark, [("A", "B", 15, 12, "x"), ("B", "A", 14, 16, "x"), ("A", "C", 1, 2, "x")])
    r = standings.head_to_head_summary(g).filter("team2 = 'B'").first()
    assert (r.team1_wins, r.team2_wins, r.draws, r.team1_goals, r.team2_goals) == (2, 0, 0, 31, 26)
    assert standings.head_to_head(g, "B", "A", "x").count() == 2


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


@pytest.mark.parametrize(
    "x,y,zone",
    [
        (0.0, 7.625, "goal_circle_left"),
        (30.5, 7.625, "goal_circle_right"),
        (15.25, 7.625, "center_circle"),
        (15.25, 1.0, "center_third"),
        (5.0, 1.0, "goal_third_left"),
        (28.0, 14.0, "goal_third_right"),
        (-1.0, 5.0, "out_of_bounds"),
        (31.0, 5.0, "out_of_bounds"),
        (10.0, -0.1, "out_of_bounds"),
        (10.0, 15.3, "out_of_bounds"),
        (4.9, 7.625, "goal_circle_left"),
    ],
)
def test_zone_points(spark, x, y, zone):
    assert one(spark, z=court.classify_zone(F.lit(x), F.lit(y))).z == zone


@pytest.mark.parametrize(
    "position,zone,ok",
    [("GS", "goal_circle_left", True), ("GS", "center_third", False), ("C", "center_circle", True),
     ("GK", "goal_third_left", False), ("unknown", "goal_circle_left", True), (None, "center_third", True)],
)
def test_positions(spark, position, zone, ok):
    assert one(spark, v=court.is_position_valid(F.lit(position).cast("string"), F.lit(zone))).v is ok


PLAYER = "match_id long, frame_number long, det_no long, track_id long, team string, position string, court_x double, court_y double, ts_sec double"


def players(spark, rows):
    return spark.createDataFrame([(1, 0, i + 1, i + 1, *r, 0.0) for i, r in enumerate(rows)], PLAYER)


def test_violations(spark):
    df = players(
        spark,
        [
            ("home", "C", 15.0, 3.0),  # fine
            ("home", "C", -0.5, 3.0),  # out of bounds
            ("home", "GS", 15.0, 3.0),  # restricted
            ("home", "C", 15.0, 0.2),  # sideline
            ("home", "GS", 1.0, 7.0), ("home", "GA", 2.0, 7.0), ("home", "GA", 2.0, 8.0),  # three in the circle
            ("away", "C", 15.2, 7.6), ("away", "C", 15.3, 7.6),  # two in the centre circle
        ],
    )
    base = {r.player_id: r.violation_type for r in zones.zone_violations(df).collect()}
    assert base == {2: "out_of_bounds", 3: "position_restriction", 4: "sideline_proximity"}
    every = zones.enhanced_zone_violations(df).collect()
    kinds = sorted((r.player_id, r.violation_type) for r in every if "overflow" in r.violation_type)
    assert kinds == [(5, "goal_circle_overflow"), (6, "goal_circle_overflow"), (7, "goal_circle_overflow"),
                     (8, "center_circle_overflow"), (9, "center_circle_overflow")]
    assert (2, "position_restriction") in {(r.player_id, r.violation_type) for r in every}  # hidden by out of bounds
    marginals = {(r.grouping, r.value): r.n for r in zones.violation_marginals(zones.enhanced_zone_violations(df)).collect()}
    assert marginals["total", "all"] == len(every) and marginals["severity", "critical"] == 5


def test_home_away_rules(spark):
    rows = [(p, z) for p, z in [("GS", "shooting_circle_home"), ("GA", "goal_third_home"), ("WA", "centre_third"),
            ("C", "centre_third"), ("WD", "centre_third"), ("GD", "goal_third_away"), ("GK", "shooting_circle_away")]]
    schema = "match_id long, frame_number long, track_id long, team string, position string, zone string"
    frame = lambda rows: spark.createDataFrame([(1, 0, i, "home", p, z) for i, (p, z) in enumerate(rows)], schema)
    assert zones.home_away_zone_violations(frame(rows)).count() == 0
    wrong = zones.zone_rule_violations(frame([*rows, ("GS", "centre_third")])).collect()
    assert [(r.track_id, r.zone) for r in wrong] == [(7, "centre_third")]
    crowd = zones.max_players_violations(frame(rows + [("C", "centre_third")] * 3)).collect()
    assert [(r.current_count, r.max_players) for r in crowd] == [(6, 5)]


def test_transition_pair(spark):
    schema = "match_id long, track_id long, zone string, team string"
    a = spark.createDataFrame([(1, 1, "shooting_circle_home", "home"), (1, 2, "centre_third", "away")], schema)
    b = spark.createDataFrame([(1, 1, "centre_third", "home"), (1, 2, "centre_third", "away")], schema)
    got = zones.zone_transitions_between(a, b).collect()
    assert [(r.track_id, r.from_zone, r.to_zone) for r in got] == [(1, "shooting_circle_home", "centre_third")]


def test_boxes(spark):
    lit = lambda *b: tuple(F.lit(float(v)) for v in b)
    r = one(
        spark,
        same=geometry.iou(lit(0, 0, 2, 2), lit(0, 0, 2, 2)),
        half=geometry.iou(lit(0, 0, 2, 2), lit(1, 0, 3, 2)),
        none=geometry.iou(lit(0, 0, 1, 1), lit(1, 1, 2, 2)),
        flat=geometry.iou(lit(0, 0, 0, 0), lit(0, 0, 0, 0)),
        inside=geometry.ball_containment(lit(4, 4, 6, 6), lit(0, 0, 10, 20)),
        outside=geometry.ball_containment(lit(14, 4, 16, 6), lit(0, 0, 10, 20)),
        point=geometry.ball_containment(lit(14, 4, 16, 6), lit(0, 0, 0, 0)),
    )
    assert (r.same, r.none, r.flat, r.inside, r.outside, r.point) == (1.0, 0.0, 0.0, 1.0, 0.75, 0.0)
    assert r.half == pytest.approx(1 / 3)


def test_homography(spark):
    h = [0.05, 0.002, -1.0, 0.001, 0.07, 0.5, 1e-4, 2e-4, 1.0]
    d = spark.createDataFrame([(h, float(x), float(y)) for x in (0, 100, 555) for y in (3, 200)], "h array<double>, x double, y double")
    cx, cy = geometry.pixel_to_court("h", "x", "y")
    d = d.withColumn("inv", geometry.inverse("h")).withColumn("cx", cx).withColumn("cy", cy)
    px, py = geometry.court_to_pixel("inv", "cx", "cy")
    for r in d.select("x", "y", px.alias("px"), py.alias("py")).collect():
        assert (r.px, r.py) == pytest.approx((r.x, r.y))
    flat = [0.0] * 9
    cases = spark.createDataFrame(
        [(h, 0.5), (flat, 0.5), (h, 0.0), (h[:8], 0.5), ([float("nan"), *h[1:]], 0.5), ([float("inf"), *h[1:]], 0.5)], "h array<double>, c double"
    )
    assert [r.ok for r in cases.select(geometry.matrix_ok("h", "c").alias("ok")).collect()] == [True] + [False] * 5


def test_round_trip_on_the_horizon(spark):
    h = [0.05, 0.002, -1.0, 0.001, 0.07, 0.5, 1e-3, 0.0, 0.0]  # pixels with x = 0 have no court position
    d = spark.createDataFrame([(h, 0.0, 84.0), (h, 0.0, 0.0), (h, 314.0, 7.0)], "h array<double>, x double, y double")
    cx, cy = geometry.pixel_to_court("h", "x", "y")
    d = d.withColumns({"inv": geometry.inverse("h"), "cx": cx, "cy": cy, "w": geometry.court_weight("h", "x", "y")})
    px, py = geometry.court_to_pixel("inv", "cx", "cy", "w")
    rows = d.select("x", "y", "w", px.alias("px"), py.alias("py")).collect()
    assert [r.w for r in rows] == [0.0, 0.0, 1.0]
    for r in rows:
        assert (r.px, r.py) == pytest.approx((r.x, r.y), abs=1e-9)


def test_calibration_in_force(spark):
    cal = spark.createDataFrame([(1, 10, [1.0] * 9), (1, 20, [2.0] * 9)], "match_id long, from_frame long, h array<double>")
    df = spark.createDataFrame([(1, f, 1) for f in (5, 10, 19, 20, 99)] + [(2, 50, 1)], "match_id long, frame_number long, det_no long")
    got = {(r.match_id, r.frame_number): r.h and r.h[0] for r in calibration.calibration_as_of(df, cal, size=7).collect()}
    assert got == {(1, 5): None, (1, 10): 1.0, (1, 19): 1.0, (1, 20): 2.0, (1, 99): 2.0, (2, 50): None}


def test_shot_distances(spark):
    posts = ((50.0, 250.0), (600.0, 250.0))
    r = one(
        spark,
        home=shots.distance_to_goal(F.lit("home"), F.lit(100.0), F.lit(100.0), *posts),
        away=shots.distance_to_goal(F.lit("away"), F.lit(100.0), F.lit(100.0), *posts),
        none=shots.distance_to_goal(F.lit("home"), F.lit(1.0), F.lit(1.0), None, None),
        prior=shots.shot_confidence_prior(F.lit(1.0), F.lit(10.0), F.lit("GS")),
        far=shots.shot_success_probability(F.lit(6.0), F.lit(60.0), F.lit("GA")),
    )
    assert r.home == pytest.approx(math.hypot(500, 150)) and r.away == pytest.approx(math.hypot(50, 150)) and r.none == 0.0
    assert r.prior == pytest.approx(0.9) and r.far == pytest.approx(0.6 * 0.8 * 0.9)


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(float(d), "goal" if d % 2 else "miss") for d in range(11)], "distance_to_goal double, result string")
    got = {r.bin: r.attempts for r in shooting.success_rate_by_distance_bin(df).collect()}
    assert got == {0: 3, 1: 2, 2: 2, 3: 2, 4: 2}
    same = spark.createDataFrame([(4.0, "goal")] * 3, "distance_to_goal double, result string")
    assert [(r.bin, r.attempts) for r in shooting.success_rate_by_distance_bin(same).collect()] == [(2, 3)]


def test_jersey_vote(spark):
    reads = [("7", 0.9), ("1", 0.5), ("1", 0.5), ("x7", 0.95)]
    df = spark.createDataFrame([(1, f, 1, t, c, 5) for f, (t, c) in enumerate(reads)], "match_id long, frame_number long, det_no long, text string, confidence double, player_id long")
    r = ocr.jersey_vote(df).first()
    assert r.jersey_number == 1 and r.confidence == pytest.approx(0.7 * (1.0 / 1.9) + 0.3 * 0.3) and r.team_assignment == "away"
    assert (r.detection_count, r.first_detected_frame, r.last_detected_frame) == (4, 0, 3)
    letters = df.filter("text = 'x7'").withColumn("text", F.lit("GS"))
    r = ocr.jersey_vote(letters).first()
    assert r.jersey_number is None and r.confidence == 0.95 and r.team_assignment is None


def test_text(spark):
    r = one(
        spark,
        a=text.ocr_clean(F.lit(" c-7 é9")),
        b=text.bib_token(F.lit("g s!")),
        c=text.bib_token(F.lit("xx")),
        d=text.color_distance_hsv((F.lit(255), F.lit(0), F.lit(0)), (F.lit(255), F.lit(0), F.lit(4))),
    )
    assert (r.a, r.b, r.c) == ("c7é", "GS", None) and r.d < 0.01


def test_truth_modes(spark):
    p = spark.createDataFrame([(1, f, v) for f, v in enumerate([1, 2, None, 1, 1])], "match_id long, frame_number long, pred_player long")
    t = spark.createDataFrame([(1, f, v) for f, v in enumerate([1, 1, None, None])], "match_id long, frame_number long, true_player long")
    pairs = quality.validate_against_truth(p, t, size=2)
    r = quality.confusion_metrics(pairs).first()
    assert (r.total_frames, r.tp, r.fp, r.fn, r.tn) == (5, 1, 1, 0, 2) and r.accuracy == pytest.approx(3 / 5)
    r = quality.confusion_metrics(pairs, mode="strict").first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 2, 0, 1)


def test_missing_table_is_empty(spark, tmp_path):
    d = readers.read_shot_attempts(spark, str(tmp_path / "none.csv"))
    assert d.count() == 0 and "shooting_circle" in d.columns
    with pytest.raises(Exception):
        readers.read_detections(spark, str(tmp_path / "none.csv"))


def test_bad_reports_are_left_out(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "validation_report_1.json").write_text('{"video_name": "v", "metrics": {"total_frames": 5, "true_positives": 3}}')
    (tmp_path / "validation_report_2.json").write_text('{"video_name": ')
    (tmp_path / "other.json").write_text('{"video_name": "no"}')
    rows = readers.read_validation_reports(spark, str(tmp_path)).collect()
    assert [(r.video_name, r.total_frames, r.tp) for r in rows] == [("v", 5, 3)]


def test_bucketed_frames_join_without_shuffle(spark, tmp_path):
    d = spark.range(200).selectExpr("id % 4 AS match_id", "id AS frame_number", "1L AS det_no")
    name = "bucketed_detections"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    sinks.write_detections_bucketed(d, name, buckets=4, path=str(tmp_path / "t"))
    t = spark.table(name)
    plan = t.groupBy("match_id", "frame_number").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql(f"DROP TABLE {name}")


def test_off_court_filter_only_drops_players(spark):
    df = spark.createDataFrame([("player", -1.0, 1.0), ("player", 3.0, 3.0), ("ball", -1.0, 1.0)], "class_name string, court_x double, court_y double")
    assert sorted(r.class_name for r in filters.drop_off_court(df).collect()) == ["ball", "player"]


def test_events_layout(spark):
    s = spark.createDataFrame([(1, 1.0, 3, "home", "goal", "z", 2.5)], "match_id long, ts_sec double, shooter_id long, team string, result string, zone string, distance_to_goal double")
    p = spark.createDataFrame([(1, 2.0, 4, "away", "lost")], "match_id long, ts_sec double, player_id long, team string, event_type string")
    rows = {r.event_type: r for r in sinks.events_table(s, p).collect()}
    assert rows["possession_lost"].result == "" and rows["possession_lost"].distance is None and rows["shot"].distance == 2.5


def test_pass_edges(spark):
    changes = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 5, 9), (1, 8, 9, 20)], "match_id long, player_id long, start_frame long, end_frame long")
    teams = spark.createDataFrame([(1, 1, "home"), (1, 2, "home"), (1, 8, "away")], "match_id long, player_id long, team string")
    got = [(r.src, r.dst, r.kind) for r in possession.pass_edges(changes, teams, size=4).orderBy("frame_number").collect()]
    assert got == [(1, 2, "pass"), (2, 8, "interception")]


def test_ball_read_bounds_are_inclusive(spark):
    from courtflow.operators.filters import filter_ball_reads

    boxes = [(10.0, 10.0), (100.0, 50.0), (50.0, 100.0), (100.0, 49.0), (9.0, 10.0), (101.0, 60.0)]
    df = spark.createDataFrame([(0.5, 0.0, 0.0, w, h) for w, h in boxes], "confidence double, x1 double, y1 double, x2 double, y2 double")
    assert [(r.x2, r.y2) for r in filter_ball_reads(df).collect()] == boxes[:3]


def test_overflow_counts_players_without_team(spark):
    from courtflow.operators.zones import overflow_violations

    rows = [(1, 1, 0.0, i, None, "C", 3.0, 7.6) for i in range(4)]
    df = spark.createDataFrame(rows, "match_id long, frame_number long, ts_sec double, track_id long, team string, position string, court_x double, court_y double")
    assert overflow_violations(df).count() == 4
    assert overflow_violations(df.withColumn("team", F.lit("home"))).count() == 4


def test_job_at_the_speed_limit_in_any_order(spark):
    from courtflow.operators import service

    rows = [(j, 1, s) for j, times in ((1, (0.1, 0.2, 0.3)), (2, (0.3, 0.2, 0.1))) for s in times] + [(3, 1, float("nan"))]
    samples = spark.createDataFrame(rows, "job_id long, frames long, seconds double").coalesce(1).selectExpr(
        "*", "timestamp'2024-01-01' AS timestamp", "0 AS errors", "1e0 AS memory_mb", "1e0 AS cpu_percent"
    )
    jobs = service.processing_metrics(samples)
    got = {r.job_id: (r.processing_time, r.fps) for r in jobs.collect()}
    assert got[1] == got[2] == (0.6, 5.0)  # 0.6000000000000001 when added as doubles in one of the orders
    assert got[3][0] != got[3][0]
    assert service.job_alerts(jobs.filter("job_id <> 3")).count() == 0


def test_smoothing_shuffles_no_pairs(spark):
    box = "0D AS x1, 0D AS y1, 10D + f AS x2, 10D AS y2, f / 10D AS confidence"
    d = spark.sql(f"SELECT 0L AS match_id, f AS frame_number, 'ball' AS class_name, n AS det_no, {box} FROM VALUES (1L, 1L), (3L, 1L), (4L, 1L), (4L, null), (9L, 1L) t(f, n)")
    frames = spark.sql("SELECT 0L AS match_id, f AS frame_number FROM VALUES (1L), (3L), (4L), (5L) t(f)")
    for size in (2, 1000):
        got = quality.smooth_bbox_mean3(d, frames, size=size)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        rows = {(r.frame_number, r.det_no): round(r.x2, 6) for r in got.collect()}
        assert rows == {(1, 1): 11.0, (3, 1): 13.0, (4, 1): 13.0, (4, None): 14.0}
