"""Players without a track id keep their rows."""

from courtflow.operators import shooting, zones

SCHEMA = (
    "match_id long, frame_number long, ts_sec double, det_no long, class_name string, track_id long, "
    "x1 double, y1 double, x2 double, y2 double, confidence double, court_x double, court_y double"
)


def scene(spark, track):
    """One player who holds the ball, out of the left circle and back."""
    rows = []
    for f, x in enumerate([1.0, 1.0, 15.0, 15.0, 1.0]):
        rows.append((1, f, f / 30, 1, "ball", None, 10.0, 10.0, 40.0, 40.0, 0.9, x, 7.6))
        rows.append((1, f, f / 30, 2, "player", track, 10.0, 10.0, 42.0, 42.0, 0.9, x, 7.6))
    d = spark.createDataFrame(rows, SCHEMA)
    return d.filter("class_name = 'ball'"), d.filter("class_name = 'player'"), d.select("match_id", "frame_number").distinct()


def without_id(rows, name):
    return sorted(tuple((k, v) for k, v in r.asDict().items() if k != name) for r in rows)


def test_untracked_players_like_tracked_ones(spark):
    balls, tracked, frames = scene(spark, 7)
    _, untracked, _ = scene(spark, None)
    for players, want in ((tracked, 7), (untracked, None)):
        moves = zones.zone_transitions(players, size=2).collect()
        assert [(r.track_id, r.frame_number) for r in sorted(moves, key=lambda r: r.frame_number)] == [(want, 2), (want, 4)]
        (row,) = zones.zone_transition_summary(players, size=2).collect()
        assert (row.track_id, row.total_transitions, len(row.zones_visited)) == (want, 2, 2)
        (shot,) = shooting.new_shot_attempts(balls, players, frames, size=2).collect()
        assert (shot.player_id, shot.frame_number, shot.shooting_circle) == (want, 0, "shooting_circle_left")
    a = shooting.new_shot_attempts(balls, tracked, frames, size=2).collect()
    b = shooting.new_shot_attempts(balls, untracked, frames, size=2).collect()
    assert without_id(a, "player_id") == without_id(b, "player_id")
