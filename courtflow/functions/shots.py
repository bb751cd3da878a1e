"""Shot geometry and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtflow.constants import (
    COURT_LENGTH,
    COURT_WIDTH,
    GOAL_CIRCLE_RADIUS,
    POSSESSION_MAX_DISTANCE,
    POSSESSION_OVERLAP,
    REPORT_LENGTH,
    REPORT_WIDTH,
)
from courtflow.functions.geometry import _c, euclidean


def possession_confidence(distance, score, mode: str = "containment", reach: float = POSSESSION_MAX_DISTANCE) -> Column:
    near = F.greatest(F.lit(0.0), F.lit(1.0) - _c(distance) / F.lit(reach))
    a, b = (0.3, 0.7) if mode == "containment" else (0.4, 0.6)
    return F.lit(a) * near + F.lit(b) * _c(score)


def possession_reason(distance, score, mode: str = "containment", threshold: float = POSSESSION_OVERLAP) -> Column:
    label = "containment" if mode == "containment" else "overlap"
    return F.when(
        _c(score) > threshold, F.format_string(f"{label}_%.2f_distance_%.1f", _c(score), _c(distance))
    ).otherwise(F.format_string(f"proximity_%.1f_{label}_%.2f", _c(distance), _c(score)))


def circle_centre_x(circle, length: float = COURT_LENGTH) -> Column:
    """x of the goal for a ``*_left`` / ``*_right`` circle."""
    return F.when(_c(circle).endswith("_left"), F.lit(0.0)).otherwise(F.lit(length))


def shot_distance_edge(circle, x, y, length: float = COURT_LENGTH, width: float = COURT_WIDTH) -> Column:
    """Distance beyond the edge of the circle; 0 inside."""
    d = euclidean(x, y, circle_centre_x(circle, length), F.lit(width / 2))
    return F.greatest(F.lit(0.0), d - F.lit(GOAL_CIRCLE_RADIUS))


def shot_angle(circle, x, y, length: float = COURT_LENGTH, width: float = COURT_WIDTH) -> Column:
    """Angle from ball to hoop, degrees."""
    return F.degrees(F.atan2(F.lit(width / 2) - _c(y), circle_centre_x(circle, length) - _c(x)))


def shot_attempt_confidence(ball_player_distance, shot_distance) -> Column:
    d, s = _c(ball_player_distance), _c(shot_distance)
    near = F.greatest(F.lit(0.0), F.lit(1.0) - d / F.lit(30.0))
    place = F.when(s < 2.0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - (s - F.lit(2.0)) / F.lit(3.0))
    )
    return near * F.lit(0.6) + place * F.lit(0.4)


def distance_to_goal(team, x, y, home_goal: tuple[float, float] | None, away_goal: tuple[float, float] | None) -> Column:
    """Distance to the middle of the opponent's posts; 0 where they are unknown."""

    def to(goal):
        return F.lit(0.0) if goal is None else euclidean(x, y, F.lit(goal[0]), F.lit(goal[1]))

    return F.when(_c(team) == "home", to(away_goal)).otherwise(to(home_goal))


def angle_to_goal(team, x, y, home_goal, away_goal) -> Column:
    def to(goal):
        if goal is None:
            return F.lit(0.0)
        return F.degrees(F.atan2(F.lit(goal[1]) - _c(y), F.lit(goal[0]) - _c(x)))

    return F.when(_c(team) == "home", to(away_goal)).otherwise(to(home_goal))


def shot_confidence_prior(distance, angle, position) -> Column:
    """0.5 with bonuses for distance, angle and position, clamped to [0, 1]."""
    d, a, p = _c(distance), F.abs(_c(angle)), _c(position)
    score = (
        F.lit(0.5)
        + F.when(d < 3.0, 0.2).when(d > 6.0, -0.2).otherwise(0.0)
        + F.when(a < 30, 0.1).when(a > 60, -0.1).otherwise(0.0)
        + F.when(p == "GS", 0.1).when(p == "GA", 0.05).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def shot_success_probability(distance, angle, position) -> Column:
    """The rate a shot is expected to go in with; no random draw is made."""
    d, a, p = _c(distance), F.abs(_c(angle)), _c(position)
    return (
        F.lit(0.6)
        * F.when(d > 5.0, 0.8).when(d < 2.0, 1.2).otherwise(1.0)
        * F.when(a > 45, 0.9).otherwise(1.0)
        * F.when(p == "GS", 1.1).otherwise(1.0)
    )


def _report_goals(x, y):
    mid = F.lit(REPORT_WIDTH / 2)
    return euclidean(x, y, F.lit(0.0), mid), euclidean(x, y, F.lit(REPORT_LENGTH), mid)


def shooting_range_zone(x, y) -> Column:
    """Side and range band on the rounded report court."""
    left, right = _report_goals(x, y)
    on_left = _c(x) < REPORT_LENGTH / 2
    d = F.when(on_left, left).otherwise(right)
    band = (
        F.when(d <= GOAL_CIRCLE_RADIUS, "goal_circle")
        .when(d <= GOAL_CIRCLE_RADIUS * 1.5, "close_range")
        .when(d <= GOAL_CIRCLE_RADIUS * 2.5, "medium_range")
        .otherwise("long_range")
    )
    return F.concat(F.when(on_left, "left_").otherwise("right_"), band)


def nearest_goal_distance(x, y) -> Column:
    return F.least(*_report_goals(x, y))


def nearest_goal_angle(x, y) -> Column:
    left, right = _report_goals(x, y)
    gx = F.when(left < right, F.lit(0.0)).otherwise(F.lit(REPORT_LENGTH))
    return F.degrees(F.atan2(F.abs(_c(y) - F.lit(REPORT_WIDTH / 2)), F.abs(_c(x) - gx)))


def hoop_quality(confidence, box_area) -> Column:
    """Confidence times how close the area is to the favoured 10,000 square pixels."""
    size = F.lit(1.0) - F.abs(_c(box_area) - F.lit(10000.0)) / F.lit(10000.0)
    return _c(confidence) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), size))
