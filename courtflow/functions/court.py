"""Court zones and bounds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtflow.constants import (
    CENTRE_CIRCLE_RADIUS,
    COURT_LENGTH,
    COURT_WIDTH,
    GOAL_CIRCLE_RADIUS,
    POSITION_ZONES,
    SIDELINE_MARGIN,
    ZONE_BY_POSITION,
)
from courtflow.functions.geometry import _c, court_to_pixel, euclidean, in_convex_quad


def zone_shapes(length: float = COURT_LENGTH, width: float = COURT_WIDTH) -> list[tuple]:
    """Zones in order of priority: (name, 'circle', cx, cy, r) or (name, 'box', x1, y1, x2, y2)."""
    third, mid = length / 3, width / 2
    return [
        ("goal_circle_left", "circle", 0.0, mid, GOAL_CIRCLE_RADIUS),
        ("goal_circle_right", "circle", length, mid, GOAL_CIRCLE_RADIUS),
        ("center_circle", "circle", length / 2, mid, CENTRE_CIRCLE_RADIUS),
        ("shooting_circle_left", "circle", 0.0, mid, GOAL_CIRCLE_RADIUS),
        ("shooting_circle_right", "circle", length, mid, GOAL_CIRCLE_RADIUS),
        ("goal_third_left", "box", 0.0, 0.0, third, width),
        ("center_third", "box", third, 0.0, 2 * third, width),
        ("goal_third_right", "box", 2 * third, 0.0, length, width),
    ]


def _inside(shape: tuple, x: Column, y: Column) -> Column:
    if shape[1] == "circle":
        _, _, cx, cy, r = shape
        return euclidean(x, y, F.lit(cx), F.lit(cy)) <= r
    _, _, x1, y1, x2, y2 = shape
    return x.between(x1, x2) & y.between(y1, y2)


def is_on_court(x, y, length: float = COURT_LENGTH, width: float = COURT_WIDTH) -> Column:
    return _c(x).between(0.0, length) & _c(y).between(0.0, width)


def in_court_margin(
    x, y, margin: float = SIDELINE_MARGIN, length: float = COURT_LENGTH, width: float = COURT_WIDTH
) -> Column:
    return _c(x).between(margin, length - margin) & _c(y).between(margin, width - margin)


def court_corners(h_inv, length: float = COURT_LENGTH, width: float = COURT_WIDTH) -> Column:
    """Pixel positions of the court corners as one struct (x0, y0 ... x3, y3)."""
    fields = []
    for i, (cx, cy) in enumerate(((0.0, 0.0), (length, 0.0), (length, width), (0.0, width))):
        px, py = court_to_pixel(h_inv, F.lit(cx), F.lit(cy))
        fields += [px.alias(f"x{i}"), py.alias(f"y{i}")]
    return F.struct(*fields)


def whole_pixels(corners) -> Column:
    """The outline drawn through the corners, cut to whole pixels."""
    cut = lambda v: F.signum(v) * F.floor(F.abs(v))
    return F.struct(*[cut(_c(corners)[f"{a}{i}"]).alias(f"{a}{i}") for i in range(4) for a in "xy"])


def in_court_polygon(outline, x, y) -> Column:
    """Pixel point inside or on the projected court outline."""
    o = _c(outline)
    return in_convex_quad([(o[f"x{i}"], o[f"y{i}"]) for i in range(4)], x, y)


def classify_zone(x, y, length: float = COURT_LENGTH, width: float = COURT_WIDTH) -> Column:
    """Left / right zone name, first match by priority; ``out_of_bounds`` off court."""
    x, y = _c(x), _c(y)
    case = F.when(x.isNull() | y.isNull(), F.lit(None).cast("string")).when(
        ~is_on_court(x, y, length, width), F.lit("out_of_bounds")
    )
    seen = set()
    for shape in zone_shapes(length, width):
        if shape[1:] not in seen:  # a zone equal to an earlier one is never reached
            seen.add(shape[1:])
            case = case.when(_inside(shape, x, y), F.lit(shape[0]))
    return case.otherwise(F.lit("court_boundary"))


def classify_zone_home_away(x, y, length: float = COURT_LENGTH, width: float = COURT_WIDTH) -> Column:
    """Home / away thirds with the shooting circles inside the goal thirds."""
    x, y = _c(x), _c(y)
    third, mid = length / 3, width / 2
    home = euclidean(x, y, F.lit(third / 2), F.lit(mid)) <= GOAL_CIRCLE_RADIUS
    away = euclidean(x, y, F.lit(2.5 * third), F.lit(mid)) <= GOAL_CIRCLE_RADIUS
    return (
        F.when(x < third, F.when(home, F.lit("shooting_circle_home")).otherwise(F.lit("goal_third_home")))
        .when(x > 2 * third, F.when(away, F.lit("shooting_circle_away")).otherwise(F.lit("goal_third_away")))
        .otherwise(F.lit("centre_third"))
    )


def is_position_valid(position, zone) -> Column:
    """Whether the position may be in the zone; unknown positions always may.

    A constant map keeps this to one use of ``zone``: it is a long expression, and
    Spark copies it wherever it is named when it pushes filters down."""
    allowed = F.create_map(*[x for p, zs in POSITION_ZONES.items() for x in (F.lit(p), F.array(*map(F.lit, zs)))])
    return F.coalesce(F.array_contains(F.try_element_at(allowed, _c(position)), _c(zone)), F.lit(True))


def zone_for_position(position) -> Column:
    position = _c(position)
    case = F.when(position.isNull(), F.lit("centre_third"))
    for p, z in ZONE_BY_POSITION.items():
        case = case.when(position == p, F.lit(z))
    return case.otherwise(F.lit("centre_third"))


def zone_to_grid(zone, grid: int = 20) -> tuple[Column, Column]:
    """Grid cell (x, y) that stands for a home / away zone."""
    zone = _c(zone)
    gx = (
        F.when(zone.endswith("_home"), F.lit(grid // 6))
        .when(zone.endswith("_away"), F.lit(5 * grid // 6))
        .otherwise(F.lit(grid // 2))
    )
    return gx.cast("long"), F.lit(grid // 2).cast("long")
