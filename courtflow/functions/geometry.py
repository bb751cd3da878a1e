"""Box and point geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def _c(x) -> Column:
    if isinstance(x, str):
        return F.col(x)
    return x if isinstance(x, Column) else F.lit(float(x))


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    """The four corner columns, optionally prefixed (``ball_x1`` ...)."""
    return tuple(F.col(prefix + c) for c in BOX)


def safe_div(a, b, default: float | None = 0.0) -> Column:
    """``a / b``, or ``default`` where ``b`` is zero (ANSI mode raises on it)."""
    a, b = _c(a), _c(b)
    return F.when(b == 0, F.lit(default)).otherwise(a / F.when(b != 0, b))


def center_x(b) -> Column:
    return (b[0] + b[2]) / F.lit(2.0)


def center_y(b) -> Column:
    return (b[1] + b[3]) / F.lit(2.0)


def width(b) -> Column:
    return b[2] - b[0]


def height(b) -> Column:
    return b[3] - b[1]


def area(b) -> Column:
    return width(b) * height(b)


def aspect_hw(b) -> Column:
    """Height over width; 0 for boxes without width (players, hoops, balls)."""
    return F.when(width(b) > 0, height(b) / F.when(width(b) > 0, width(b))).otherwise(F.lit(0.0))


def aspect_wh(b) -> Column:
    """Width over height; 0 for boxes without height (number boxes)."""
    return F.when(height(b) > 0, width(b) / F.when(height(b) > 0, height(b))).otherwise(F.lit(0.0))


def euclidean(x1, y1, x2, y2) -> Column:
    dx, dy = _c(x1) - _c(x2), _c(y1) - _c(y2)
    return F.sqrt(dx * dx + dy * dy)


def intersection_area(a, b) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def iou(a, b) -> Column:
    inter = intersection_area(a, b)
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / F.when(union > 0, union)).otherwise(F.lit(0.0))


def overlap_fraction(a, b) -> Column:
    """Share of box ``a`` that box ``b`` covers."""
    return F.when(area(a) > 0, intersection_area(a, b) / F.when(area(a) > 0, area(a))).otherwise(F.lit(0.0))


def contains_point(b, x, y) -> Column:
    return _c(x).between(b[0], b[2]) & _c(y).between(b[1], b[3])


def ball_containment(ball, player) -> Column:
    """1 with the ball centre inside the player, falling off with the distance
    to the box relative to its longer side."""
    x, y = center_x(ball), center_y(ball)
    dx = F.greatest(F.lit(0.0), player[0] - x, x - player[2])
    dy = F.greatest(F.lit(0.0), player[1] - y, y - player[3])
    side = F.greatest(width(player), height(player))
    outside = F.when(
        side > 0, F.greatest(F.lit(0.0), F.lit(1.0) - F.sqrt(dx * dx + dy * dy) / F.when(side > 0, side))
    ).otherwise(F.lit(0.0))
    return F.when(contains_point(player, x, y), F.lit(1.0)).otherwise(outside)


# -- homographies: h is ARRAY<DOUBLE>, nine elements, row-major, pixel -> court --


def _project(h: list[Column], x: Column, y: Column, weight: Column | None = None) -> tuple[Column, Column]:
    shift = [v if weight is None else v * weight for v in h[2::3]]
    px = h[0] * x + h[1] * y + shift[0]
    py = h[3] * x + h[4] * y + shift[1]
    w = h[6] * x + h[7] * y + shift[2]
    ok = F.when(w != 0, w)
    return F.when(w != 0, px / ok).otherwise(px), F.when(w != 0, py / ok).otherwise(py)


def _elements(h) -> list[Column]:
    return [F.element_at(_c(h), i + 1) for i in range(9)]


def determinant(h) -> Column:
    a, b, c, d, e, f, g, k, i = _elements(h)
    return a * (e * i - f * k) - b * (d * i - f * g) + c * (d * k - e * g)


def inverse(h) -> Column:
    """Inverse matrix by the adjugate; null when the determinant is 0."""
    a, b, c, d, e, f, g, k, i = _elements(h)
    det = determinant(h)
    adj = [
        e * i - f * k, c * k - b * i, b * f - c * e,
        f * g - d * i, a * i - c * g, c * d - a * f,
        d * k - e * g, b * g - a * k, a * e - b * d,
    ]
    ok = F.when(det != 0, det)
    return F.when(det != 0, F.transform(F.array(*adj), lambda v: v / ok))


def pixel_to_court(h, x, y) -> tuple[Column, Column]:
    return _project(_elements(h), _c(x), _c(y))


def court_weight(h, x, y) -> Column:
    """1, or 0 for a pixel on the horizon of the matrix: ``pixel_to_court`` gives its direction only."""
    g, k, i = _elements(h)[6:]
    return F.when(g * _c(x) + k * _c(y) + i == 0, F.lit(0.0)).otherwise(F.lit(1.0))


def court_to_pixel(h_inv, x, y, weight=None) -> tuple[Column, Column]:
    """Takes the inverse matrix as a column: invert once per matrix, not per point. With the
    ``court_weight`` of each point those on the horizon come back too."""
    return _project(_elements(h_inv), _c(x), _c(y), None if weight is None else _c(weight))


def map_box(matrix, b) -> tuple[Column, Column, Column, Column]:
    """Box around the four projected corners; pass h for court, its inverse for pixels."""
    points = [_project(_elements(matrix), x, y) for x in (b[0], b[2]) for y in (b[1], b[3])]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def blend_homography(old, new, alpha: float) -> Column:
    """Moving average of two matrices; a weight outside (0, 1) swaps them hard."""
    if not 0.0 < alpha < 1.0:
        return _c(new)
    return F.when(_c(old).isNull(), _c(new)).otherwise(
        F.zip_with(_c(old), _c(new), lambda o, n: F.lit(1.0 - alpha) * o + F.lit(alpha) * n)
    )


def matrix_ok(h, confidence) -> Column:
    """Nine finite elements, invertible, and a positive confidence."""
    bad = F.exists(
        _c(h), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    )
    nine = F.size(_c(h)) == 9
    return F.coalesce(
        F.when(nine & ~bad, F.abs(determinant(h)) >= 1e-6).otherwise(F.lit(False)) & (_c(confidence) > 0),
        F.lit(False),
    )


def in_convex_quad(corners, x, y) -> Column:
    """Point inside or on a convex quadrilateral given as four (x, y) pairs."""
    x, y = _c(x), _c(y)
    sides = []
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        sides.append((bx - ax) * (y - ay) - (by - ay) * (x - ax))
    clockwise = (sides[0] <= 0) & (sides[1] <= 0) & (sides[2] <= 0) & (sides[3] <= 0)
    counter = (sides[0] >= 0) & (sides[1] >= 0) & (sides[2] >= 0) & (sides[3] >= 0)
    return clockwise | counter
