"""Text-read cleaning and colour functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtflow.constants import POSITIONS
from courtflow.functions.geometry import _c


def ocr_clean(text, max_len: int = 3) -> Column:
    """Letters and digits only, cut to ``max_len`` characters."""
    return F.substring(F.regexp_replace(_c(text), r"[^\p{L}\p{N}]", ""), 1, max_len)


def bib_token(text) -> Column:
    """Upper-cased position letters, null unless they name a position."""
    token = F.regexp_replace(F.upper(_c(text)), "[^GSWACDK]", "")
    return F.when(token.isin(POSITIONS), token)


def is_numeric(text) -> Column:
    return _c(text).rlike("^[0-9]+$")


def jersey_number(text) -> Column:
    """The number read, or null when the text is not all digits."""
    return F.when(is_numeric(text), F.expr("try_cast(%s AS BIGINT)" % text) if isinstance(text, str) else _c(text).try_cast("bigint"))


def confidence_level(confidence) -> Column:
    c = _c(confidence)
    return F.when(c >= 0.8, "high").when(c >= 0.5, "medium").when(c >= 0.2, "low").otherwise("very_low")


def color_distance_rgb(a: tuple, b: tuple) -> Column:
    d = [_c(x).cast("double") - _c(y).cast("double") for x, y in zip(a, b)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def rgb_to_hsv(r, g, b) -> tuple[Column, Column, Column]:
    """Hue, saturation and value in [0, 1] of channels in [0, 255]."""
    r, g, b = (_c(v) / F.lit(255.0) for v in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    some = F.when(span != 0, span)
    rc, gc, bc = ((top - v) / some for v in (r, g, b))
    six = F.when(r == top, bc - gc).when(g == top, F.lit(2.0) + rc - bc).otherwise(F.lit(4.0) + gc - rc)
    turn = six / F.lit(6.0)
    hue = F.when(span == 0, F.lit(0.0)).otherwise(turn - F.floor(turn))
    sat = F.when(span == 0, F.lit(0.0)).otherwise(span / F.when(top != 0, top))
    return hue, sat, top


def color_distance_hsv(a: tuple, b: tuple) -> Column:
    """Distance in HSV with the hue taken round the circle."""
    (h1, s1, v1), (h2, s2, v2) = rgb_to_hsv(*a), rgb_to_hsv(*b)
    dh = F.abs(h1 - h2)
    dh = F.least(dh, F.lit(1.0) - dh)
    return F.sqrt(dh * dh + (s1 - s2) * (s1 - s2) + (v1 - v2) * (v1 - v2))
