"""Small job-service expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtflow.functions.geometry import _c


def pagination_info(total, page: int, size: int) -> dict[str, Column]:
    pages = F.floor((_c(total) + F.lit(size - 1)) / F.lit(float(size))).cast("long")
    return {
        "page": F.lit(page).cast("long"),
        "page_size": F.lit(size).cast("long"),
        "total_pages": pages,
        "has_next": F.lit(page) < pages,
        "has_prev": F.lit(page > 1),
    }


def eta_seconds(status, progress) -> Column:
    """Seconds left while processing, on a 300 s budget scaled by progress."""
    p = _c(progress)
    return F.when(
        (_c(status) == "processing") & (p > 0) & (p < 100),
        F.floor((F.lit(100.0) - p) / F.when(p > 0, p) * F.lit(300.0)).cast("long"),
    )
