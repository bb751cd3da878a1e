"""Own functions over frames and matches: the extension points."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from courtflow.operators.ordered import CHUNK_FRAMES, add_chunk


def apply_per_frame(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` over Arrow batches of rows, any number of frames at a time and in any
    order; for functions that look at one row or batch only. No shuffle."""

    def each(batches):
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(each, schema)


def apply_per_match(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    combine: Callable[[DataFrame], DataFrame] | None,
    size: int | None = CHUNK_FRAMES,
) -> DataFrame:
    """``fn`` over the rows of a match, a bounded run of ``size`` frames at a time, and ``combine``
    over the table of what the runs return, which makes a match's result of them however long
    the match. With ``size=None`` ``fn`` gets whole matches, and ``combine`` is None: only for
    tables whose matches fit a task."""
    if (size is None) != (combine is None):
        raise ValueError("pieces of matches need a combine function, whole matches have none")
    if size is None:
        return df.groupBy("match_id").applyInPandas(fn, schema)
    return combine(
        add_chunk(df, "frame_number", size)
        .groupBy("match_id", "__chunk")
        .applyInPandas(lambda pdf: fn(pdf.drop(columns="__chunk")), schema)
    )


def stages(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Compose table functions: ``df.transform(stages(a, b, c))``."""

    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = df.transform(s)
        return df

    return run
