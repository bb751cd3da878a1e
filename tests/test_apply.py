"""Own functions per match give one result per match, however long it is."""

import pytest
from pyspark.sql import functions as F

from courtflow.operators.apply import apply_per_match


def test_result_of_a_match_does_not_depend_on_its_length(spark):
    df = spark.sql("SELECT id % 2 AS match_id, id * 10 AS frame_number FROM range(4000)")
    last = lambda pdf: pdf.groupby("match_id", as_index=False).agg(last=("frame_number", "max"))
    with pytest.raises(TypeError):
        apply_per_match(df, last, "match_id long, last long")  # pieces without a word
    newest = lambda parts: parts.groupBy("match_id").agg(F.max("last").alias("last"))
    whole = apply_per_match(df, last, "match_id long, last long", None, size=None)
    pieces = apply_per_match(df, last, "match_id long, last long", newest)
    assert sorted(map(tuple, pieces.collect())) == sorted(map(tuple, whole.collect())) == [(0, 39980), (1, 39990)]
