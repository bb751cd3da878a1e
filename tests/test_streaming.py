"""Streams over several files in any order equal the batch form; late rows come out as such."""

import random
import time

import pytest
from pyspark.sql import functions as F

from courtflow.operators import folds, possession
from courtflow.streaming import live


@pytest.fixture
def files(spark, tmp_path):
    """Write slices of rows as one file each, in order, and read them as a stream."""

    def make(rows, schema, cuts):
        folder = tmp_path / "in"
        for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
            part = tmp_path / f"part{n}"
            spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(str(part))
            folder.mkdir(exist_ok=True)
            for f in part.glob("*.parquet"):
                (folder / f"{n:03d}.parquet").write_bytes(f.read_bytes())
            time.sleep(0.05)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return make


def possession_rows(seed):
    rng = random.Random(seed)
    rows, holder = [], [None] * 3
    for f in range(150):
        for m in range(3):
            if rng.random() < 0.25:
                holder[m] = rng.choice([None, 1, 2, 3])
            rows.append((m, f, f / 5.0, holder[m], "home" if holder[m] == 1 else "away"))
    return rows


SCHEMA = "match_id long, frame_number long, ts_sec double, {} long, team string"


def drained(spark, tmp_path, make):
    folder = str(tmp_path / "ends")
    return live.drain(make(live.end_marks(spark, folder)), "t", folder)


ORDERS = ["in order", "backwards", "mixed"]


def reordered(rows, order):
    rows = list(rows)
    if order == "backwards":
        rows.reverse()
    elif order == "mixed":
        random.Random(5).shuffle(rows)
    return rows


@pytest.mark.parametrize("order", ORDERS)
def test_possession_events(spark, files, tmp_path, order):
    rows, schema = possession_rows(1), SCHEMA.format("possession_player_id")
    stream = files(reordered(rows, order), schema, [100, 230, 301])
    out = drained(spark, tmp_path, lambda ends: live.stream_possession_events(stream, delay="1 minute", ends=ends, span_ms=3000))
    batch = folds.possession_fsm(spark.createDataFrame(rows, schema))
    cols = ["match_id", "frame_number", "player_id", "team", "event_type"]
    assert sorted(map(tuple, out.filter("NOT late").select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))
    assert out.filter("late").count() == 0


@pytest.mark.parametrize("order", ORDERS)
def test_held_ball_alerts(spark, files, tmp_path, order):
    rows, schema = possession_rows(2), SCHEMA.format("raw_player")
    stream = files(reordered(rows, order), schema, [50, 200, 400])
    out = drained(spark, tmp_path, lambda ends: live.stream_three_second_alerts(stream, delay="1 minute", ends=ends, span_ms=3000))
    raw = spark.createDataFrame(rows, schema).withColumn("raw_confidence", F.lit(0.5))
    batch = possession.three_second_violations(possession.smooth_possession(raw.drop("team")))
    cols = ["match_id", "player_id", "start_frame", "violation_frame"]
    want = sorted(map(tuple, batch.select(cols).collect()))
    assert sorted(map(tuple, out.filter("NOT late").select(cols).collect())) == want and want


def test_late_frames_come_out_as_late(spark, files, tmp_path):
    """Files of one row each; the watermark of a file is in force in the trigger after it."""
    schema = SCHEMA.format("possession_player_id")
    rows = [(1, 10, 10.0, 1, "home"), (1, 40, 40.0, 1, "home"), (1, 12, 12.0, 1, "home"), (1, 50, 50.0, 1, "home"), (1, 11, 11.0, None, None), (1, 39, 39.5, None, None), (1, None, 60.0, 1, "home"), (None, 5, 61.0, 1, "home")]
    stream = files(rows, schema, range(1, len(rows)))
    out = drained(spark, tmp_path, lambda ends: live.stream_possession_events(stream, delay="5 seconds", ends=ends, span_ms=1000))
    assert {(r.match_id, r.frame_number) for r in out.filter("late").collect()} == {(1, 12), (1, 11), (1, 39), (1, None)}
    events = out.filter("NOT late").orderBy("match_id", "frame_number").collect()
    assert [(r.match_id, r.frame_number, r.event_type) for r in events][:2] == [(None, 5, "gained"), (1, 10, "gained")]


def test_without_end_mark_rows_stay_held(spark, files):
    schema = SCHEMA.format("possession_player_id")
    rows = [(1, 10, 1.0, 1, "home"), (1, 300, 30.0, 1, "home")]
    got = live.drain(live.stream_possession_events(files(rows, schema, [1]), delay="5 seconds", span_ms=1000), "t").collect()
    assert [(r.frame_number, r.event_type, r.late) for r in got] == [(10, "gained", False)]


def test_late_samples_are_dropped(spark, files):
    at = lambda minute: 1_700_000_000 - 1_700_000_000 % 3600 + minute * 60
    schema = "second long, host long, cpu_percent double, memory_percent double"
    minutes = [(5, 10.0), (200, 20.0), (210, 21.0), (6, 99.0), (400, 1.0)]
    rows = [(at(m), 1, cpu, 1.0) for m, cpu in minutes]
    # the watermark of a file is in force from the second trigger after it
    stream = files(rows, schema, [2, 3, 4]).withColumn("timestamp", F.timestamp_seconds("second")).drop("second")
    got = live.drain(live.stream_metric_windows(stream), "t").orderBy("window_start").collect()
    assert [(r.samples, r.cpu_max) for r in got] == [(1, 10.0), (2, 21.0)]


def test_dedupe_and_callback(spark, files, tmp_path):
    schema = "second long, video_path string, frame_number long, config string"
    rows = [(i, f"v{i % 2}", i % 5, "c") for i in range(40)]
    stream = files(rows, schema, [10, 25]).withColumn("timestamp", F.timestamp_seconds("second"))
    out = str(tmp_path / "out")
    handled = live.for_each_batch(
        live.stream_dedupe_frames(stream), lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "cp")
    )
    handled.awaitTermination()
    assert spark.read.parquet(out).select("video_path", "frame_number").count() == 10


def _call_sizes(rows, state):
    """One row per call, with the number of rows it got and whether they came in order."""
    n = (state or 0) + 1
    order = list(zip(rows["ts_sec"], rows["frame_number"]))
    return __import__("pandas").DataFrame({"frame_number": [n], "rows": [len(rows)], "sorted": [order == sorted(order)]}), n, None


def test_spans_passed_together_are_one_call(spark, tmp_path):
    """Two matches over 3,000 spans of a second, brought by two arrivals: a call a block, not a call a span."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])
    schema, folder, ends = "match_id long, frame_number long, ts_sec double", str(tmp_path / "in"), str(tmp_path / "ends")
    rows = spark.range(6000).select((F.col("id") % 2).alias("match_id"), F.col("id").alias("frame_number"), (F.col("id") / 2.0).alias("ts_sec"))
    rows.limit(0).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    d = live._stateful(stream, _call_sizes, "match_id long, frame_number long, rows long, sorted boolean, late boolean", "10 seconds", live.end_marks(spark, ends), 1000)
    arrivals = [lambda p=p: rows.filter(p).write.mode("append").parquet(folder) for p in (F.col("frame_number") < 3000, F.col("frame_number") >= 3000)]
    out = live.drain(d, "calls", ends, arrivals).collect()
    assert sum(r["rows"] for r in out) == 6000 and all(r["sorted"] and not r["late"] for r in out)
    assert len(out) <= 2 * (3000_000 // live.BLOCK_MS + 3)
