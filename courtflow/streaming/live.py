"""Live operators on streams of frames and host samples.

Late data: rows behind the watermark are dropped by the windowed operators. The per-match
automata hold rows in state, by span of event time, until the watermark has passed that span,
and then work through them in frame order, many spans in one call if as many were passed, so neither the order of files nor that of rows in a
trigger matters. A row whose span the watermark has passed, or without frame or time, comes out
as a row of its own with ``late`` set, so no row is lost. ``drain`` ends a stream with a mark that lets all held
rows go. State per match is a few values and the rows of the delay, kept in the state store
(RocksDB), so any executor can be lost.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from courtflow.constants import CONFIRM_FRAMES, HELD_BALL_SECONDS
from courtflow.operators.folds import _fsm
from courtflow.operators.service import system_alerts
from courtflow.operators.zones import with_zone
from courtflow.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


END_OF_TIME = "9999-01-01 00:00:00"
#: Event time of the rows that wait together: ten minutes, or one span if that is longer.
BLOCK_MS, _END = 600_000, "__end"


class _InOrder(StatefulProcessor):
    """Feeds a step function with a match's rows in frame order, whole spans of event time at a time.

    ``held`` keeps the rows of a block (spans of about ``BLOCK_MS``) as numbered parts, one per batch of rows
    that brought some, so that nothing is read to add to it; ``blocks`` has the number of parts and the first
    span's end, at which a timer lets all spans go that have been passed. So a task holds one block of a match,
    whatever a trigger brings.
    """

    def __init__(self, step, columns, names, span_ms):
        self.step, self.columns, self.names, self.span_ms = step, columns, names, span_ms
        self.block_ms = span_ms * max(1, BLOCK_MS // span_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "value string")
        self.blocks = handle.getMapState("blocks", "block long", "parts long, first long")
        self.held = handle.getMapState("held", "block long, part long", "rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            part = part[~part["is_end"]]
            end = (part["ts_sec"] * 1000 // self.span_ms + 1) * self.span_ms
            late = part["frame_number"].isna() | end.isna() | (end <= passed)
            if late.any():
                yield self._out(key, part[late][["frame_number", "ts_sec"]].assign(late=True))
            new: dict[int, list] = {}
            ends = end[~late].astype("int64").tolist()
            for at, row in zip(ends, json.loads(part[~late][self.names].to_json(orient="values", double_precision=15))):
                new.setdefault(self._block(at), []).append([at, *row])
            for block, some in new.items():
                self._hold(block, some, self.blocks.getValue((block,)))

    def _block(self, end: int) -> int:
        return (end - self.span_ms) // self.block_ms

    def _hold(self, block: int, rows: list, known) -> None:
        parts, old = known or (0, None)
        first = min(row[0] for row in rows)
        self.held.updateValue((block, parts), (json.dumps(rows),))
        if old is None or first < old:
            self.handle.registerTimer(first)
        self.blocks.updateValue((block,), (parts + 1, first if old is None else min(first, old)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        block = self._block(expiredTimerInfo.getExpiryTimeInMs())
        known = self.blocks.getValue((block,))
        if not known or known[1] > passed:
            return
        rows = []
        for part in range(known[0]):
            rows += json.loads(self.held.getValue((block, part))[0])
            self.held.removeKey((block, part))
        self.blocks.removeKey((block,))
        rest = [row for row in rows if row[0] > passed]
        if rest:
            self._hold(block, rest, None)
        state = json.loads(self.memory.get()[0]) if self.memory.exists() else None
        due = pd.DataFrame([row for row in rows if row[0] <= passed], columns=[_END, *self.names])
        due = due.sort_values([_END, *self.names], kind="stable", ignore_index=True).drop(columns=_END)
        out, state, _ = self.step(due, state)
        self.memory.update((json.dumps(state),))
        if len(out):
            yield self._out(key, out.assign(late=False))

    def _out(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(match_id=key[0])
        missing = {c: pd.Series(None, rows.index, dtype=object) for c in self.columns if c not in rows}
        return rows.assign(**missing)[self.columns]

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, step, schema: str, delay: str, ends: DataFrame | None, span_ms: int) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    names = stream.columns[1:]
    d = stream.withColumns({"is_end": F.lit(False), "event_time": F.timestamp_micros((F.col("ts_sec") * 1_000_000).cast("long"))})
    if ends is not None:
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
        d = d.unionByName(ends.select(*none, F.lit(True).alias("is_end"), "event_time"))
    # without its time column the operator gets late rows too
    d = d.withWatermark("event_time", delay).drop("event_time")
    out = T.StructType.fromDDL(schema)
    return d.groupBy("match_id").transformWithStateInPandas(
        statefulProcessor=_InOrder(step, out.names, names, span_ms), outputStructType=out, outputMode="append", timeMode="EventTime"
    )


def end_marks(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of end marks, which ``write_end_mark`` puts into ``folder``."""
    folder_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    folder_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder_path)
    return spark.readStream.schema("event_time timestamp").parquet(folder)


def write_end_mark(spark: SparkSession, folder: str) -> None:
    """All rows held by a stream with these marks go when it next runs."""
    spark.sql(f"SELECT TIMESTAMP '{END_OF_TIME}' AS event_time").write.mode("append").parquet(folder)


def stream_possession_events(
    frames: DataFrame, timeout: float = HELD_BALL_SECONDS, delay: str = "10 seconds", ends: DataFrame | None = None, span_ms: int = 10_000
) -> DataFrame:
    """Gained / lost / timeout events as frames arrive (columns as in the batch form, and ``late``).

    ``delay``: how far a row may lag behind the latest one; ``ends``: a stream of end marks;
    ``span_ms``: rows wait until the watermark has passed their span of so many milliseconds.
    """
    d = frames.select("match_id", "frame_number", "ts_sec", F.col("possession_player_id").cast("double"), "team")
    schema = (
        "match_id long, frame_number long, event_no long, ts_sec double, player_id long, team string, event_type string, late boolean"
    )
    step, made = _fsm(timeout), ["frame_number", "event_no", "ts_sec", "player_id", "team", "event_type"]

    def framed(rows, state):
        out, state, note = step(rows, state)
        return pd.DataFrame(out, columns=made), state, note

    return _stateful(d, framed, schema, delay, ends, span_ms)


def _held_ball(limit: float, k: int):
    def step(rows, state):
        player, pending, run, start_frame, start_ts, told = state or [None, None, 0, None, None, False]
        out = []
        for frame, ts, raw in zip(rows["frame_number"].tolist(), rows["ts_sec"].tolist(), rows["raw_player"].tolist()):
            raw = None if raw is None or pd.isna(raw) else int(raw)
            change = player is None and raw is not None
            if player is not None and raw != player:
                run = run + 1 if raw is not None and raw == pending else 1
                pending = raw
                change = raw is not None and run >= k
            elif player is not None:
                pending, run = None, 0
            if change:
                player, pending, run, start_frame, start_ts, told = raw, None, 0, frame, ts, False
            if player is not None and not told and ts - start_ts > limit:
                told = True
                out.append((player, start_frame, frame, start_ts, ts, ts - start_ts, ts - start_ts - limit))
        cols = ["player_id", "start_frame", "violation_frame", "start_timestamp", "violation_timestamp",
                "duration_seconds", "excess_seconds"]
        return pd.DataFrame(out, columns=cols), [player, pending, run, start_frame, start_ts, told], None

    return step


def stream_three_second_alerts(
    raw: DataFrame, limit: float = HELD_BALL_SECONDS, k: int = CONFIRM_FRAMES, delay: str = "10 seconds", ends: DataFrame | None = None, span_ms: int = 10_000
) -> DataFrame:
    """One alert per smoothed possession held too long. ``raw``: match_id,
    frame_number, ts_sec, raw_player; k >= 2 consecutive frames confirm a change.
    Late rows have ``late`` set and their frame_number and ts_sec."""
    if k < 2:
        raise ValueError("confirmation needs at least two frames")
    d = raw.select("match_id", "frame_number", "ts_sec", F.col("raw_player").cast("double"))
    schema = (
        "match_id long, player_id long, start_frame long, violation_frame long, start_timestamp double, "
        "violation_timestamp double, duration_seconds double, excess_seconds double, frame_number long, ts_sec double, late boolean"
    )
    return _stateful(d, _held_ball(limit, k), schema, delay, ends, span_ms)


def stream_metric_windows(
    metrics: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """CPU and memory per host and window of event time."""
    w = F.window("timestamp", length, slide) if slide else F.window("timestamp", length)
    d = metrics.withWatermark("timestamp", delay).groupBy(w.alias("w"), "host")
    d = d.agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg("cpu_percent").alias("cpu_avg"),
        F.max("cpu_percent").alias("cpu_max"),
        F.max("memory_percent").alias("memory_max"),
    )
    return d.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "host", "samples",
                    "cpu_avg", "cpu_max", "memory_max")


def stream_alerts(metrics: DataFrame) -> DataFrame:
    """Threshold alerts, stateless."""
    return system_alerts(metrics)


def stream_track_sessions(seen: DataFrame, gap: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """Spells in which a track keeps being seen: it ends ``gap`` after its last row.
    ``seen``: timestamp, match_id, track_id."""
    d = seen.withWatermark("timestamp", delay)
    d = d.groupBy(F.session_window("timestamp", gap).alias("s"), "match_id", "track_id").agg(F.count(F.lit(1)).alias("rows"))
    return d.select("match_id", "track_id", F.col("s.start").alias("first_seen"), F.col("s.end").alias("expires"), "rows")


def stream_dedupe_frames(frames: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A (video, frame, config) is let through once within the watermark delay."""
    return frames.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["video_path", "frame_number", "config"])


def stream_zone_occupancy(players: DataFrame, length: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """Player rows per match, zone and window of event time."""
    d = with_zone(players).withColumn("timestamp", F.timestamp_micros((F.col("ts_sec") * 1_000_000).cast("long")))
    d = d.withWatermark("timestamp", delay).groupBy(F.window("timestamp", length).alias("w"), "match_id", "zone")
    return d.agg(F.count(F.lit(1)).alias("players")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "match_id", "zone", "players"
    )


def append_to(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Start an append of the stream to a parquet table (exactly once through the
    checkpoint). ``trigger`` defaults to everything available now."""
    w = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start(path)


def for_each_batch(stream: DataFrame, handle, checkpoint: str, trigger: dict | None = None):
    """Start handing each micro-batch to ``handle(df, batch_id)`` (alerts, callbacks)."""
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def _nothing_new() -> None:
    """What is there is all."""


def drain(stream: DataFrame, label: str, ends: str | None = None, arrivals: Sequence[Callable[[], None]] = (_nothing_new,)) -> DataFrame:
    """Run the stream over all that is available and return what it wrote: once after each of ``arrivals``,
    calls that bring new files. With the folder of its end marks it then gets one and runs on, so that nothing
    stays held."""
    spark: SparkSession = stream.sparkSession
    path = scratch_path(spark, label)
    for bring in [*arrivals, *([] if ends is None else [lambda: write_end_mark(spark, ends)])]:
        bring()
        append_to(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
