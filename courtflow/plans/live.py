"""Streaming queries: the given events files are read as a stream and drained."""

from pyspark.sql import functions as F

from courtflow.operators.apply import apply_per_frame, apply_per_match, stages
from courtflow.operators.ordered import running_sum
from courtflow.plans.possession import LABELS, TIMES, V_SELECT, VIOLATIONS, fsm_sql
from courtflow.plans.registry import query, shown
from courtflow.plans.zones import ZONED
from courtflow.session import scratch_path
from courtflow.sources.readers import stream_detections
from courtflow.streaming import committed as C
from courtflow.streaming import live as L


def events(t):
    """The events table as a stream of its files."""
    return t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 64).parquet(f"{t.folder}/events.parquet*")


def instant(c):
    """A zone-less timestamp as the instant it names in UTC, whatever the session zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(c)))


def as_text(c):
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), epoch).cast("string").alias(c)


def raw_labels(t):
    e = events(t)
    player = F.when(F.col("event_type") == "error", None).when(F.col("value") < 70, F.lit(1)).otherwise(
        F.lit(2) + F.floor("value") % 2
    )
    return e.select(
        (F.col("user_id") % 8).alias("match_id"),
        F.col("event_id").alias("frame_number"),
        (F.col("event_id") / F.lit(30.0)).alias("ts_sec"),
        player.cast("long").alias("raw_player"),
    )


def metrics(t):
    return events(t).select(
        instant("ts").alias("timestamp"),
        (F.col("user_id") % 5).alias("host"),
        (F.col("event_id") * 37 % 1000 / F.lit(10.0)).alias("cpu_percent"),
        (F.col("event_id") * 53 % 1000 / F.lit(10.0)).alias("memory_percent"),
        (F.col("event_id") * 71 % 1000 / F.lit(10.0)).alias("disk_percent"),
    )


def drained(t, label, make, **options):
    """A stream run to its end, with an end mark after all rows."""
    ends = scratch_path(t.spark, "ends")
    return L.drain(make(L.end_marks(t.spark, ends)), label, ends, **options)


def held(d):
    team = F.when(F.col("raw_player") == 1, "home").otherwise("away")
    return d.withColumn("team", team).withColumnRenamed("raw_player", "possession_player_id")


EVENT = ["match_id", "frame_number", "ts_sec", "player_id", "team", "event_type"]
HELD = "SELECT match_id, frame_number, ts_sec, raw_player AS holder, CASE WHEN raw_player = 1 THEN 'home' ELSE 'away' END AS team FROM @possession_raw"


@query("stream_possession_events", f"WITH RECURSIVE bf AS ({HELD}), " + fsm_sql("bf") + " SELECT * FROM fsm")
def _events(t):
    d = held(raw_labels(t))
    return drained(t, "possession", lambda ends: L.stream_possession_events(d, ends=ends, span_ms=60_000)).filter("NOT late").select(EVENT)


@query(
    "stream_late_frames",
    f"""WITH RECURSIVE h AS ({HELD}), cut AS (SELECT CAST(MAX(frame_number) * 8 // 10 AS BIGINT) AS border, MAX(frame_number) // 30 - 10 AS passed FROM h),
late AS (SELECT h.* FROM h, cut WHERE frame_number % 50 = 7 AND frame_number < border AND frame_number // 300 * 10 + 10 <= passed),
bf AS (SELECT * FROM h WHERE (match_id, frame_number) NOT IN (SELECT match_id, frame_number FROM late)), """
    + fsm_sql("bf")
    + """ SELECT match_id, frame_number, event_type AS kind FROM fsm UNION ALL SELECT match_id, frame_number, 'late' FROM late""",
)
def _late(t):
    """Three arrivals: four fifths of the frames without every fiftieth, the last fifth, and then the ones left
    out, which the watermark has passed by then."""
    d = held(t.possession_raw.drop("raw_confidence"))
    at = int(t.possession_raw.agg(F.max("frame_number")).first()[0]) * 8 // 10
    early, odd = F.col("frame_number") < at, F.col("frame_number") % 50 == 7
    folder = scratch_path(t.spark, "late")
    d.limit(0).write.parquet(folder)
    files = t.spark.readStream.schema(d.schema).parquet(folder)
    arrivals = [lambda part=part: d.filter(part).write.mode("append").parquet(folder) for part in (early & ~odd, ~early, early & odd)]
    out = drained(t, "late", lambda ends: L.stream_possession_events(files, delay="10 seconds", ends=ends), arrivals=arrivals)
    return out.select("match_id", "frame_number", F.when(F.col("late"), "late").otherwise(F.col("event_type")).alias("kind"))


@query("stream_three_second_alerts", LABELS + VIOLATIONS + V_SELECT)
def _alerts(t):
    d = drained(t, "held", lambda ends: L.stream_three_second_alerts(raw_labels(t), ends=ends, span_ms=60_000)).filter("NOT late")
    return shown(d.drop("frame_number", "ts_sec", "late"), *TIMES)


@query(
    "stream_metric_windows",
    """WITH w AS (SELECT date_trunc('hour', timestamp) AS s, host, COUNT(*) AS samples, AVG(cpu_percent) AS cpu_avg, MAX(cpu_percent) AS cpu_max,
 MAX(memory_percent) AS memory_max FROM @system_metrics GROUP BY 1,2)
SELECT CAST(s AS VARCHAR) AS window_start, host, samples, ROUND(cpu_avg,8) AS cpu_avg, cpu_max, memory_max FROM w
WHERE s + INTERVAL 1 HOUR <= (SELECT MAX(timestamp) FROM @system_metrics) - INTERVAL 10 MINUTE""",
)
def _windows(t):
    d = L.drain(L.stream_metric_windows(metrics(t)), "windows").drop("window_end")
    return shown(d.withColumn("window_start", as_text("window_start")), "cpu_avg", places=8)


@query(
    "stream_alerts",
    """SELECT CAST(timestamp AS VARCHAR) AS timestamp, host, 'high_cpu' AS alert, cpu_percent AS value, 90e0 AS threshold FROM @system_metrics WHERE cpu_percent > 90
 UNION ALL SELECT CAST(timestamp AS VARCHAR), host, 'high_memory', memory_percent, 85e0 FROM @system_metrics WHERE memory_percent > 85
 UNION ALL SELECT CAST(timestamp AS VARCHAR), host, 'high_disk', disk_percent, 90e0 FROM @system_metrics WHERE disk_percent > 90""",
)
def _system(t):
    return L.drain(L.stream_alerts(metrics(t)), "alerts").withColumn("timestamp", as_text("timestamp"))


@query(
    "stream_track_sessions",
    """WITH e AS (SELECT user_id % 8 AS match_id, user_id AS track_id, ts, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM @events),
g AS (SELECT *, SUM(CASE WHEN p IS NULL OR ts >= p + INTERVAL 4 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
s AS (SELECT match_id, track_id, k, MIN(ts) AS a, MAX(ts) + INTERVAL 4 HOUR AS b, COUNT(*) AS rows FROM g GROUP BY 1,2,3)
SELECT match_id, track_id, CAST(a AS VARCHAR) AS first_seen, rows FROM s WHERE b <= (SELECT MAX(ts) FROM @events) - INTERVAL 1 HOUR""",
)
def _sessions(t):
    seen = events(t).select(instant("ts").alias("timestamp"), (F.col("user_id") % 8).alias("match_id"), F.col("user_id").alias("track_id"))
    d = L.drain(L.stream_track_sessions(seen, gap="4 hours", delay="1 hour"), "sessions")
    return d.select("match_id", "track_id", as_text("first_seen"), "rows")


def committed_labels(t):
    """Three files of frames committed batch by batch; then the checkpoint forgets its last batch, so the
    stream hands that one over again."""
    d = t.possession_raw.select("match_id", "frame_number", "raw_player")
    folder = scratch_path(t.spark, "committed")
    for part in range(3):
        d.filter(F.col("frame_number") % 3 == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = t.spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    C.commit_to(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    last = C.commits(t.spark, f"{folder}/out").agg(F.max("batch")).first()[0]
    if last is not None:
        mark = t.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/checkpoint/commits/{last}")
        mark.getFileSystem(t.spark._jsc.hadoopConfiguration()).delete(mark, False)
        C.commit_to(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/out", d.schema


@query(
    "stream_committed_results",
    "SELECT match_id, frame_number, raw_player, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY frame_number) AS position FROM @possession_raw",
)
def _committed(t):
    path, schema = committed_labels(t)
    rows = C.committed(t.spark, path, schema).drop("stream", "batch")
    placed = running_sum(rows, ["match_id"], ["frame_number"], {"position": F.lit(1).cast("long")})
    return C.in_frame_order(placed)


@query(
    "stream_commits",
    "SELECT COUNT(*) AS rows FROM @possession_raw GROUP BY frame_number % 3",
)
def _commit_rows(t):
    path, _ = committed_labels(t)
    return C.commits(t.spark, path).select("rows")


@query("stream_dedupe_frames")
def _dedupe(t):
    frames = events(t).select(
        instant("ts").alias("timestamp"),
        F.concat(F.lit("video"), F.col("user_id").cast("string")).alias("video_path"),
        (F.col("event_id") % 97).alias("frame_number"),
        F.lit("cfg").alias("config"),
    )
    return L.drain(L.stream_dedupe_frames(frames, delay="30 days"), "dedupe").select("video_path", "frame_number", "config")


@query(
    "stream_zone_occupancy",
    ZONED
    + """, w AS (SELECT CAST(floor(CAST(floor(ts_sec*1000000e0) AS BIGINT)/1000000e0) AS BIGINT) AS second, match_id, zone, COUNT(*) AS players FROM z GROUP BY 1,2,3)
SELECT * FROM w WHERE second + 1 <= (SELECT MAX(CAST(floor(ts_sec*1000000e0) AS BIGINT))/1000000e0 FROM z) - 10""",
)
def _zones(t):
    path = scratch_path(t.spark, "detections")
    t.detections.write.parquet(path)
    players = stream_detections(t.spark, path, files_per_trigger=10_000).filter(F.col("class_name") == "player")
    d = L.drain(L.stream_zone_occupancy(players), "zones")
    return d.select(F.unix_seconds("window_start").alias("second"), "match_id", "zone", "players")


@query(
    "apply_per_frame",
    "SELECT match_id, frame_number, det_no, (x2-x1)*(y2-y1) AS area FROM @detections WHERE class_name = 'player' AND confidence >= 0.5e0",
)
def _apply(t):
    def areas(pdf):
        return pdf.assign(area=(pdf.x2 - pdf.x1) * (pdf.y2 - pdf.y1))[["match_id", "frame_number", "det_no", "area"]]

    confident = lambda df: df.filter(F.col("confidence") >= 0.5)
    measured = lambda df: apply_per_frame(df, areas, "match_id long, frame_number long, det_no long, area double")
    return t.players.transform(stages(confident, measured))


@query("apply_per_match", "SELECT match_id, COUNT(*) AS rows, CAST(SUM(det_no) AS BIGINT) AS total FROM @detections GROUP BY 1")
def _apply_match(t):
    def count(pdf):
        return pdf.groupby("match_id", as_index=False).agg(rows=("det_no", "size"), total=("det_no", "sum"))

    add = lambda parts: parts.groupBy("match_id").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"))
    return apply_per_match(t.detections.select("match_id", "frame_number", "det_no"), count, "match_id long, rows long, total long", add)
