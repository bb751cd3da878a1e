"""Input tables derived from the given parquet files.

Each derivation is plain SQL that Spark and the checker read alike; it only
reshapes the given tables into the record layouts the operators expect.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from courtflow.session import scratch_path

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

DERIVED: dict[str, str] = {
    "game_results": """
SELECT o_orderkey AS game_id,
  concat('T', CAST(o_custkey % 12 AS STRING)) AS home_team,
  concat('T', CAST((o_custkey % 12 + 1 + o_orderkey % 11) % 12 AS STRING)) AS away_team,
  CAST(floor(o_totalprice) AS BIGINT) % 31 AS home_score,
  (o_orderkey * 7) % 29 AS away_score,
  CASE o_orderkey % 3 WHEN 0 THEN 'U12' WHEN 1 THEN 'U15' ELSE 'U18' END AS category,
  CAST(o_orderdate AS DATE) AS game_date
FROM @orders""",
    "det_base": """
SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
  l_quantity, l_extendedprice, l_tax, l_shipdate) AS BIGINT) AS det_no FROM @lineitem""",
    "det_shape": """
SELECT l_orderkey % 16 AS match_id, CAST(floor(l_orderkey / 16e0) AS BIGINT) AS frame_number, det_no,
  CASE WHEN det_no = 1 THEN 'ball' WHEN det_no = 2 AND l_suppkey % 3 = 0 THEN 'hoop' ELSE 'player' END AS class_name,
  CASE WHEN det_no = 1 THEN 30 ELSE 60 + l_suppkey % 20 END AS w,
  CASE WHEN det_no = 1 THEN 30 ELSE 120 + l_partkey % 40 END AS h,
  (CAST(floor(l_orderkey / 16e0) AS BIGINT) * 7 + l_partkey % 97) % 400 AS cx,
  (l_suppkey * 3 + l_partkey % 89) % 200 AS cy,
  (30 + l_partkey % 70) / 100e0 AS conf_raw, l_partkey, l_suppkey
FROM @det_base""",
    "detections": """
SELECT match_id, frame_number, frame_number / 30e0 AS ts_sec, det_no, class_name,
  cx - w / 2e0 AS x1, cy - h / 2e0 AS y1, cx + w / 2e0 AS x2, cy + h / 2e0 AS y2,
  CAST(conf_raw AS DOUBLE) AS confidence,
  CASE WHEN class_name = 'player' THEN l_partkey % 14 + 1 END AS track_id,
  CASE WHEN class_name = 'player' THEN CASE WHEN l_partkey % 14 < 7 THEN 'home' ELSE 'away' END END AS team,
  CASE WHEN class_name = 'player' THEN CASE l_partkey % 7 WHEN 0 THEN 'GS' WHEN 1 THEN 'GA' WHEN 2 THEN 'WA' WHEN 3 THEN 'C'
    WHEN 4 THEN 'WD' WHEN 5 THEN 'GD' ELSE 'GK' END END AS position,
  (l_suppkey * 331 % 3300) / 100e0 - 1e0 AS court_x, (l_partkey * 17 % 1700) / 100e0 - 8e-1 AS court_y
FROM @det_shape""",
    "frames": "SELECT DISTINCT match_id, frame_number, frame_number / 30e0 AS ts_sec FROM @detections",
    # Ball possession per frame as a raw (unsmoothed) label; events arrive in id order.
    "possession_raw": """
SELECT user_id % 8 AS match_id, event_id AS frame_number, event_id / 30e0 AS ts_sec,
  CASE WHEN event_type = 'error' THEN NULL WHEN value < 70 THEN 1 ELSE 2 + CAST(floor(value) AS BIGINT) % 2 END AS raw_player,
  CASE WHEN event_type = 'error' THEN 0e0 ELSE 5e-1 + (event_id % 50) / 100e0 END AS raw_confidence
FROM @events""",
    # Shots taken, one per order.
    "shots": """
SELECT o_custkey % 16 AS match_id, o_orderkey AS frame_number, o_orderkey / 30e0 AS ts_sec,
  o_custkey % 14 + 1 AS shooter_id, CASE WHEN o_custkey % 14 < 7 THEN 'home' ELSE 'away' END AS team,
  CASE WHEN o_custkey % 2 = 0 THEN 'GS' ELSE 'GA' END AS position,
  CASE WHEN o_custkey % 14 < 7 THEN 'shooting_circle_away' ELSE 'shooting_circle_home' END AS zone,
  (CAST(floor(o_totalprice) AS BIGINT) % 800) / 100e0 AS distance_to_goal,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 181 - 90 AS DOUBLE) AS angle_to_goal,
  (CAST(floor(o_totalprice) AS BIGINT) % 3050) / 100e0 AS ball_x,
  (CAST(floor(o_totalprice) AS BIGINT) % 1525) / 100e0 AS ball_y,
  CASE o_orderstatus WHEN 'F' THEN 'goal' WHEN 'O' THEN 'miss' ELSE 'blocked' END AS result
FROM @orders""",
    # Text read on a player box: mostly numbers, some position codes, some noise.
    "ocr_reads": """
SELECT d.match_id, d.frame_number, d.frame_number / 30e0 AS timestamp, d.det_no, CASE l_partkey % 13 WHEN 0 THEN 'GS' WHEN 1 THEN 'GA'
   WHEN 2 THEN 'C-7' WHEN 3 THEN ' wd' ELSE CAST(l_partkey % 14 + 7 + CASE WHEN l_suppkey % 4 = 0 THEN l_partkey % 11 ELSE 0 END AS STRING) END AS text,
  CAST(conf_raw AS DOUBLE) AS confidence, cx - 10e0 AS x1, cy - 12e0 AS y1, cx + (l_partkey % 90) * 1e0 AS x2, cy + 12e0 AS y2,
  l_partkey % 14 + 1 AS player_id
FROM @det_shape d WHERE class_name = 'player'""",
    # Two jersey colours per player box.
    "jersey_colors": """
SELECT match_id, frame_number, det_no, l_partkey % 14 + 1 AS player_id, CASE WHEN l_partkey % 14 < 7 THEN 'home' ELSE 'away' END AS team,
  1 AS color_no, l_partkey * 7 % 256 AS r, l_suppkey * 5 % 256 AS g, (l_partkey + l_suppkey) * 3 % 256 AS b FROM @det_shape WHERE class_name = 'player'
UNION ALL
SELECT match_id, frame_number, det_no, l_partkey % 14 + 1, CASE WHEN l_partkey % 14 < 7 THEN 'home' ELSE 'away' END,
  2, l_partkey * 11 % 256, l_suppkey * 13 % 256, frame_number % 256 FROM @det_shape WHERE class_name = 'player'""",
    # Matrices over time, one per supplier, elements h0..h8.
    "calibration_rows": """
SELECT s_suppkey % 16 AS match_id, CAST(floor(s_suppkey / 16e0) AS BIGINT) * 97 + s_suppkey % 16 * 3 AS from_frame,
  5e-2 + s_suppkey % 7 / 1000e0 AS h0, 1e-3 * (s_suppkey % 5) AS h1, -1e0 + s_suppkey % 3 / 10e0 AS h2,
  2e-3 * (s_suppkey % 4) AS h3, 7e-2 + s_suppkey % 9 / 1000e0 AS h4, 5e-1 * (s_suppkey % 2) AS h5,
  1e-5 * (s_suppkey % 6) AS h6, 1e-5 * (s_suppkey % 8) AS h7, CASE WHEN s_suppkey % 25 = 24 THEN 0e0 ELSE 1e0 END AS h8,
  (s_suppkey % 101) / 100e0 AS confidence, CASE s_suppkey % 3 WHEN 0 THEN 'hoops' WHEN 1 THEN 'lines' ELSE 'manual' END AS method
FROM @supplier""",
    # Points with known court position, one per part.
    "calibration_points": """
SELECT p_partkey % 16 AS match_id, p_partkey AS point_no, (p_partkey * 37 % 600) * 1e0 AS px, (p_partkey * 53 % 220) * 1e0 AS py,
  (p_partkey * 37 % 600) / 20e0 - 1e0 AS court_x, (p_partkey * 53 % 220) * 7e-2 AS court_y
FROM @part""",
    # Calibration attempts, one per part.
    "calibration_attempts": """
SELECT p_partkey % 16 AS match_id, p_partkey AS frame_number, CASE p_partkey % 3 WHEN 0 THEN 'hoops' WHEN 1 THEN 'lines' ELSE 'manual' END AS method,
  p_partkey * 7 % 5 <> 0 AS success, (30 + p_partkey * 13 % 71) / 100e0 AS accuracy, (p_partkey * 17 % 101) / 100e0 AS confidence,
  6e-1 + (p_partkey % 4) / 10e0 AS parameter
FROM @part""",
    # Hoop drift per frame.
    "hoop_drift": """
SELECT match_id, frame_number, COUNT(CASE WHEN class_name = 'hoop' THEN 1 END) AS hoops, MAX(l_partkey % 60) * 1e0 AS drift_px
FROM @det_shape GROUP BY match_id, frame_number""",
    # Service jobs, one per order; waiting and running time in seconds.
    "job_rows": """
SELECT o_orderkey AS job_id, o_custkey % 40 AS batch_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed'
   ELSE CASE o_orderkey % 2 WHEN 0 THEN 'running' ELSE 'pending' END END AS status,
  o_orderdate AS created_at, o_orderkey % 3600 AS wait_s, CAST(floor(o_totalprice) AS BIGINT) % 7200 AS run_s,
  CASE WHEN o_orderstatus = 'P' THEN concat('job ', CAST(o_orderkey AS STRING), ' failed') END AS error
FROM @orders""",
    # Host samples, one per event.
    "system_metrics": """
SELECT ts AS timestamp, user_id % 5 AS host, (event_id * 37 % 1000) / 10e0 AS cpu_percent, (event_id * 53 % 1000) / 10e0 AS memory_percent,
  (event_id * 71 % 1000) / 10e0 AS disk_percent, value * 3e0 AS memory_mb, event_id % 5 AS active_jobs
FROM @events""",
    # Work samples of the jobs, one per event.
    "work_samples": """
SELECT user_id AS job_id, ts AS timestamp, CASE WHEN user_id % 9 = 0 THEN 1 ELSE event_id % 50 + 1 END AS frames,
  (event_id % 90 + 10) * (user_id % 12 + 1) / 100e0 AS seconds,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS errors, value * 3e0 AS memory_mb, (event_id * 37 % 1000) / 10e0 AS cpu_percent,
  event_type <> 'error' AS success, event_id % 8 AS worker
FROM @events""",
    # Cache accesses; the newest one per key is the stored entry.
    "cache_log": """
SELECT event_id AS entry_id, concat('video', CAST(user_id AS STRING)) AS video_path, event_id % 97 AS frame_number, ts AS created_at,
  ts AS accessed_at, event_id % 11 AS access_count, event_id * 101 % 50000 AS file_size, event_type <> 'error' AS hit
FROM @events""",
    "blobs": """
SELECT l_orderkey AS blob_id, l_partkey * 1000 + 500 AS original_size, l_partkey * 300 + l_suppkey AS compressed_size,
  (l_partkey * 300 + l_suppkey) / CAST(l_partkey * 1000 + 500 AS DOUBLE) AS compression_ratio
FROM @lineitem""",
    "error_lines": """
SELECT CASE event_id % 7 WHEN 0 THEN concat('CRITICAL worker ', CAST(user_id AS STRING), ' lost ')
  WHEN 1 THEN concat('INFO nothing to do for ', CAST(user_id AS STRING))
  ELSE concat('ERROR Exception: ', CASE event_id % 5 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'KeyError' ELSE 'RuntimeError' END, '(', CAST(event_id AS STRING), ')') END AS value
FROM @events WHERE event_type = 'error'""",
    # Result files, one per page.
    "file_rows": """
SELECT concat('results/', CAST(page_id % 13 AS STRING), '/out', CAST(page_id AS STRING), CASE page_id % 4 WHEN 0 THEN '.json' WHEN 1 THEN '.csv'
  WHEN 2 THEN '.MP4' ELSE '.png' END) AS path, length(html) * 1000 AS length FROM @pages""",
    # Manual annotation of possession; sign-up events are not annotated.
    "truth": """
SELECT user_id % 8 AS match_id, event_id AS frame_number,
  CASE WHEN event_type = 'view' AND value < 20 THEN NULL WHEN value < 75 THEN 1 ELSE 2 + CAST(floor(value) AS BIGINT) % 2 END AS true_player,
  5e-1 + (event_id % 50) / 100e0 AS true_confidence
FROM @events WHERE event_type <> 'signup'""",
    # One validation report per customer, label lists as comma-separated text.
    "report_rows": """
SELECT c_name AS video_name, c_custkey % 60 * 1e0 AS segment_start, c_custkey % 60 + 30e0 AS segment_end,
  c_custkey % 50 + c_custkey * 7 % 30 + c_custkey * 11 % 20 + c_custkey * 13 % 40 AS total_frames,
  c_custkey % 50 AS tp, c_custkey * 7 % 30 AS fp, c_custkey * 11 % 20 AS fn, c_custkey * 13 % 40 AS tn,
  (c_custkey % 17) / 100e0 AS processing_time_per_frame,
  CASE c_custkey % 4 WHEN 0 THEN 'Multiple players near ball'
   WHEN 1 THEN 'Multiple players near ball,Low confidence possession assignment' WHEN 2 THEN 'Ball in air - no clear possession' ELSE '' END AS edge_text,
  CASE c_custkey % 3 WHEN 0 THEN 'Frequent ball detection failures' WHEN 1 THEN 'High rate of missed possession assignments' ELSE '' END AS failure_text,
  CASE c_custkey % 5 WHEN 0 THEN 'Improve precision,Improve recall' WHEN 1 THEN 'Improve recall' WHEN 2 THEN 'Review confidence' ELSE '' END AS advice_text
FROM @customer""",
}


def sql_with_inputs(sql: str) -> str:
    """Prefix ``sql`` with the derivations it names (checker dialect)."""
    body = re.sub(r"\s+$", "", sql)
    needed: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"@(\w+)", text):
            if name in DERIVED and name not in needed:
                need(DERIVED[name])
                needed.append(name)

    need(body)
    plain = lambda text: re.sub(r"@(\w+)", r"\1", text)
    if not needed:
        return plain(body)
    ctes = ",\n".join(f"{n} AS ({plain(DERIVED[n]).strip()})" for n in needed)
    head = re.match(r"\s*WITH\s+(RECURSIVE\s)?", body, re.I)
    rest = plain(body[head.end():] if head else body)
    return f"WITH {(head and head[1]) or ''}{ctes}{',' if head else ''}\n{rest}"


# Derived with a window over the whole line-item table, and read by most queries: written
# once per session and folder, as a deployment has its detections stored.
STORED = ("det_shape", "detections")
_stored: dict[tuple[str, str, str], str] = {}


class Tables:
    """Lazy access to the given and derived tables under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in BASE and name not in DERIVED):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                self._made[name] = self._stored_table(name) if name in STORED else self._derive(name)
        return self._made[name]

    def _derive(self, name: str) -> DataFrame:
        text = DERIVED[name]
        inputs = {n: getattr(self, n) for n in set(re.findall(r"@(\w+)", text))}
        return self.spark.sql(re.sub(r"@(\w+)", r"{\1}", text), **inputs)

    def _stored_table(self, name: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        df = self._derive(name)
        if key not in _stored:
            path = scratch_path(self.spark, name)
            df.write.parquet(path)
            _stored[key] = path
        return self.spark.read.schema(df.schema).parquet(_stored[key])

    def of_class(self, name: str) -> DataFrame:
        from pyspark.sql import functions as F

        return self.detections.filter(F.col("class_name") == name)

    @property
    def calibrations(self) -> DataFrame:
        from pyspark.sql import functions as F

        h = [f"h{i}" for i in range(9)]
        return self.calibration_rows.withColumn("h", F.array(*h)).drop(*h)

    @property
    def jobs(self) -> DataFrame:
        from pyspark.sql import functions as F

        d = self.job_rows
        started, ended = F.col("status") != "pending", F.col("status").isin("completed", "failed")
        d = d.withColumn("start_time", F.when(started, F.timestamp_add("SECOND", "wait_s", "created_at")))
        d = d.withColumn("end_time", F.when(ended, F.timestamp_add("SECOND", "run_s", "start_time")))
        return d.withColumn("completed_at", F.col("end_time")).drop("wait_s", "run_s")

    @property
    def cache_entries(self) -> DataFrame:
        from pyspark.sql import functions as F

        from courtflow.operators.service import cache_key

        key = cache_key(F.col("video_path"), F.col("frame_number"), F.lit("cfg"))
        return self.cache_log.withColumn("key", key)

    @property
    def validation_reports(self) -> DataFrame:
        from pyspark.sql import functions as F

        lists = {"edge_cases_found": "edge_text", "failure_modes": "failure_text", "recommendations": "advice_text"}
        return self.report_rows.withColumns({n: F.split(F.col(c), ",") for n, c in lists.items()})

    @property
    def players(self) -> DataFrame:
        return self.of_class("player")

    @property
    def balls(self) -> DataFrame:
        return self.of_class("ball")

    @property
    def hoops(self) -> DataFrame:
        return self.of_class("hoop")
