"""Job, metric, cache, storage and error-log queries."""

from pyspark.sql import functions as F

from courtflow.operators import possession as P
from courtflow.operators import service as V
from courtflow.operators import zones as Z
from courtflow.plans.possession import LABELS, VIOLATIONS, smoothed_labels
from courtflow.plans.registry import query, shown
from courtflow.plans.zones import BASE_V, ZONED

JOBS = """WITH jb AS (SELECT *, CASE WHEN status <> 'pending' THEN created_at + to_seconds(wait_s) END AS start_time,
 CASE WHEN status IN ('completed','failed') THEN created_at + to_seconds(wait_s + run_s) END AS end_time FROM @job_rows)"""
AS_OF = "2024-01-20 00:00:00"


@query(
    "job_statistics",
    "SELECT status, COUNT(*) AS jobs, ROUND(coalesce(AVG(CASE WHEN status='completed' THEN wait_s + run_s END), 0e0), 8) AS average_seconds FROM @job_rows GROUP BY 1",
)
def _stats(t):
    return shown(V.job_statistics(t.jobs), "average_seconds", places=8)


@query(
    "jobs_page",
    "SELECT job_id, batch_id, status FROM @job_rows WHERE status = 'failed' ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 40",
)
def _page(t):
    return V.jobs_page(t.jobs, "failed", limit=20, offset=40).select("job_id", "batch_id", "status")


@query(
    "purgeable_jobs",
    "SELECT job_id, status FROM @job_rows WHERE status IN ('completed','failed') AND created_at < TIMESTAMP '1999-01-01' - INTERVAL 7 DAY",
)
def _purge(t):
    return V.purgeable_jobs(t.jobs, "1999-01-01 00:00:00").select("job_id", "status")


@query(
    "expired_cache_entries",
    f"SELECT entry_id FROM @cache_log WHERE created_at < TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY",
)
def _expired(t):
    return V.expired(t.cache_log, "created_at", AS_OF, 10).select("entry_id")


@query(
    "batch_status",
    JOBS
    + """ SELECT batch_id, COUNT(*) AS total_jobs, COUNT(*) FILTER (WHERE status='completed') AS completed_jobs, COUNT(*) FILTER (WHERE status='failed') AS failed_jobs,
 COUNT(*) FILTER (WHERE status='running') AS running_jobs, COUNT(*) FILTER (WHERE status='pending') AS pending_jobs,
 ROUND(COUNT(*) FILTER (WHERE status='completed')/CAST(COUNT(*) AS DOUBLE)*100e0,6) AS progress, CAST(MIN(start_time) AS VARCHAR) AS start_time,
 CAST(MAX(end_time) AS VARCHAR) AS end_time, ROUND(epoch(MAX(end_time)) - epoch(MIN(start_time)),6) AS total_processing_time FROM jb GROUP BY 1""",
)
def _batch(t):
    d = shown(V.batch_status(t.jobs), "progress", "total_processing_time")
    return d.withColumns({c: F.col(c).cast("string") for c in ("start_time", "end_time")})


@query(
    "batch_results",
    """SELECT batch_id, job_id, CASE status WHEN 'completed' THEN 'result' ELSE 'error' END AS kind, CASE WHEN status='completed' THEN CAST(run_s AS DOUBLE) END AS processing_time,
 CASE WHEN status='failed' THEN error END AS error FROM @job_rows WHERE status IN ('completed','failed')""",
)
def _results(t):
    return V.batch_results(t.jobs)


@query(
    "batch_success",
    """SELECT COUNT(*) FILTER (WHERE status IN ('completed','failed')) AS total_jobs_processed,
 ROUND(COUNT(*) FILTER (WHERE status='completed')/CAST(COUNT(*) FILTER (WHERE status IN ('completed','failed')) AS DOUBLE),6) AS success_rate,
 CAST(SUM(CASE WHEN status='completed' THEN run_s ELSE 0 END) AS DOUBLE) AS total_processing_time,
 ROUND(SUM(CASE WHEN status='completed' THEN run_s ELSE 0 END)/CAST(COUNT(*) FILTER (WHERE status='completed') AS DOUBLE),6) AS average_job_time FROM @job_rows""",
)
def _success(t):
    return shown(V.batch_success(t.jobs), "success_rate", "average_job_time")


@query(
    "storage_stats",
    "SELECT lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS file_type, COUNT(*) AS files, ROUND(SUM(length)/1048576e0, 6) AS size_mb FROM @file_rows GROUP BY 1",
)
def _storage(t):
    return shown(V.storage_stats(t.file_rows), "size_mb")


KEYED = "WITH k AS (SELECT *, md5(concat_ws(':', video_path, CAST(frame_number AS VARCHAR), 'cfg')) AS key FROM @cache_log), "
LATEST = KEYED + "l AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY accessed_at DESC, entry_id DESC) AS rn FROM k) WHERE rn = 1)"


@query("latest_per_key", LATEST + " SELECT key, entry_id, video_path, frame_number, file_size FROM l")
def _latest(t):
    return V.latest_per_key(t.cache_entries).select("key", "entry_id", "video_path", "frame_number", "file_size")


@query(
    "cache_stats",
    LATEST
    + """ SELECT COUNT(*) AS total_entries, ROUND(SUM(file_size)/1048576e0,6) AS total_size_mb, CAST(MIN(created_at) AS VARCHAR) AS oldest_entry,
 CAST(MAX(created_at) AS VARCHAR) AS newest_entry, (SELECT COUNT(*) FROM k WHERE hit) AS hit_count, (SELECT COUNT(*) FROM k WHERE NOT hit) AS miss_count,
 ROUND((SELECT COUNT(*) FROM k WHERE hit)/CAST((SELECT COUNT(*) FROM k) AS DOUBLE),6) AS hit_rate FROM l""",
)
def _cache(t):
    d = V.cache_stats(V.latest_per_key(t.cache_entries), t.cache_entries)
    d = d.withColumns({c: F.col(c).cast("string") for c in ("oldest_entry", "newest_entry")})
    return shown(d, "total_size_mb", "hit_rate")


@query("eviction_candidates", LATEST + " SELECT key, entry_id FROM l ORDER BY accessed_at, access_count, key LIMIT 100")
def _evict(t):
    return V.eviction_candidates(V.latest_per_key(t.cache_entries)).select("key", "entry_id")


@query(
    "compression_stats",
    """SELECT COUNT(*) AS total_entries, ROUND(SUM(compressed_size)/1048576e0,8) AS total_compressed_size_mb, ROUND(SUM(original_size)/1048576e0,8) AS total_original_size_mb,
 ROUND(AVG(compression_ratio),8) AS avg_compression_ratio, ROUND(SUM(original_size)/1048576e0-SUM(compressed_size)/1048576e0,8) AS space_saved_mb,
 ROUND((SUM(original_size)/1048576e0-SUM(compressed_size)/1048576e0)/(SUM(original_size)/1048576e0)*100e0,8) AS space_saved_percent FROM @blobs""",
)
def _compression(t):
    d = V.compression_stats(t.blobs)
    return shown(d, *[c for c in d.columns if c != "total_entries"], places=8)


EXC = "WITH x AS (SELECT trim(string_split(string_split(value, 'Exception: ')[2], '(')[1]) AS exception FROM @error_lines WHERE contains(value, 'Exception: '))"


@query("error_patterns", EXC + " SELECT exception, COUNT(*) AS n FROM x GROUP BY 1")
def _errors(t):
    return V.error_patterns(t.error_lines)


@query("most_common_error", EXC + " SELECT exception, COUNT(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, exception LIMIT 1")
def _common(t):
    return V.most_common_error(t.error_lines)


@query("critical_errors", "SELECT trim(value) AS value FROM @error_lines WHERE contains(value, 'CRITICAL')")
def _critical(t):
    return V.critical_errors(t.error_lines)


PM = """pm AS (SELECT job_id, MAX(timestamp) AS timestamp, CAST(SUM(frames) AS BIGINT) AS frames_processed, SUM(seconds) AS processing_time, CAST(SUM(errors) AS BIGINT) AS errors,
 MAX(memory_mb) AS memory_peak_mb, MAX(cpu_percent) AS cpu_peak_percent, SUM(frames)/SUM(seconds) AS fps, SUM(errors)/CAST(SUM(frames) AS DOUBLE) AS error_rate
 FROM @work_samples GROUP BY 1)"""


@query(
    "processing_metrics",
    "WITH "
    + PM
    + """ SELECT job_id, CAST(timestamp AS VARCHAR) AS timestamp, frames_processed, ROUND(processing_time,8) AS processing_time, errors, ROUND(memory_peak_mb,8) AS memory_peak_mb,
 cpu_peak_percent, ROUND(fps,8) AS fps, ROUND(error_rate,8) AS error_rate FROM pm""",
)
def _processing(t):
    d = V.processing_metrics(t.work_samples).withColumn("timestamp", F.col("timestamp").cast("string"))
    return shown(d, "processing_time", "memory_peak_mb", "fps", "error_rate", places=8)


@query(
    "job_alerts",
    "WITH "
    + PM
    + """ SELECT job_id, 'low_fps' AS alert, ROUND(fps,6) AS value FROM pm WHERE fps < 5
 UNION ALL SELECT job_id, 'high_error_rate', ROUND(error_rate,6) FROM pm WHERE error_rate > 0.1e0""",
)
def _job_alerts(t):
    return shown(V.job_alerts(V.processing_metrics(t.work_samples)), "value")


RANGE = f"timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR AND timestamp <= TIMESTAMP '{AS_OF}'"


@query(
    "metrics_summary",
    "WITH "
    + PM
    + f""", m AS (SELECT COUNT(*) AS samples, ROUND(AVG(cpu_percent),8) AS cpu_avg, MAX(cpu_percent) AS cpu_max, MIN(cpu_percent) AS cpu_min, ROUND(AVG(memory_percent),8) AS memory_avg,
 MAX(memory_percent) AS memory_max, MIN(memory_percent) AS memory_min FROM @system_metrics WHERE {RANGE}),
j AS (SELECT COUNT(*) AS jobs_completed, ROUND(coalesce(AVG(fps),0e0),8) AS fps_avg, ROUND(coalesce(MAX(fps),0e0),8) AS fps_max, ROUND(coalesce(MIN(fps),0e0),8) AS fps_min FROM pm WHERE {RANGE})
SELECT * FROM m, j""",
)
def _summary(t):
    d = V.metrics_summary(t.system_metrics, V.processing_metrics(t.work_samples), AS_OF, hours=48)
    return shown(d, "cpu_avg", "memory_avg", "fps_avg", "fps_max", "fps_min", places=8)


@query(
    "system_alerts",
    """SELECT CAST(timestamp AS VARCHAR) AS timestamp, host, 'high_cpu' AS alert, cpu_percent AS value, 90e0 AS threshold FROM @system_metrics WHERE cpu_percent > 90
 UNION ALL SELECT CAST(timestamp AS VARCHAR), host, 'high_memory', memory_percent, 85e0 FROM @system_metrics WHERE memory_percent > 85
 UNION ALL SELECT CAST(timestamp AS VARCHAR), host, 'high_disk', disk_percent, 90e0 FROM @system_metrics WHERE disk_percent > 90""",
)
def _alerts(t):
    return V.system_alerts(t.system_metrics).withColumn("timestamp", F.col("timestamp").cast("string"))


@query(
    "alert_summary",
    """WITH w AS (SELECT CAST(timestamp AS VARCHAR) AS timestamp, host, concat_ws(' | ', CASE WHEN cpu_percent > 80 THEN 'High CPU usage detected' END,
 CASE WHEN memory_percent > 85 THEN 'High memory usage detected' END, CASE WHEN disk_percent > 90 THEN 'Low disk space' END,
 CASE WHEN active_jobs >= 3 THEN 'Processor at maximum capacity' END) AS warnings FROM @system_metrics)
SELECT *, CASE WHEN warnings = '' THEN 'normal' ELSE 'warning' END AS status FROM w""",
)
def _alert_summary(t):
    d = V.alert_summary(t.system_metrics)
    return d.select(F.col("timestamp").cast("string").alias("timestamp"), "host", F.array_join("warnings", " | ").alias("warnings"), "status")


@query(
    "throughput_stats",
    """SELECT worker, COUNT(*) FILTER (WHERE success) AS frames_processed, ROUND(SUM(seconds) FILTER (WHERE success),8) AS total_processing_time,
 ROUND(SUM(seconds) FILTER (WHERE success)/COUNT(*) FILTER (WHERE success),8) AS avg_processing_time,
 ROUND(COUNT(*) FILTER (WHERE success)/SUM(seconds) FILTER (WHERE success),8) AS fps, COUNT(*) FILTER (WHERE NOT success) AS errors FROM @work_samples GROUP BY 1""",
)
def _throughput(t):
    return shown(V.throughput_stats(t.work_samples), "total_processing_time", "avg_processing_time", "fps", places=8)


@query(
    "memory_peak",
    "SELECT MAX(memory_percent) AS peak_system_memory_percent, MAX(memory_mb) AS peak_process_memory_mb FROM @system_metrics",
)
def _peak(t):
    return V.memory_peak(t.system_metrics)


@query("event_counts", "SELECT event_type, COUNT(*) AS n FROM @events GROUP BY 1")
def _events(t):
    return V.event_counts(t.events)


@query(
    "export_metrics",
    f"SELECT host, cpu_percent, memory_percent FROM @system_metrics WHERE {RANGE.replace('48', '24')}",
)
def _export(t):
    lines = V.export_metrics(t.system_metrics, AS_OF, hours=24)
    parsed = F.from_json("value", "host long, cpu_percent double, memory_percent double").alias("j")
    return lines.select(parsed).select("j.*")


@query(
    "analysis_overview",
    LABELS
    + VIOLATIONS
    + ", "
    + ZONED.replace("WITH ", "")
    + ","
    + BASE_V
    + """, f AS (SELECT match_id, COUNT(*) AS frames FROM @frames GROUP BY 1),
d AS (SELECT match_id, COUNT(*) AS n, AVG(confidence) AS c, COUNT(DISTINCT frame_number) AS fw FROM @detections GROUP BY 1),
p AS (SELECT match_id, COUNT(*) AS n, AVG(end_ts-start_ts) AS a FROM pc GROUP BY 1), h AS (SELECT match_id, COUNT(*) AS n FROM tv WHERE rn = 1 GROUP BY 1),
s AS (SELECT match_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE result='goal') AS g FROM @shots GROUP BY 1),
b AS (SELECT match_id, COUNT(*) AS n, COUNT(DISTINCT violation_type) AS k FROM bv GROUP BY 1)
SELECT f.match_id, coalesce(d.n,0) AS total_objects, ROUND(coalesce(c,0e0),8) AS avg_confidence, ROUND(coalesce(fw,0)/CAST(frames AS DOUBLE),8) AS detection_rate,
 coalesce(p.n,0) AS total_changes, ROUND(coalesce(a,0e0),8) AS avg_duration, coalesce(h.n,0) AS held_ball, coalesce(s.n,0) AS total_shots,
 ROUND(coalesce(s.g/CAST(s.n AS DOUBLE),0e0),8) AS accuracy, coalesce(s.g,0) AS goals, coalesce(b.n,0) AS total_violations, coalesce(b.k,0) AS violation_types
FROM f LEFT JOIN d USING (match_id) LEFT JOIN p USING (match_id) LEFT JOIN h USING (match_id) LEFT JOIN s USING (match_id) LEFT JOIN b USING (match_id)""",
)
def _overview(t):
    s = smoothed_labels(t)
    d = V.analysis_overview(
        t.detections, P.possession_changes(s), P.three_second_violations(s), t.shots, Z.zone_violations(t.players), t.frames
    )
    d = d.select(
        "match_id", "detection.*", "possession.total_changes", "possession.avg_duration",
        F.col("possession.violations").alias("held_ball"), "shooting.*", "zones.*",
    )
    return shown(d, "avg_confidence", "detection_rate", "avg_duration", "accuracy", places=8)
