"""Reports over job, metric, cache, storage and error logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtflow.constants import LOAD_WARNINGS
from courtflow.functions.geometry import safe_div

MB = 1024.0 * 1024.0
# Alert thresholds.
ALERTS = {"cpu_percent": ("high_cpu", 90.0), "memory_percent": ("high_memory", 85.0), "disk_percent": ("high_disk", 90.0)}
MIN_FPS = 5.0
MAX_ERROR_RATE = 0.1


def _n():
    return F.count(F.lit(1))


def _seconds(a: str, b: str) -> Column:
    """Seconds from timestamp ``a`` to ``b``."""
    micros = F.timestamp_diff("MICROSECOND", F.col(a), F.col(b))
    return micros / F.lit(1e6)


def _as_of(moment: str) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def job_statistics(jobs: DataFrame) -> DataFrame:
    """Jobs per status, with the mean duration of completed ones."""
    done = (F.col("status") == "completed") & F.col("completed_at").isNotNull()
    return jobs.groupBy("status").agg(
        _n().alias("jobs"),
        F.coalesce(F.avg(F.when(done, _seconds("created_at", "completed_at"))), F.lit(0.0)).alias("average_seconds"),
    )


def jobs_page(jobs: DataFrame, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page, newest first (job id breaks ties)."""
    d = jobs if status is None else jobs.filter(F.col("status") == status)
    return d.orderBy(F.desc("created_at"), "job_id").offset(offset).limit(limit)


def expired(df: DataFrame, column: str, as_of: str, days: float) -> DataFrame:
    """Rows whose timestamp is more than ``days`` before ``as_of``."""
    cut = F.timestamp_add("SECOND", F.lit(-int(days * 86400)), _as_of(as_of))
    return df.filter(F.col(column) < cut)


def purgeable_jobs(jobs: DataFrame, as_of: str, days: float = 7) -> DataFrame:
    return expired(jobs.filter(F.col("status").isin("completed", "failed")), "created_at", as_of, days)


def batch_status(jobs: DataFrame) -> DataFrame:
    """Counts by status, progress and time span per batch."""
    count = lambda s: F.count_if(F.col("status") == s)
    return jobs.groupBy("batch_id").agg(
        _n().alias("total_jobs"),
        count("completed").alias("completed_jobs"),
        count("failed").alias("failed_jobs"),
        count("running").alias("running_jobs"),
        count("pending").alias("pending_jobs"),
        (count("completed") / _n() * F.lit(100.0)).alias("progress"),
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
    ).withColumn("total_processing_time", _seconds("start_time", "end_time"))


def batch_results(jobs: DataFrame) -> DataFrame:
    """Finished jobs as result and error rows; a batch's list has no bound, so it
    stays rows."""
    done = jobs.filter(F.col("status").isin("completed", "failed"))
    ok = F.col("status") == "completed"
    return done.select(
        "batch_id",
        "job_id",
        F.when(ok, "result").otherwise("error").alias("kind"),
        F.when(ok, F.coalesce(_seconds("start_time", "end_time"), F.lit(0.0))).alias("processing_time"),
        F.when(~ok, F.col("error")).alias("error"),
    )


def batch_success(jobs: DataFrame) -> DataFrame:
    """Overall success rate and mean job time of the finished jobs (one row)."""
    ok, ended = F.col("status") == "completed", F.col("status").isin("completed", "failed")
    took = F.when(ok, _seconds("start_time", "end_time"))
    return jobs.agg(
        F.count_if(ended).alias("total_jobs_processed"),
        safe_div(F.count_if(ok), F.count_if(ended)).alias("success_rate"),
        F.coalesce(F.sum(took), F.lit(0.0)).alias("total_processing_time"),
        safe_div(F.coalesce(F.sum(took), F.lit(0.0)), F.count_if(ok)).alias("average_job_time"),
    )


def storage_stats(files: DataFrame) -> DataFrame:
    """Files and megabytes per type. ``files``: path, length (as binaryFile lists them)."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.groupBy(kind.alias("file_type")).agg(_n().alias("files"), (F.sum("length") / F.lit(MB)).alias("size_mb"))


def cache_key(video: Column, frame: Column, config: Column) -> Column:
    return F.md5(F.concat_ws(":", video, frame.cast("string"), config))


def latest_per_key(entries: DataFrame, key: str = "key", order: str = "accessed_at", tie: str = "entry_id") -> DataFrame:
    """The newest row of every key (insert-or-replace); an aggregate, so a hot key
    is reduced before the shuffle."""
    cols = [c for c in entries.columns if c != key]
    return entries.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(order, tie)).alias("e")).select(key, "e.*")


def cache_stats(entries: DataFrame, accesses: DataFrame) -> DataFrame:
    """Entries, size and age of the cache and its hit rate (one row)."""
    e = entries.agg(
        _n().alias("total_entries"),
        (F.coalesce(F.sum("file_size"), F.lit(0)) / F.lit(MB)).alias("total_size_mb"),
        F.min("created_at").alias("oldest_entry"),
        F.max("created_at").alias("newest_entry"),
    )
    a = accesses.agg(F.count_if("hit").alias("hit_count"), F.count_if(~F.col("hit")).alias("miss_count"))
    return e.crossJoin(F.broadcast(a)).withColumn(  # one row each
        "hit_rate", safe_div("hit_count", F.col("hit_count") + F.col("miss_count"))
    )


def eviction_candidates(entries: DataFrame, limit: int = 100) -> DataFrame:
    """Least recently, then least often used entries."""
    return entries.orderBy("accessed_at", "access_count", "key").limit(limit)


def compression_stats(blobs: DataFrame) -> DataFrame:
    """``blobs``: original_size, compressed_size, compression_ratio."""
    d = blobs.agg(
        _n().alias("total_entries"),
        (F.sum("compressed_size") / F.lit(MB)).alias("total_compressed_size_mb"),
        (F.sum("original_size") / F.lit(MB)).alias("total_original_size_mb"),
        F.avg("compression_ratio").alias("avg_compression_ratio"),
    )
    saved = F.col("total_original_size_mb") - F.col("total_compressed_size_mb")
    return d.withColumns(
        {"space_saved_mb": saved, "space_saved_percent": safe_div(saved, "total_original_size_mb") * F.lit(100.0)}
    )


def error_patterns(lines: DataFrame) -> DataFrame:
    """Exception types with their counts."""
    kind = F.trim(F.split(F.split(F.col("value"), "Exception: ")[1], r"\(")[0])
    d = lines.filter(F.col("value").contains("Exception: ")).groupBy(kind.alias("exception")).agg(_n().alias("n"))
    return d


def most_common_error(lines: DataFrame) -> DataFrame:
    return error_patterns(lines).orderBy(F.desc("n"), "exception").limit(1)


def critical_errors(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("value").contains("CRITICAL")).select(F.trim("value").alias("value"))


def metrics_summary(metrics: DataFrame, jobs: DataFrame, as_of: str, hours: float = 1.0) -> DataFrame:
    """CPU, memory and job speed over the hours before ``as_of`` (one row)."""
    since = F.timestamp_add("SECOND", F.lit(-int(hours * 3600)), _as_of(as_of))
    m = metrics.filter((F.col("timestamp") >= since) & (F.col("timestamp") <= _as_of(as_of)))
    j = jobs.filter((F.col("timestamp") >= since) & (F.col("timestamp") <= _as_of(as_of)))
    stats = lambda c, n: [F.avg(c).alias(f"{n}_avg"), F.max(c).alias(f"{n}_max"), F.min(c).alias(f"{n}_min")]
    a = m.agg(_n().alias("samples"), *stats("cpu_percent", "cpu"), *stats("memory_percent", "memory"))
    b = j.agg(_n().alias("jobs_completed"), *[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in (
        (F.avg("fps"), "fps_avg"), (F.max("fps"), "fps_max"), (F.min("fps"), "fps_min"))])
    return a.crossJoin(F.broadcast(b))  # one row each


def processing_metrics(samples: DataFrame) -> DataFrame:
    """Per job: frames, time, speed, error rate and peaks, from its samples
    (job_id, timestamp, frames, seconds, errors, memory_mb, cpu_percent). Seconds are added as
    decimals of a nanosecond, so that neither the order of samples nor their partitions matter at a
    threshold; those that are no such decimal are added as doubles."""
    exact = F.expr("try_cast(seconds AS decimal(28, 9))")
    rest = F.sum(F.when(exact.isNull(), F.col("seconds").cast("double")))
    total = F.sum(exact).cast("double")
    d = samples.groupBy("job_id").agg(
        F.max("timestamp").alias("timestamp"),
        F.sum("frames").alias("frames_processed"),
        F.coalesce(total + rest, total, rest).alias("processing_time"),
        F.sum("errors").alias("errors"),
        F.max("memory_mb").alias("memory_peak_mb"),
        F.max("cpu_percent").alias("cpu_peak_percent"),
    )
    return d.withColumns(
        {"fps": safe_div("frames_processed", "processing_time"), "error_rate": safe_div("errors", "frames_processed")}
    )


def job_alerts(jobs: DataFrame) -> DataFrame:
    """Slow and error-prone jobs."""
    kinds = F.explode(
        F.array_compact(
            F.array(
                F.when(F.col("fps") < MIN_FPS, F.struct(F.lit("low_fps").alias("alert"), F.col("fps").alias("value"))),
                F.when(
                    F.col("error_rate") > MAX_ERROR_RATE,
                    F.struct(F.lit("high_error_rate").alias("alert"), F.col("error_rate").alias("value")),
                ),
            )
        )
    )
    return jobs.select("job_id", kinds.alias("a")).select("job_id", "a.*")


def system_alerts(metrics: DataFrame) -> DataFrame:
    """One row per sample and threshold exceeded. Works on streams as well."""
    found = F.explode(
        F.array_compact(
            F.array(
                *[
                    F.when(
                        F.col(c) > limit,
                        F.struct(F.lit(name).alias("alert"), F.col(c).alias("value"), F.lit(limit).alias("threshold")),
                    )
                    for c, (name, limit) in ALERTS.items()
                ]
            )
        )
    )
    return metrics.select("timestamp", "host", found.alias("a")).select("timestamp", "host", "a.*")


def alert_summary(metrics: DataFrame, active_jobs: str = "active_jobs", max_jobs: int = 3) -> DataFrame:
    """Warnings and overall status per sample."""
    warn = F.array_compact(
        F.array(
            F.when(F.col("cpu_percent") > 80, F.lit(LOAD_WARNINGS["cpu"])),
            F.when(F.col("memory_percent") > 85, F.lit(LOAD_WARNINGS["memory"])),
            F.when(F.col("disk_percent") > 90, F.lit(LOAD_WARNINGS["disk"])),
            F.when(F.col(active_jobs) >= max_jobs, F.lit(LOAD_WARNINGS["jobs"])),
        )
    )
    d = metrics.withColumn("warnings", warn)
    return d.withColumn("status", F.when(F.size("warnings") > 0, "warning").otherwise("normal"))


def throughput_stats(results: DataFrame) -> DataFrame:
    """Per worker: frames done, time, speed, errors. ``results``: worker, success, seconds."""
    ok = F.col("success")
    took = F.coalesce(F.sum(F.when(ok, F.col("seconds"))), F.lit(0.0))
    return results.groupBy("worker").agg(
        F.count_if(ok).alias("frames_processed"),
        took.alias("total_processing_time"),
        safe_div(took, F.count_if(ok)).alias("avg_processing_time"),
        safe_div(F.count_if(ok), took).alias("fps"),
        F.count_if(~ok).alias("errors"),
    )


def memory_peak(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.max("memory_percent").alias("peak_system_memory_percent"), F.max("memory_mb").alias("peak_process_memory_mb")
    )


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(_n().alias("n"))


def export_metrics(metrics: DataFrame, as_of: str, hours: float = 24.0) -> DataFrame:
    """Samples of the last hours as JSON lines, one per row, ready for a text sink."""
    since = F.timestamp_add("SECOND", F.lit(-int(hours * 3600)), _as_of(as_of))
    recent = metrics.filter((F.col("timestamp") >= since) & (F.col("timestamp") <= _as_of(as_of)))
    return recent.select(F.to_json(F.struct(*metrics.columns)).alias("value"))


def analysis_overview(
    detections: DataFrame, changes: DataFrame, held: DataFrame, shots: DataFrame, violations: DataFrame, frames: DataFrame
) -> DataFrame:
    """The nested summary of a run, one row per match."""
    goals = F.count_if(F.col("result") == "goal")
    parts = {
        "detection": detections.groupBy("match_id").agg(
            _n().alias("total_objects"),
            F.avg("confidence").alias("avg_confidence"),
            F.count_distinct("frame_number").alias("frames_with_detections"),
        ),
        "possession": changes.groupBy("match_id").agg(
            _n().alias("total_changes"), F.avg("duration_seconds").alias("avg_duration")
        ),
        "held": held.groupBy("match_id").agg(_n().alias("violations")),
        "shooting": shots.groupBy("match_id").agg(
            _n().alias("total_shots"), (goals / _n()).alias("accuracy"), goals.alias("goals")
        ),
        "zones": violations.groupBy("match_id").agg(
            _n().alias("total_violations"), F.count_distinct("violation_type").alias("violation_types")
        ),
    }
    out = frames.groupBy("match_id").agg(_n().alias("frames"))
    for name, part in parts.items():
        cols = [c for c in part.columns if c != "match_id"]
        out = out.join(part.select("match_id", F.struct(*cols).alias(name)), "match_id", "left")
    zero = F.lit(0).cast("long")
    get = lambda path, default=zero: F.coalesce(F.col(path), default)
    return out.select(
        "match_id",
        F.struct(
            get("detection.total_objects").alias("total_objects"),
            get("detection.avg_confidence", F.lit(0.0)).alias("avg_confidence"),
            safe_div(get("detection.frames_with_detections"), "frames").alias("detection_rate"),
        ).alias("detection"),
        F.struct(
            get("possession.total_changes").alias("total_changes"),
            get("possession.avg_duration", F.lit(0.0)).alias("avg_duration"),
            get("held.violations").alias("violations"),
        ).alias("possession"),
        F.struct(
            get("shooting.total_shots").alias("total_shots"),
            get("shooting.accuracy", F.lit(0.0)).alias("accuracy"),
            get("shooting.goals").alias("goals"),
        ).alias("shooting"),
        F.struct(
            get("zones.total_violations").alias("total_violations"), get("zones.violation_types").alias("violation_types")
        ).alias("zones"),
        "frames",
    )
