"""Readers. Schemas are fixed; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtflow import schemas


def _read_table(spark: SparkSession, path: str, schema: str, optional: bool = False) -> DataFrame:
    """CSV with header, or parquet when the path says so. With ``optional`` a
    missing path is an empty table."""
    reader = spark.read.schema(schema)
    try:
        if path.rstrip("/").endswith(".parquet"):
            return reader.parquet(path)
        return reader.option("header", True).csv(path)
    except AnalysisException as e:
        if optional and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_game_results(spark: SparkSession, path: str) -> DataFrame:
    return _read_table(spark, path, schemas.GAME_RESULTS)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return _read_table(spark, path, schemas.DETECTIONS)


def read_possession(spark: SparkSession, path: str) -> DataFrame:
    return _read_table(spark, path, schemas.POSSESSION_DATA, optional=True)


def read_possession_changes(spark: SparkSession, path: str) -> DataFrame:
    return _read_table(spark, path, schemas.POSSESSION_CHANGES, optional=True)


def read_three_second_violations(spark: SparkSession, path: str) -> DataFrame:
    return _read_table(spark, path, schemas.THREE_SECOND_VIOLATIONS, optional=True)


def read_shot_attempts(spark: SparkSession, path: str) -> DataFrame:
    return _read_table(spark, path, schemas.SHOT_ATTEMPTS, optional=True)


def read_zone_violations(spark: SparkSession, path: str) -> DataFrame:
    return _read_table(spark, path, schemas.ZONE_VIOLATIONS, optional=True)


def read_analysis_results(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Nested result documents: one per line, or one per file with ``multi_line``."""
    return spark.read.schema(schemas.ANALYSIS_RESULTS).option("multiLine", multi_line).json(path)


def read_frame_detections_json(spark: SparkSession, path: str) -> DataFrame:
    """Per-frame rows with three JSON arrays, back to one row per detection.
    Detections are numbered balls first, then players, then hoops."""
    reader = spark.read.schema(schemas.FRAME_DETECTIONS_JSON).option("header", True).option("escape", '"')
    return explode_frame_detections(reader.csv(path))


def explode_frame_detections(frames: DataFrame) -> DataFrame:
    parts = [F.from_json(f"{c}_detections_json", schemas.DETECTION_ITEMS) for c in ("ball", "player", "hoop")]
    every = F.concat(*[F.coalesce(p, F.array().cast(schemas.DETECTION_ITEMS)) for p in parts])
    d = frames.select("match_id", "frame_number", F.col("timestamp").alias("ts_sec"), F.posexplode(every).alias("i", "d"))
    return d.select("match_id", "frame_number", "ts_sec", (F.col("i") + 1).cast("long").alias("det_no"), "d.*")


def read_calibrations(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Calibration documents with the matrix as nine row-major elements ``h``."""
    d = spark.read.schema(schemas.CALIBRATIONS).option("multiLine", multi_line).json(path)
    return d.withColumn("h", F.flatten("homography_matrix")).drop("homography_matrix")


def read_ground_truth(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    d = spark.read.schema(schemas.GROUND_TRUTH).option("multiLine", multi_line).json(path)
    return d.select("match_id", F.explode("annotations").alias("a")).select(
        "match_id",
        "a.frame_number",
        "a.timestamp",
        F.col("a.true_possession_player").alias("true_player"),
        F.col("a.true_possession_confidence").alias("true_confidence"),
        "a.notes",
    )


def read_validation_reports(
    spark: SparkSession, path: str, pattern: str = "validation_report_*.json", multi_line: bool = True
) -> DataFrame:
    """Report files anywhere below ``path``; unreadable ones are left out."""
    d = (
        spark.read.schema(schemas.VALIDATION_REPORTS)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("multiLine", multi_line)
        .json(path)
    )
    d = d.filter(F.col("_corrupt_record").isNull() & F.col("metrics").isNotNull())
    names = {"tp": "true_positives", "fp": "false_positives", "fn": "false_negatives", "tn": "true_negatives"}
    return d.select(
        "video_name",
        "segment_start",
        "segment_end",
        "metrics.total_frames",
        *[F.col(f"metrics.{long}").alias(short) for short, long in names.items()],
        "metrics.processing_time_per_frame",
        "edge_cases_found",
        "failure_modes",
        "recommendations",
    )


def read_error_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of every file below ``path``; contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return d.select("path", "length", "modificationTime")


def stream_detections(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Detections as they arrive as parquet files, a bounded number per trigger."""
    return (
        spark.readStream.schema(schemas.DETECTIONS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )
