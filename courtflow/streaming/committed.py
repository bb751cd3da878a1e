"""A result table that micro-batches are committed to, each once.

A batch is written to a folder of its own, in frame order, and counts from the moment its commit
row stands beside it. A batch that is handed over again (the stream died between the write and its
checkpoint) is left alone if it was committed; if not, what its first try left is overwritten. So a
replay changes nothing, and a reader sees whole batches only.

Batches are named by the stream's checkpoint as well as their number: a stream started anew, with a
new checkpoint, adds to the table and does not run into the numbers of the former one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtflow.streaming.live import for_each_batch

FRAME_ORDER = ("match_id", "frame_number")
_COMMIT = "rows long"
_NAMES = "stream string, batch long"


def _ready(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return folder


def commits(spark: SparkSession, path: str) -> DataFrame:
    """stream, batch, rows: one row per committed batch."""
    schema = T.StructType.fromDDL(f"{_COMMIT}, {_NAMES}")
    return spark.read.schema(schema).parquet(_ready(spark, f"{path}/commits"))


def write_batch(
    rows: DataFrame,
    batch_id: int,
    path: str,
    stream: str,
    order: Sequence[str] = FRAME_ORDER,
    handlers: Sequence[Callable[[DataFrame, int], None]] = (),
) -> bool:
    """Commit a batch; False if it had been committed before.

    ``handlers`` (callbacks) get the rows as written, in frame order, after the write and before the
    commit: a handler is called once, or again if the driver was lost in between.
    """
    spark = rows.sparkSession
    done = commits(spark, path).filter((F.col("stream") == stream) & (F.col("batch") == batch_id))
    if not done.isEmpty():
        return False
    own = f"stream={stream}/batch={batch_id}"
    keys = [F.col(c).asc_nulls_last() for c in order]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/rows/{own}")
    written = spark.read.schema(rows.schema).parquet(f"{path}/rows/{own}")
    for handler in handlers:
        handler(written.orderBy(*keys), batch_id)
    written.agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/commits/{own}")
    return True


def commit_to(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    order: Sequence[str] = FRAME_ORDER,
    handlers: Sequence[Callable[[DataFrame, int], None]] = (),
    trigger: dict | None = None,
):
    """Start committing the stream's micro-batches to the table at ``path``."""
    name = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()

    def handle(rows: DataFrame, batch_id: int) -> None:
        write_batch(rows, batch_id, path, name, order, handlers)

    return for_each_batch(stream, handle, checkpoint, trigger)


def committed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all committed batches, with ``stream`` and ``batch``."""
    full = T.StructType([*schema.fields, *T.StructType.fromDDL(_NAMES).fields])
    rows = spark.read.schema(full).parquet(_ready(spark, f"{path}/rows"))
    return rows.join(commits(spark, path).select("stream", "batch"), ["stream", "batch"], "left_semi").select(*full.names)


def in_frame_order(results: DataFrame, order: Sequence[str] = FRAME_ORDER) -> DataFrame:
    """Results of parallel tasks sorted by frame (a range sort); rows without match or frame come last."""
    return results.orderBy(*[F.col(c).asc_nulls_last() for c in order])
