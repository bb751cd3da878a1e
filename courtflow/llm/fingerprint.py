"""Document fingerprints: a quartile bucket digest of byte triplets.

The triplets of a sliding window over the UTF-8 bytes (neighbours and one gap) are hashed
into 128 buckets. The digest keeps, of each bucket, the quartile its count falls into (two
bits), and the length on a logarithmic scale (one byte): 33 bytes, as hex. Two digests differ
by the sum of quartile steps plus the difference of the length codes, both bounded, so the
likeness is 1 - difference / largest difference. Fingerprints depend on the text alone.

``edited_fingerprints`` also needs, of each document, the next one by id. Documents are range
partitioned and sorted by id once (the only shuffle of texts); within a partition the next row
is at hand. The last row of a partition waits for the first row of a later one: these few rows
(two a partition) are written beside the results and joined through a narrow table of the
partitions in order.

Edge cases: a null or empty text, or one under three bytes, has no triplet: all quartiles 0;
equal ids are ordered by MD5 of the text; a single document follows itself; an empty table gives
no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtflow.llm.common import cut_lineage, query, table, text_of

BUCKETS = 128
#: The largest length difference that counts, in steps of the logarithmic scale.
LENGTH_CAP = 64
STEPS_PER_OCTAVE = 8
WORST = 3 * BUCKETS + LENGTH_CAP


def fingerprint(text: str) -> str:
    """The digest as 66 hex digits: length code, then the quartiles of the buckets."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    size = min(255, round(STEPS_PER_OCTAVE * math.log2(1 + len(data))))
    counts = np.zeros(BUCKETS, np.int64)
    a, b, c = data[:-2], data[1:-1], data[2:]
    if len(a):
        counts += _buckets(a, b, c, 0x9E3779B1)
    if len(a) > 1:
        counts += _buckets(data[:-3], data[1:-2], data[3:], 0x85EBCA77)
    ordered = np.sort(counts)
    cuts = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    quartiles = (counts[:, None] > cuts).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    packed = quartiles @ np.array([64, 16, 4, 1], np.uint8)
    return bytes([size]).hex() + packed.astype(np.uint8).tobytes().hex()


def _buckets(a: np.ndarray, b: np.ndarray, c: np.ndarray, salt: int) -> np.ndarray:
    mixed = (a | (b << np.uint32(8)) | (c << np.uint32(16))) * np.uint32(salt)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0xC2B2AE3D)
    return np.bincount(mixed >> np.uint32(25), minlength=BUCKETS)


def likeness(one: str, other: str) -> float:
    """1 for equal digests, 0 for the largest difference."""
    x, y = (np.frombuffer(bytes.fromhex(d), np.uint8) for d in (one, other))
    shifts = np.array([6, 4, 2, 0], np.uint8)
    p, q = (((v[1:, None] >> shifts) & 3).astype(np.int16) for v in (x, y))
    apart = int(np.abs(p - q).sum()) + min(LENGTH_CAP, abs(int(x[0]) - int(y[0])))
    return 1 - apart / WORST


def with_fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``fingerprint``; a column of this name is replaced."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(fingerprint)

    return df.withColumn("fingerprint", F.pandas_udf(run, "string")(text_of(df, text)))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


DIGESTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: partition, role (0 done, 1 last row, waiting, 2 first row), text of roles 1 and 2
PIECES = f"{DIGESTS}, part int, role int, text string"


def _digest(doc_id, text: str, print_: str, following: str, next_print: str) -> dict:
    changed = edited(text, following)
    other = print_ if changed == text else fingerprint(changed)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": print_, "edited_fingerprint": other, "near_edited": likeness(print_, other), "near_next": likeness(print_, next_print),
    }


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """DIGESTS of every document and of its text edited by the next document."""
    spark = docs.sparkSession
    text = text_of(docs)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.md5(text).alias("key"), text.alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "doc_id", "key").sortWithinPartitions("doc_id", "key")
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("part"))
    schema = _arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out, part = None, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                part = piece.column("part")[0].as_py()
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                    mark = last[2] if last and last[1] == text else fingerprint(text)
                    if last is None:
                        out.append({"doc_id": doc_id, "fingerprint": mark, "part": part, "role": 2, "text": text})
                    else:
                        out.append(_digest(*last, text, mark) | {"part": part, "role": 0})
                    last = (doc_id, text, mark)
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if last:
            yield pa.RecordBatch.from_pylist([{"doc_id": last[0], "fingerprint": last[2], "part": part, "role": 1, "text": last[1]}], schema)

    pieces = cut_lineage(rows.mapInArrow(run, PIECES), "fingerprints")
    heads, tails = pieces.filter("role = 2"), pieces.filter("role = 1")
    order = heads.select("part").withColumn("after", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    ends = (
        tails.select("doc_id", "fingerprint", "part", "text")
        .join(order, "part")
        .join(heads.select(F.col("part").alias("after"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print")), "after")
        .select("doc_id", "text", "fingerprint", "next_text", "next_print")
    )
    wanted = _arrow_schema(DIGESTS)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_digest(*r.values()) for r in batch.to_pylist()], wanted)

    done = pieces.filter("role = 0").select(*[f.name for f in wanted])
    return done.unionByName(ends.mapInArrow(finish, DIGESTS))


def likeness_column(one: Column, other: Column) -> Column:
    """``likeness`` of two digest columns."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness(a, b) for a, b in zip(x, y)], dtype="float64")

    return F.pandas_udf(run, "double")(one, other)


@query("op5_fingerprints")
def op5(spark, sf_dir):
    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
