"""WARC archives: a writer with one gzip member per record, and a splittable reader.

Writing: every task writes its own files and returns their names; the returned rows become a
manifest table. Spark commits one attempt of each task, so after a lost executor the files of
other attempts are in no manifest and are never read.

Reading: a task gets a byte range of a file. It looks for the gzip magic, and takes a place as
a record only if inflating it gives a WARC header that parses; anything else goes on with the
next byte. It owns the records that start inside its range and reads past the end of the range
to finish the last one. So the number of tasks follows the bytes, not the files, and a task
holds one record at a time.

Revisits: of records with equal payloads of at least ``min_bytes``, that with the smallest id
is the response, the others carry the HTTP header and a reference to it. Digests are grouped
with a combine before the shuffle; the join back is by digest, and Spark splits hot digests.

Edge cases: a null payload is an empty one; a null URL leaves the target header out; control
characters and blanks in it are percent-encoded; rows that repeat an id are records of their
own, and rows without id are responses that no other record refers to; an empty table gives
no file and no row.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtflow.llm.common import cut_lineage, query, scratch_path, table

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:record:"
BLOCK = 1 << 20

RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a Hadoop-style path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def encode_record(record_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member holding one record."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{'' if record_id is None else record_id}>"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(raw) + packer.flush()


def with_revisits(df: DataFrame, record_id: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """record_id, target_uri, payload (binary), digest (hex), refers_to."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = df.select(
        F.col(record_id).cast("string").alias("record_id"),
        F.col(record_id).alias("__order"),
        F.col("url").cast("string").alias("target_uri"),
        body.alias("payload"),
        F.sha1(body).alias("__digest"),
    )
    small = rows.filter(F.length("payload") >= min_bytes)
    firsts = small.groupBy("__digest").agg(F.min("__order").alias("__first"), F.count(F.lit(1)).alias("__n"))
    firsts = firsts.filter(F.col("__n") > 1).drop("__n")
    joined = rows.join(firsts, "__digest", "left")
    again = F.col("__order").isNotNull() & (F.col("__order") != F.col("__first")) & (F.length("payload") >= min_bytes)
    return joined.select("record_id", "target_uri", "payload", F.when(again, F.col("__first").cast("string")).alias("refers_to"))


def write_warc(records: DataFrame, folder: str, roll_bytes: int = 1 << 30) -> DataFrame:
    """Write (record_id, target_uri, payload, refers_to) rows; the manifest (path, length, records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(folder)
        system.create_dir(root, recursive=True)
        out, name, size, count = None, "", 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "length": [size], "records": [count]})

        for batch in batches:
            columns = [batch.column(c) for c in ("record_id", "target_uri", "payload", "refers_to")]
            for i in range(batch.num_rows):
                record, url, payload, refers = (c[i].as_py() for c in columns)
                if out is None:
                    name, size, count = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                member = encode_record(record, url, payload, sha1_base32(payload), refers)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= roll_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    made = records.select("record_id", "target_uri", "payload", "refers_to").mapInArrow(write, "path string, length long, records long")
    return cut_lineage(made, "warc-manifest")


def _headers(raw: bytes) -> dict[str, str] | None:
    lines = raw.split(b"\r\n")
    if not lines[0].startswith(b"WARC/1."):
        return None
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out if "warc-type" in out and "content-length" in out else None


class Window:
    """Bytes of a file from a moving place on, read block by block."""

    def __init__(self, file, start: int):
        self.file, self.base, self.data = file, start, b""
        file.seek(start)

    def more(self) -> bool:
        part = self.file.read(BLOCK)
        self.data += part
        return bool(part)

    def passed(self, place: int) -> None:
        if place - self.base >= 4 * BLOCK:
            self.data, self.base = self.data[place - self.base :], place


def _inflate(window: Window, place: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end of the record at ``place``, or None if there is none."""
    unpack, raw, head, at = zlib.decompressobj(31), io.BytesIO(), None, place - window.base
    while True:
        if at >= len(window.data) and not window.more():
            return None
        part = window.data[at : at + (BLOCK if head else 4096)]
        at += len(part)  # the window may end within the step
        try:
            raw.write(unpack.decompress(part))
        except zlib.error:
            return None
        if head is None:
            seen = raw.getvalue()
            cut = seen.find(b"\r\n\r\n")
            if cut >= 0:
                head = _headers(seen[:cut])
                if head is None:
                    return None
            elif not seen.startswith(b"WARC/1."[: len(seen)]):  # headers are of any length, as URLs are
                return None
        if unpack.eof:
            if head is None:
                return None
            end = window.base + at - len(unpack.unused_data)
            seen = raw.getvalue()
            cut = seen.find(b"\r\n\r\n") + 4
            return head, seen[cut : cut + int(head["content-length"])], end


def scan_range(file, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records that start in [start, end)."""
    window, place = Window(file, start), start
    while place < end:
        found = window.data.find(MAGIC, place - window.base)
        if found < 0:
            keep = max(place, window.base + len(window.data) - len(MAGIC) + 1)
            if keep >= end or not window.more():
                return
            place = keep
            window.passed(place)
            continue
        place = window.base + found
        if place >= end:
            return
        record = _inflate(window, place)
        if record is None:
            place += 1
            continue
        yield record[0], record[1]
        place = record[2]
        window.passed(place)


def _row(head: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = head["warc-type"]
    name = lambda key: head[key].strip("<>").removeprefix(URN) if key in head else None
    size, digest = len(payload), sha1_base32(payload)
    if kind == "revisit":  # the payload is in the record that it refers to
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        sizes = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size, payload = int(sizes[0]) if sizes else None, None
    return {
        "record_id": name("warc-record-id") or None, "record_type": kind, "target_uri": head.get("warc-target-uri"), "refers_to": name("warc-refers-to"),
        "payload_digest": digest, "payload_bytes": size, "payload": payload,
    }


def read_warc(spark: SparkSession, files: DataFrame | str, split_bytes: int = 32 << 20) -> DataFrame:
    """Rows of RECORD from a folder, or from a table of (path, length)."""
    if isinstance(files, str):
        files = spark.read.format("binaryFile").load(files).select("path", "length")
    total = files.agg(F.sum("length")).first()[0] or 0
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    ranges = files.select("path", starts.alias("start")).repartition(max(1, -(-total // split_bytes)), "path", "start")
    schema = pa.schema([(n, pa.binary() if k == "binary" else pa.int64() if k == "long" else pa.string()) for n, k in (x.split() for x in RECORD.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                system, path = _opened(part["path"])
                rows, held = [], 0
                with system.open_input_file(path) as file:
                    for head, block in scan_range(file, part["start"], part["start"] + split_bytes):
                        rows.append(_row(head, block))
                        held += len(block)
                        if held > 8 * BLOCK or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.mapInArrow(read, RECORD)


SQL = """WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, MIN(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
 1 + CAST(((CAST('0x' || substr(h, 1 + 5 * CAST(j // 4 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (j % 4) AS BIGINT)) & 31) AS INTEGER), 1)), '') AS payload_digest,
 CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


@query("op1_warc", SQL)
def op1(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = write_warc(with_revisits(pages, "page_id", "html"), scratch_path(spark, "warc"))
    records = read_warc(spark, manifest)
    return records.select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )
