"""Alignment of the tokens of two tokenizers, and how well each pair of ids goes together.

Both tokenizers cut the same bytes. Where a token of each ends at the same byte, a group ends.
``align`` walks both arrays of ends along a diagonal: with i tokens of the first and i + shift of
the second behind it, it compares ever longer slices of the arrays at this shift (1, 2, 4, ...
tokens, then halves back to the first difference), so that a stretch of one-to-one tokens costs
few steps. At a difference the irregular group is resolved token by token, which changes the shift.
All pairs of tokens whose bytes overlap are linked.

The corpus-wide count of an id pair is the number of documents with a link of the two. Tasks walk
documents once and write, per chunk of documents, its distinct pairs per document as packed numbers
of a block's list of distinct pairs, and the block's list with document counts. Lists are
added up by pair and joined back by pair, so what is shuffled is a row per block and distinct pair;
then each block's chunks meet their list with counts.

Edge cases: a null or empty text, or one whose tokens' bytes are not the text with a space before
it, has no tokens, an empty ``groups_sha256`` and zeros; strings of special tokens are plain text;
repeated rows are documents of their own; kept columns of any name pass through; an empty table gives no
row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm.common import cut_lineage, query, table, text_of

#: Links of a chunk (documents held with their links) and of a block (one list of pairs), at least one document each.
CHUNK_LINKS, BLOCK_LINKS = 1_500_000, 16_000_000
#: An id of the second tokenizer takes so many bits of a pair.
SECOND_BITS = 20
_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def byte_level_pieces(path: str) -> dict[bytes, int]:
    """The pieces of a byte-level BPE file with their ids; its merges must be in order of their ids."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    # printable characters stand for their bytes, the others for those from 256 on
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in merges]
    if any(x >= y for x, y in zip(ids, ids[1:])):
        raise ValueError("ids of merged pieces do not follow the order of merges")
    merged = set(ids)
    own = {piece: i for piece, i in model["vocab"].items() if i in merged or len(piece) == 1}
    return {bytes(byte_of[c] for c in piece): i for piece, i in own.items()}


def _stretch(raw_a: bytes, raw_b: bytes, at: int, other: int) -> int:
    """How many ends are equal from these places on, by slices of doubled, then halved length."""
    good, k = 0, 4
    while (piece := raw_a[at + good : at + good + k]) and piece == raw_b[other + good : other + good + k]:
        good, k = good + len(piece), 2 * k
    while k > 4:
        k //= 2
        piece = raw_a[at + good : at + good + k]
        if piece and piece == raw_b[other + good : other + good + k]:
            good += len(piece)
    return good // 4


def align(first: np.ndarray, second: np.ndarray):
    """For two arrays of ends with the same last one: runs (i, j, n) of one-to-one tokens, irregular
    groups (i, j, i after, j after), and the linked pairs in these as two lists."""
    ends_a, ends_b = first.tolist(), second.tolist()
    raw_a, raw_b = first.astype("<u4").tobytes(), second.astype("<u4").tobytes()
    n = len(ends_a)
    runs, groups, links_a, links_b = [], [], [], []
    i = j = shift = 0
    while i < n:
        x, y = ends_a[i], ends_b[j]
        if x == y:
            n_equal = 1 + _stretch(raw_a, raw_b, 4 * (i + 1), 4 * (i + 1) + shift)
            runs.append((i, j, n_equal))
            i, j = i + n_equal, j + n_equal
            if i == n:
                break
            x, y = ends_a[i], ends_b[j]
        i0, j0 = i, j
        while x != y:
            links_a.append(i)
            links_b.append(j)
            if x < y:
                i += 1
                x = ends_a[i]
            else:
                j += 1
                y = ends_b[j]
        links_a.append(i)
        links_b.append(j)
        i, j = i + 1, j + 1
        groups.append((i0, j0, i, j))
        shift = 4 * (j - i)
    return runs, groups, links_a, links_b


def _laid_out(runs, groups, links_a, links_b, n: int, m: int):
    """Which tokens of each side end a group, and the index pairs of all links."""
    last_a, last_b = np.ones(n, bool), np.ones(m, bool)
    la, lb = np.array(links_a, np.int64), np.array(links_b, np.int64)
    if groups:
        g = np.array(groups, np.int64)
        last_a[la] = last_b[lb] = False
        last_a[g[:, 2] - 1] = last_b[g[:, 3] - 1] = True
    if runs:
        r = np.array(runs, np.int64)
        starts = np.cumsum(r[:, 2]) - r[:, 2]
        step = np.arange(int(r[:, 2].sum())) - np.repeat(starts, r[:, 2])
        la = np.concatenate([la, np.repeat(r[:, 0], r[:, 2]) + step])
        lb = np.concatenate([lb, np.repeat(r[:, 1], r[:, 2]) + step])
    return last_a, last_b, la, lb


class _Decimals:
    """Ids as decimal text with a separator each, many at a time."""

    def __init__(self, size: int):
        text = [str(i) for i in range(size)]
        self.width = len(text[-1]) + 1
        self.chars = np.frombuffer("".join(t.ljust(self.width) for t in text).encode(), np.uint8).reshape(size, self.width)
        self.lengths = np.array([len(t) for t in text], np.int64)

    def groups(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """"a1,a2|b1;" for each group, in a row, and the end of each group."""
        ends_a, ends_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        at_a = np.arange(len(a)) + np.append(0, ends_b)[group_a]
        at_b = np.arange(len(b)) + ends_a[group_b]
        ids, marks = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        ids[at_a], ids[at_b] = a, b
        marks[at_a], marks[at_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        n = self.lengths[ids]
        chars = self.chars[ids]
        chars[np.arange(len(ids)), n] = marks
        kept = np.arange(self.width)[None, :] <= n[:, None]
        return chars[kept].tobytes(), np.cumsum(n + 1)[ends_a + ends_b - 1]


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in 7-bit bytes, the last byte of each below 128."""
    numbers = numbers.astype(np.int64)
    n = np.ones(len(numbers), np.int64)
    for k in range(1, 9):
        n += numbers >= 1 << (7 * k)
    ends = np.cumsum(n)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(n.max()) if len(n) else 0):
        has = n > k
        out[ends[has] - n[has] + k] = ((numbers[has] >> (7 * k)) & 127) | np.where(n[has] - 1 > k, 128, 0)
    return out.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    parts = np.frombuffer(raw, np.uint8)
    if not len(parts):
        return np.zeros(0, np.int64)
    starts = np.append(0, np.flatnonzero(parts < 128)[:-1] + 1)
    place = np.arange(len(parts)) - np.repeat(starts, np.diff(np.append(starts, len(parts))))
    return np.add.reduceat((parts & 127).astype(np.int64) << (7 * place), starts)


def _tokenizers(shipped):
    """Both encoders, and the bytes of each id."""
    import sentencepiece
    import tiktoken

    pieces, pattern, proto = shipped
    first = tiktoken.Encoding("first", pat_str=pattern, mergeable_ranks=pieces, special_tokens={})
    second = sentencepiece.SentencePieceProcessor(model_proto=proto)
    bytes_a = [b""] * (max(pieces.values()) + 1)
    for piece, i in pieces.items():
        bytes_a[i] = piece
    bytes_b = []
    for i in range(second.get_piece_size()):
        piece = second.id_to_piece(i)
        bytes_b.append(bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode())
    return first, second, bytes_a, bytes_b


def _aligned(batches: Iterator[pa.RecordBatch], shipped) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first, second, bytes_a, bytes_b = _tokenizers(shipped)
    sizes_a, sizes_b = (np.array([len(x) for x in y], np.int64) for y in (bytes_a, bytes_b))
    decimals = _Decimals(max(len(bytes_a), len(bytes_b)))
    block, blocks = TaskContext.get().partitionId() << 32, 0
    chunk: list[tuple] = []  # of documents: a, b, last_a, last_b, la, lb; None without tokens
    kept: list[pa.Array] = []
    lists: list[np.ndarray] = []  # of chunks: their distinct pairs
    seen: list[np.ndarray] = []  # of chunks: documents of each
    links = block_links = 0
    kind = None

    def document(text: str):
        if not text:
            return None
        a, b = first.encode_ordinary(" " + text), second.encode(text)
        raw = (" " + text).encode()
        if b"".join(map(bytes_a.__getitem__, a)) != raw or b"".join(map(bytes_b.__getitem__, b)) != raw:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return a, b, *_laid_out(*align(np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])), len(a), len(b))

    def finished() -> pa.RecordBatch:
        """A row of the chunk."""
        real = [d for d in chunk if d is not None]
        n_a, n_b, n_groups, n_links = ([len(d[0]) if d else 0 for d in chunk], [len(d[1]) if d else 0 for d in chunk], [int(d[2].sum()) if d else 0 for d in chunk], [len(d[4]) if d else 0 for d in chunk])
        shas = []
        codes, of_doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if real:
            text, ends = decimals.groups(*(np.concatenate([d[k] for d in real]) for k in range(4)))
            cuts = np.append(0, ends[np.cumsum([n for n in n_groups if n]) - 1]).tolist()
            shas = [hashlib.sha256(text[x : y - 1]).hexdigest() for x, y in zip(cuts[:-1], cuts[1:])]
            codes = np.concatenate([(d[0][d[4]] << SECOND_BITS) | d[1][d[5]] for d in real])
            of_doc = np.repeat(np.arange(len(chunk)), n_links)
        at, distinct = pd.factorize(codes)
        keys = np.sort(of_doc * max(1, len(distinct)) + at)
        new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
        places = np.flatnonzero(new)
        times = np.diff(np.append(places, len(keys)))
        doc, pair = np.divmod(keys[places], max(1, len(distinct)))
        per_doc = np.bincount(doc, minlength=len(chunk))
        step = pair - np.where(np.append(True, doc[1:] != doc[:-1]), 0, np.append(0, pair[:-1])) if len(pair) else pair
        lists.append(distinct)
        seen.append(np.bincount(pair, minlength=len(distinct)))
        shas_of = iter(shas)
        docs = pa.StructArray.from_arrays(
            [pa.concat_arrays(kept), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_groups, pa.int64()), pa.array(n_links, pa.int64()), pa.array([next(shas_of) if n else "" for n in n_groups])],
            ["kept", *_NUMBERS, "groups_sha256"],
        )
        return row(chunk=len(lists) - 1, docs=docs, per_doc=_packed(per_doc), pairs=_packed(step), times=_packed(times - 1))

    def row(chunk=None, docs=None, per_doc=None, pairs=None, times=None, codes=None, counts=None, maps=None) -> pa.RecordBatch:
        fields = pa.struct([("kept", kind), *((n, pa.int64()) for n in _NUMBERS), ("groups_sha256", pa.string())])
        of_docs = pa.nulls(1, pa.list_(fields)) if docs is None else pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
        columns = {
            "block": pa.array([block + blocks], pa.int64()), "chunk": pa.array([chunk], pa.int32()), "docs": of_docs, "per_doc": pa.array([per_doc], pa.binary()), "pairs": pa.array([pairs], pa.binary()),
            "times": pa.array([times], pa.binary()), "maps": pa.array([maps], pa.list_(pa.binary())), "codes": pa.array([codes], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int64())),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def listed() -> pa.RecordBatch:
        """The block's list: its distinct pairs with their documents, and each chunk's places in it."""
        at, distinct = pd.factorize(np.concatenate(lists))
        counts = np.bincount(at, weights=np.concatenate(seen), minlength=len(distinct)).astype(np.int64)
        cuts = np.cumsum([0, *map(len, lists)])
        return row(codes=distinct, counts=counts, maps=[at[x:y].astype("<i4").tobytes() for x, y in zip(cuts[:-1], cuts[1:])])

    for batch in batches:
        done, kind = 0, batch.column("kept").type
        for k, text in enumerate(batch.column("text").to_pylist()):
            chunk.append(document(text))
            links += len(chunk[-1][4]) if chunk[-1] else 0
            if links >= CHUNK_LINKS:
                kept.append(batch.column("kept").slice(done, k + 1 - done))
                yield finished()
                block_links, done, links, chunk, kept = block_links + links, k + 1, 0, [], []
                if block_links >= BLOCK_LINKS:
                    yield listed()
                    blocks, block_links, lists, seen = blocks + 1, 0, [], []
        if done < batch.num_rows:
            kept.append(batch.column("kept").slice(done))
    if kept:
        yield finished()
    if lists:
        yield listed()


def _summed(chunks: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's chunks and its list with counts to a row per document."""
    at = pairs.column("at").to_numpy()
    best, count = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    best[at], count[at] = pairs.column("best").to_numpy(), pairs.column("n").to_numpy()
    made = []
    for batch in chunks.to_batches():
        for k in range(batch.num_rows):
            docs = batch.column("docs").slice(k, 1).flatten()
            per_doc, step, times = (_unpacked(batch.column(c)[k].as_py()) for c in ("per_doc", "pairs", "times"))
            starts = np.cumsum(per_doc) - per_doc
            total = np.append(0, np.cumsum(step))
            local = total[1:] - np.repeat(total[starts], per_doc)
            pair = np.frombuffer(batch.column("map")[k].as_py(), "<i4")[local]
            sums = [np.append(0, np.cumsum((times + 1) * of[pair])) for of in (best, count)]
            of_docs = [pa.array(s[starts + per_doc] - s[starts], pa.int64()) for s in sums]
            fields = docs.flatten()
            made.append(pa.RecordBatch.from_arrays([*fields, *of_docs], ["kept", *_NUMBERS, "groups_sha256", "n_best", "count_sum"]))
    return pa.Table.from_batches(made)


def align_documents(docs: DataFrame, first: str, pattern: str, second: str, keep: list[str]) -> DataFrame:
    """``keep``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per document.

    ``first`` is a byte-level BPE file (with its splitting pattern), ``second`` a piece model that
    puts a space before the text.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((byte_level_pieces(first), pattern, Path(second).read_bytes()))
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), text_of(docs).alias("text"))
    ddl = rows.schema["kept"].dataType.simpleString()
    docs_ddl = f"array<struct<kept:{ddl},n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>>"
    made = rows.mapInArrow(
        lambda batches: _aligned(batches, shipped.value),
        f"block long, chunk int, docs {docs_ddl}, per_doc binary, pairs binary, times binary, maps array<binary>, codes array<long>, counts array<long>",
    )
    walked = cut_lineage(made, "aligned")

    of_block = walked.filter("codes IS NOT NULL").select("block", F.posexplode(F.arrays_zip("codes", "counts")).alias("at", "pair"))
    of_block = of_block.select("block", "at", F.col("pair.codes").alias("pair"), F.col("pair.counts").alias("n"))
    counts = of_block.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", SECOND_BITS))
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))
    scored = counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("best"))
    back = of_block.select("block", "at", "pair").join(scored, "pair").select("block", "at", "n", "best")
    maps = walked.filter("maps IS NOT NULL").select("block", F.posexplode("maps").alias("chunk", "map"))
    chunks = walked.filter("docs IS NOT NULL").select("block", "chunk", "docs", "per_doc", "pairs", "times").join(maps, ["block", "chunk"])
    chunks = chunks.select(F.col("block").alias("of_block"), "docs", "per_doc", "pairs", "times", "map")
    out = chunks.groupBy("of_block").cogroup(back.groupBy("block")).applyInArrow(
        _summed, f"kept {ddl}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    )
    return out.select("kept.*", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op13_token_align")
def op13(spark, sf_dir):
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"), ["doc_id"])
