"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary.

Merging is done by Spark higher-order functions. A word (a match of the splitting pattern) is an
array of its bytes' ids, beside the ranks of its neighbouring pairs; a fold merges the pair of
lowest rank, leftmost first, and looks up only the two pairs that change. The rank map is a
literal: an array with two possible places for each pair, since a lookup in a Spark map walks
its keys. Decoding looks every id up in a literal array of pieces and
concatenates the binary.

Only distinct words are folded, each once for the whole table. The most frequent words of a
bounded sample (``sample_rows`` documents, ``frequent`` words: fixed numbers) are folded first and
shipped to the tasks; the sample only decides what is shipped, never a result. Documents go by
blocks: a run of documents of one task up to ``block_words`` distinct other words or ``BLOCK_REFS``
tokens, so memory is bounded. A document becomes the compressed numbers of its words within the
block. The other words of all blocks are shuffled by word, the first row of each word is folded, and
the ids go back to the blocks. A word stands at most once in a block, so no word is a hot key. Blocks
are numbered by task, so the table has to be one whose partitions come out alike when read again,
like files.

Words beyond ``FOLD_BYTES`` bytes take the fold too long (its work grows with the square of the
length), so those few are merged with a heap, with the same result.

Edge cases: null and empty texts have no ids; white space runs and any Unicode are split by the
pattern alone; special tokens are ordinary text; repeated rows are rows of their own; an empty
table gives no row.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtflow.llm.common import query, table, text_of

FOLD_BYTES = 48
#: Larger than any id; ids and ranks packed into one number take these bits.
PAIR_BITS, RANK_BITS = 20, 17
PAIR, RANKS = 1 << PAIR_BITS, 1 << RANK_BITS
#: The text of plans that Spark keeps for display: its default, and as short as it is kept here.
PLAN_DEFAULT, PLAN_TEXT = "2147483632b", "100000"
#: The rank of pairs that do not merge; longer than any word to be folded, with its ends.
NO_MERGE, WIDE = RANKS, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 piece and rank per line."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in file if line.strip())}


def merge_splits(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The pair of ids that each longer piece is merged from, with its rank (its id).

    Within a piece merges go as they go in the piece alone, so the pair is what the piece
    comes to with the merges before its own.
    """
    out = {}
    for piece, rank in ranks.items():
        if len(piece) > 1:
            parts = merge_long(piece, ranks, below=rank)
            if len(parts) == 2:
                out[parts[0], parts[1]] = rank
    return out


def rank_map(ranks: dict[bytes, int]) -> tuple[Column, int, int]:
    """The literal rank map and the sizes of its halves.

    A key, left * PAIR + right, is in one of two places: key modulo the first size, or in the
    second half key modulo the second. An entry is key * RANKS + rank; 0 is a free place.
    """
    splits = merge_splits(ranks)
    first = 2 * len(splits) + 1
    second = first + 2
    places = [0] * (first + second)
    for (left, right), rank in splits.items():
        entry, at = (left * PAIR + right) * RANKS + rank, -1
        for _ in range(1000):
            key = entry // RANKS
            one, other = key % first, first + key % second
            at = other if at == one else one
            entry, places[at] = places[at], entry
            if not entry:
                break
        else:
            raise ValueError("the rank map has no place for a pair")
    return F.from_json(F.lit(str(places)), "array<bigint>"), first, second


def _rank(known: tuple[Column, int, int], left: Column, right: Column) -> Column:
    """The rank of a pair of ids, NO_MERGE where it does not merge."""
    places, first, second = known

    def found(entry: Column, key: Column, other: Column) -> Column:
        return F.when(F.shiftright(entry, RANK_BITS) == key, entry.bitwiseAND(RANKS - 1)).otherwise(other)

    def look(key: Column) -> Column:
        at_second = _let(F.get(places, (first + key % second).cast("int")), lambda e: found(e, key, F.lit(NO_MERGE)))
        return _let(F.get(places, (key % first).cast("int")), lambda e: found(e, key, at_second))

    return _let(left * PAIR + right, look)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: an expression written twice is evaluated twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def encode_words(words: Column, known: tuple[Column, int, int]) -> Column:
    """Ids of each word of an array of words, each an array of the ids of its bytes.

    The state of the fold is one array: each id so far, with the rank of its pair with the next
    id before it, rank * PAIR + id, between two ends that merge with nothing. The least entry at
    its first place is the leftmost pair of lowest rank, and its rank is the id of the merged
    piece; only the entries of this piece and of the one before it change. The literal map is bound
    once, so that it stands in the plan once.
    """
    places, *sizes = known
    return _let(places, lambda bound: _encode_words(words, (bound, *sizes)))


def _encode_words(words: Column, known: tuple[Column, int, int]) -> Column:
    end = F.lit(PAIR - 1).cast("long")
    edge = F.array(F.lit(NO_MERGE * PAIR + PAIR - 1).cast("long"))

    def entry(left: Column, right: Column) -> Column:
        return _rank(known, left, right) * PAIR + left

    def plain(x: Column) -> Column:
        return x.bitwiseAND(PAIR - 1)

    def step(acc: Column, _: Column) -> Column:
        return _let(F.array_min(acc), lambda least: F.when(least >= NO_MERGE * PAIR, acc).otherwise(join(acc, least)))

    def join(acc: Column, least: Column) -> Column:
        new = F.shiftright(least, PAIR_BITS)

        def at_place(at: Column) -> Column:
            changed = F.array(entry(plain(F.get(acc, at - 2)), new), entry(new, plain(F.get(acc, at + 1))))
            return F.concat(F.slice(acc, 1, at - 2), changed, F.slice(acc, at + 2, F.lit(WIDE)))

        return _let(F.array_position(acc, least).cast("int"), at_place)

    def merged(word: Column) -> Column:
        entries = F.transform(word, lambda x, i: entry(x, F.coalesce(F.get(word, i + 1), end)))
        finish = lambda acc: F.transform(F.slice(acc, 2, F.size(acc) - 2), plain)
        return F.aggregate(F.sequence(F.lit(2), F.size(word)), F.concat(edge, entries, edge), step, finish)

    return F.transform(words, lambda w: F.when(F.size(w) > 1, merged(w)).otherwise(w))


def merge_long(word: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[int]:
    """The same merges with a heap, for long words; with ``below`` only those of lower rank."""
    n = len(word)
    ends = list(range(1, n + 1))  # ends[i]: where the piece that starts at i ends; 0 once merged away
    before = list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = ends[i]
        if j < n:
            rank = ranks.get(word[i : ends[j]])
            if rank is not None and (below is None or rank < below):
                heapq.heappush(heap, (rank, i, ends[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = ends[i]
        if j == 0 or j >= n or ends[j] != end:
            continue  # one of the two has changed since
        ends[i], ends[j] = end, 0
        if end < n:
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


def frequent_words(docs: DataFrame, pattern: str, sample_rows: int, frequent: int) -> list[str]:
    """The commonest words of the sample (by hash of the text)."""
    text = text_of(docs)
    rows = docs.select(text.alias("text"), F.xxhash64(text, F.lit(3)).alias("key"))
    n = max(1, docs.count())
    share = F.pmod("key", F.lit(1 << 20)) < F.lit(max(1, min(1 << 20, (sample_rows << 20) // n)))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = regex.compile(pattern), Counter()
        for batch in batches:
            for t in batch.column("text").to_pylist():
                counts.update(split.findall(t))
        top = counts.most_common(2 * frequent)
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in top], pa.string()), "n": pa.array([c for _, c in top], pa.int64())})

    counted = rows.filter(share).select("text").mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.filter(F.col("n") > 1).orderBy(F.desc("n"), "word").limit(frequent)
    return top.select("word").toArrow().column("word").to_pylist()


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    keep: list[str],
    sample_rows: int = 20_000,
    frequent: int = 150_000,
    block_words: int = 300_000,
) -> DataFrame:
    """``keep`` (columns without the text), ids, an array of ints, and raw, the same ids as
    little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.maxPlanStringLength") == PLAN_DEFAULT:  # the rank map's text is a megabyte in each
        spark.conf.set("spark.sql.maxPlanStringLength", PLAN_TEXT)
    known = rank_map(ranks)
    common = [w for w in frequent_words(docs, pattern, sample_rows, frequent) if len(w.encode()) <= FOLD_BYTES]
    common_at = {w: -1 - i for i, w in enumerate(common)}
    size = 500
    byte_ids = [ranks[bytes([b])] for b in range(256)]
    words = pa.array([[byte_ids[b] for b in w.encode()] for w in common], pa.list_(pa.int64()))
    starts = list(range(0, len(common), size))
    rows = pa.table(
        {"at": pa.array(starts, pa.int32()), "words": pa.ListArray.from_arrays(pa.array([*starts, len(common)], pa.int32()), words)}
    )
    folded = spark.createDataFrame(rows, "at int, words array<array<bigint>>").repartition(8).select("at", encode_words(F.col("words"), known).alias("ids"))
    common_ids = folded.toArrow().sort_by("at").column("ids").combine_chunks().flatten()
    to_blocks = spark.sparkContext.broadcast((common_at, ranks))
    to_assemble = spark.sparkContext.broadcast(_lists(common_ids))

    kept = docs.select(F.struct(*keep).alias("kept"), text_of(docs).alias("text"))
    kept_ddl = kept.schema["kept"].dataType.simpleString()
    # a row is a document with references to words, or the words of the block that ends here
    rows = kept.mapInArrow(
        lambda batches: _blocks(batches, to_blocks.value, pattern, block_words),
        f"block bigint, kept {kept_ddl}, refs binary, words array<binary>, others array<array<int>>",
    ).repartition("block")
    # all columns are named and nothing is filtered below, so that this reads the exchange of the documents
    all_null = F.col("kept").isNull() & F.col("refs").isNull() & F.col("others").isNull()
    words = F.coalesce("words", F.when(all_null, F.col("words")))
    asked = rows.select("block", F.posexplode_outer(words).alias("at", "word")).filter(F.col("at").isNotNull())
    # a task sends a block one row, or few: its words' ids packed
    folded = fold_once(asked, known, byte_ids).sortWithinPartitions("block", "at").mapInArrow(_pack_blocks, "block bigint, packed binary")

    def ids_of(left: pa.Table, right: pa.Table) -> pa.Table:
        return _assemble(left, right, to_assemble.value)

    out = rows.groupBy("block").cogroup(folded.groupBy("block")).applyInArrow(ids_of, f"kept {kept_ddl}, ids array<int>, raw binary")
    return out.select("kept.*", "ids", "raw")


def fold_once(asked: DataFrame, known: tuple[Column, int, int], byte_ids: list[int]) -> DataFrame:
    """block, at, ids of ``asked`` (block, at, word): the first row of each word is folded, the others
    take over its ids."""
    of_byte = F.from_json(F.lit(str(byte_ids)), "array<bigint>")
    in_bytes = F.transform(F.split(F.decode("word", "ISO-8859-1"), ""), lambda c: F.get(of_byte, F.ascii(c)))
    same = Window.partitionBy("word").orderBy("block")
    first = asked.withColumn("place", F.row_number().over(same))
    first = first.withColumn("ids", F.when(F.col("place") == 1, F.get(encode_words(F.array(in_bytes), known), F.lit(0)).cast("array<int>")))
    return first.select("block", "at", F.first("ids", ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, 0)).alias("ids"))


#: References of one block at most, but for one document's.
BLOCK_REFS = 4_000_000
#: Documents that a task holds as Python lists or index arrays at a time.
PIECE_ROWS = 250


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers with all their first bytes first, which packs better."""
    return np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, at, ids), sorted by block, as one packed row per block: the number of words, their
    places (as steps), the lengths of their ids, and the ids."""
    pack = zstandard.ZstdCompressor(level=1).compress
    block, held = None, []

    def flush() -> pa.RecordBatch:
        at, lengths, ids = (np.concatenate(x) for x in zip(*held))
        packed = pack(_planes(np.concatenate([[len(at)], np.diff(at, prepend=0), lengths, ids])))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([packed], pa.binary())], ["block", "packed"])

    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and blocks[a] != block:
                yield flush()
                held = []
            block = int(blocks[a])
            part = batch.slice(a, b - a)
            ids, lengths = _lists(part.column("ids"))
            held.append((part.column("at").to_numpy(), lengths, ids))
    if held:
        yield flush()


def _unpack_block(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths of ids, ids."""
    numbers = _from_planes(zstandard.ZstdDecompressor().decompress(packed))
    n = int(numbers[0])
    return np.cumsum(numbers[1 : n + 1]), numbers[n + 1 : 2 * n + 1], numbers[2 * n + 1 :]


def _blocks(batches, shipped, pattern: str, block_words: int) -> Iterator[pa.RecordBatch]:
    common_at, ranks = shipped
    find = regex.compile(pattern).findall
    pack = zstandard.ZstdCompressor(level=1).compress
    number = TaskContext.get().partitionId() << 32
    own: dict[str, int] = {}
    words: list[bytes] = []
    others: list[list[int]] = []
    pending, kind = 0, None
    names = ["block", "kept", "refs", "words", "others"]
    lists, binaries = pa.list_(pa.list_(pa.int32())), pa.list_(pa.binary())

    def reference(word: str) -> int:
        """2 i for the i-th word to be folded, 2 i + 1 for the i-th long one."""
        raw = word.encode("utf-8", "surrogatepass")
        if len(raw) <= FOLD_BYTES:
            words.append(raw)
            own[word] = ref = 2 * len(words) - 2
        else:
            others.append(merge_long(raw, ranks))
            own[word] = ref = 2 * len(others) - 1
        return ref

    def documents(kept, refs):
        n = len(refs)
        columns = [pa.array([number] * n, pa.int64()), kept, pa.array(refs, pa.binary()), pa.nulls(n, binaries), pa.nulls(n, lists)]
        return pa.RecordBatch.from_arrays(columns, names)

    def block():
        columns = [pa.array([number], pa.int64()), pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([words], binaries), pa.array([others], lists)]
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in (b.slice(at, PIECE_ROWS) for b in batches for at in range(0, b.num_rows, PIECE_ROWS)):
        kept, kind = batch.column("kept"), batch.column("kept").type
        done, refs = 0, []
        for text in batch.column("text").to_pylist():
            line = []
            for w in find(text):
                ref = common_at.get(w)
                if ref is None:
                    ref = own.get(w)
                    if ref is None:
                        ref = reference(w)
                line.append(ref)
            refs.append(pack(_planes(np.array(line, np.int32))))
            pending += len(line)
            if len(words) + len(others) >= block_words or pending >= BLOCK_REFS:
                yield documents(kept.slice(done, len(refs)), refs)
                yield block()
                done, refs, pending = done + len(refs), [], 0
                own, words, others = {}, [], []
                number += 1
        if refs:
            yield documents(kept.slice(done, len(refs)), refs)
    if kind is not None:
        yield block()


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list array."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.diff(column.offsets.to_numpy())


def _assemble(rows: pa.Table, folded: pa.Table, shipped) -> pa.Table:
    """The ids of a block's documents: ``rows`` as of ``_blocks``, ``folded`` with the packed ids of its words."""
    flat, lengths = shipped
    n_common = len(lengths)
    ends_block = rows.column("refs").is_null()
    docs, last = rows.filter(pa.compute.invert(ends_block)), rows.filter(ends_block)
    none = (np.empty(0, np.int32),) * 3
    places, own_lengths, own_ids = (np.concatenate(x) for x in zip(none, *map(_unpack_block, folded.column("packed").to_pylist())))
    parts = [(own_ids, own_lengths), _lists(last.column("others").combine_chunks().flatten())]
    order = np.empty(len(places), np.int64)
    order[places] = np.arange(len(places))
    values = np.concatenate([flat, *[p[0] for p in parts]])
    sizes = np.concatenate([lengths, *[p[1] for p in parts]])
    starts = np.cumsum(sizes) - sizes
    unpack, made = zstandard.ZstdDecompressor().decompress, []
    for at in range(0, docs.num_rows, PIECE_ROWS):
        piece = docs.slice(at, PIECE_ROWS)
        lines = [_from_planes(unpack(r)) for r in piece.column("refs").to_pylist()]
        refs, counts = np.concatenate(lines).astype(np.int64), np.array([len(x) for x in lines], np.int64)
        at_word = np.where(refs < 0, -1 - refs, n_common + len(order) + refs // 2)
        mine = (refs >= 0) & (refs % 2 == 0)
        at_word[mine] = n_common + order[refs[mine] // 2]
        n = sizes[at_word]
        ends = np.cumsum(n)
        ids = values[np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n - starts[at_word], n)]
        edges = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(counts)]]).astype(np.int32)
        buffer, cuts = ids.astype("<u4").tobytes(), (4 * edges.astype(np.int64)).tolist()
        raw = pa.array([buffer[a:b] for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
        listed = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
        made.append(pa.Table.from_arrays([piece.column("kept"), listed, raw], ["kept", "ids", "raw"]))
    if not made:
        kind = rows.schema.field("kept").type
        return pa.schema([("kept", kind), ("ids", pa.list_(pa.int32())), ("raw", pa.binary())]).empty_table()
    return pa.concat_tables(made)


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids."""
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex().upper()
    table_of_pieces = F.split(F.lit(",".join(pieces)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table_of_pieces, i)), ""))


def digests(docs: DataFrame, path: str, pattern: str, keep: list[str], **options) -> DataFrame:
    """``keep``, n_tokens, ids_sha256, decoded_sha256: texts encoded, and decoded again."""
    ranks = read_ranks(path)
    encoded = encode(docs, ranks, pattern, keep, **options)
    return encoded.select(
        *keep, F.size("ids").cast("long").alias("n_tokens"), F.sha2("raw", 256).alias("ids_sha256"), F.sha2(decode(F.col("ids"), ranks), 256).alias("decoded_sha256")
    )


@query("op3_bpe")
def op3(spark, sf_dir):
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])
