"""Near copies by an exact metric-space join of shingle sets.

A document is the set of its distinct five-word shingles (64-bit hashes; two different shingles
of a pair share a hash with a chance near 1e-14). The distance is 1 - Jaccard, and documents
within 1/4 are linked.

* Pivots are one-shingle sets {s}, in a fixed order: shingles that a bounded sample shows to be
  common come last, others by hash. A document is at distance 1 - 1/n from the pivots that it
  holds and 1 from all others, so its Voronoi region is that of its first shingle in the order.
* Windows. Let y be within 1/4 of x. Then x lacks at most n - ceil(3n/4) of its shingles in y.
  The symmetric difference is a metric on the shingles before any place of the order, and
  by its triangle inequality with the empty set y's region can't lie behind more than
  so many of x's shingles. So x is copied to the regions of its first n - ceil(3n/4) + 1 pivots,
  and two linked documents meet in a region. A region of one document ends here.
* Regions are searched once, without recursion. First each document is compared with the leader (smallest id) of the
  region that it shares with it most often; linked ones become one class. Regions with one
  class are done. The others, equal regions once, are cut into blocks, and every pair of blocks is
  searched apart for pairs of different classes whose sizes, differences up to the pivot, and odd
  buckets (buckets that hold an odd number of one set's shingles only are at most as many as
  the symmetric difference; with four buckets or more to a shingle they are nearly as many) still
  allow a link. Of pairs well within the bounds a task emits those that connect its classes, a forest;
  of pairs near the bounds those of classes that the forest leaves apart. All are verified exactly. Only if a
  pair of a forest is no link is the search repeated, among the classes that are left, without forests.

Nothing is capped: a region of any size is split into blocks of bounded size, and what is left
out is only what the bounds prove to be unlinked or what is in one class already.

Equal sets of a task are sent to the regions once and linked by their digest, so groups of
copies are not expanded. Sets are recomputed from the texts when needed, behind a bit filter of
fixed size of the ids wanted, so texts are never shuffled.

Edge cases: null texts and texts without words have an empty set and no link; texts of fewer than
five words are one shingle; rows that repeat an id are one document (linked if any of its rows
is); rows without id have no component; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from courtflow.llm.common import cut_lineage, query, table, text_of
from courtflow.llm.components import components

WORDS = 5
#: 64-bit words of the coarsest odd buckets.
COARSE = 16
#: Share of the allowed difference up to which odd buckets speak for a link; they fall short by a fifteenth at most on average.
SURE = 0.85
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SHORT = np.uint64(0xE7037ED1A0B428DB)
#: Words of 64 bits in the filter of wanted ids: 8 MB, whatever the data.
FILTER_WORDS = 1 << 20


def shingles(text: str) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < WORDS:
        mixed = (h * _FACTORS[: len(h)]).sum(dtype=np.uint64, keepdims=True) + _SHORT * np.array([len(h)], np.uint64)
    else:
        mixed = h[: len(h) - WORDS + 1] * _FACTORS[0]
        for k in range(1, WORDS):
            mixed = mixed + h[k : len(h) - WORDS + 1 + k] * _FACTORS[k]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return bool(common) and 100 * common >= 75 * (len(a) + len(b) - common)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _texts(docs: DataFrame, id_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("node"), text_of(docs).alias("text"))


def set_sizes(texts: DataFrame) -> DataFrame:
    """node, n and the digest of the set, per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            digests = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary())], ["node", "n", "digest"])

    return texts.mapInArrow(run, "node long, n long, digest binary")


def common_shingles(texts: DataFrame, rows: int, sample_rows: int, least: int) -> np.ndarray:
    """Hashes seen in ``least`` documents or more of a sample of about ``sample_rows``, commonest last."""
    share = max(1, min(1 << 20, (sample_rows << 20) // max(1, rows)))
    picked = texts.filter(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 20)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            values, counts = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["h", "c"])

    counted = picked.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)
    got = counted.orderBy("c", "h").toArrow()
    return got.column("h").to_numpy().view(np.uint64)


def region_rows(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """(pivot, node, n, place): each document in the regions of its first pivots, with the size of
    its set and the pivot's place in it."""
    shipped = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shipped.value
        by_hash = np.argsort(order)
        ascending = order[by_hash]
        seen: set[bytes] = set()
        for batch in _slices(batches):
            pivots, nodes, sizes, places = [], [], [], []
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
                own = shingles(text)
                if not len(own) or node is None:
                    continue
                digest = hashlib.md5(own.tobytes()).digest()
                if digest in seen:  # an equal set of this task is in the regions already
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(digest)
                need = len(own) - (3 * len(own) + 3) // 4 + 1
                if len(ascending):
                    at = np.searchsorted(ascending, own)
                    at[at == len(ascending)] = 0
                    hot = ascending[at] == own
                    place = by_hash[at[hot]]
                    own = np.concatenate([own[~hot], own[hot][np.argsort(place)]])
                pivots.append(own[:need].view(np.int64))
                nodes.append(np.full(need, node, np.int64))
                sizes.append(np.full(need, len(own), np.int32))
                places.append(np.arange(need, dtype=np.int32))
            if pivots:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (pivots, nodes, sizes, places)], ["pivot", "node", "n", "place"])

    return texts.mapInArrow(run, "pivot long, node long, n int, place int")


def leader_pairs(alive: DataFrame) -> DataFrame:
    """(x, y): each document and the leader of the regions that it shares with it most often.

    Up to their last common pivot, at places i and j of the two, both sets are known: they differ
    there in i + 1 + j + 1 less twice the number c of common pivots. Pairs whose difference
    there is more than a link allows, a seventh of both sizes, are left out.
    """
    met = alive.filter("node <> leader").groupBy("node", "leader").agg(
        F.count(F.lit(1)).alias("c"), F.max("place").alias("i"), F.max("leader_place").alias("j"), F.max("n").alias("n"), F.max("leader_n").alias("m")
    )
    may = (4 * F.least("n", "m") >= 3 * F.greatest("n", "m")) & (7 * (F.col("i") + F.col("j") + 2 - 2 * F.col("c")) <= F.col("n") + F.col("m"))
    best = met.filter(may).groupBy("node").agg(F.max(F.struct("c", (-F.col("leader")).alias("l"))).alias("m"))
    return best.select(F.col("node").alias("x"), (-F.col("m.l")).alias("y"))


def _hash_word(node: Column) -> tuple[Column, Column]:
    h = F.xxhash64(node, F.lit(11))
    return F.pmod(h, F.lit(FILTER_WORDS)), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")


def _of_wanted(texts: DataFrame, nodes: DataFrame, name: str, make: Callable[[str], bytes]) -> DataFrame:
    """(node, ``name``): what ``make`` gives of the texts whose id may be in ``nodes``: a bit filter of
    fixed size, no shuffle of texts. One call of Python filters and makes, so a task holds one Python worker."""
    word, bit = _hash_word(F.col("node"))
    bits = nodes.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).toArrow()
    words = np.zeros(FILTER_WORDS, np.int64)
    if bits.num_rows:
        words[bits.column("w").to_numpy()] = bits.column("bits").to_numpy()
    shipped = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            at, bit = part.column("w").to_numpy(), part.column("b").to_numpy()
            kept = part.filter(pa.array((shipped.value[at] >> bit.astype(np.int64)) & 1 == 1))
            yield pa.RecordBatch.from_arrays([kept.column("node"), pa.array([make(t) for t in kept.column("text").to_pylist()], pa.binary())], ["node", name])

    rows = texts.filter(F.col("node").isNotNull()).select("node", "text", word.alias("w"), bit.alias("b"))
    return rows.mapInArrow(run, f"node long, {name} binary")


def _sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, s): the set, as bytes, of (at least) the nodes wanted."""
    return _of_wanted(texts, nodes, "s", lambda text: shingles(text).tobytes())


def odd_buckets(own: np.ndarray) -> bytes:
    """A bit for each bucket: whether it holds an odd number of shingles. Four buckets or more to a
    shingle, a power of two from 64 * COARSE on."""
    bits = max((64 * COARSE).bit_length() - 1, (4 * max(len(own), 1) - 1).bit_length())
    held = np.bincount((own & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return np.packbits((held & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(odd: np.ndarray, words: int) -> np.ndarray:
    """The same with fewer buckets, ``words`` 64-bit words: a bucket joins those equal modulo the number of them."""
    return np.bitwise_xor.reduce(odd.reshape(-1, words), axis=0)


def apart(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the symmetric difference from two sets' odd buckets."""
    words = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())


def _odds(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, odd): the set's odd buckets."""
    return _of_wanted(texts, nodes, "odd", lambda text: odd_buckets(shingles(text)))


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of (x, y) pairs, those that are linked."""
    first, second = (_sets(texts, pairs.select(F.col(c).alias("node"))) for c in ("x", "y"))  # each side's own documents
    one = pairs.join(first.select(F.col("node").alias("x"), F.col("s").alias("a")), "x")
    two = one.join(second.select(F.col("node").alias("y"), F.col("s").alias("b")), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            keep = [linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("x"), kept.column("y")], ["x", "y"])

    return two.select("x", "y", "a", "b").mapInArrow(run, "x long, y long")


def block_pairs(nodes, n, alone, labels, coarse, fine, left: np.ndarray, right: np.ndarray, forest: bool) -> Iterator[tuple[int, int, bool]]:
    """(x, y, sure): pairs of a left and a right row, of different classes, whose sizes, differences
    up to the pivot, and coarse and then fine odd buckets allow a link. With ``forest`` those well
    within the last bound are sure: they join their classes in ``labels``, and the other pairs
    follow if their classes are still apart then."""
    doubtful = []

    def pair(i, j, sure):
        x, y = sorted((int(nodes[i]), int(nodes[j])))
        return x, y, sure

    for i in left:
        others = right if left is not right else right[right > i]
        small, large = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
        fits = (labels[others] != labels[i]) & (4 * small >= 3 * large) & (7 * (alone[others] + alone[i]) <= n[others] + n[i])
        others = others[fits]
        if len(others):
            others = others[7 * np.bitwise_count(coarse[others] ^ coarse[i]).sum(axis=1, dtype=np.int64) <= n[others] + n[i]]
        for j in others:
            both = n[i] + n[j]
            if labels[i] == labels[j] or 7 * (least := apart(fine[i], fine[j])) > both:
                continue
            if forest and 7 * least <= SURE * both - 28:
                yield pair(i, j, True)
                labels[labels == labels[j]] = labels[i]
            else:
                doubtful.append((i, j))
    for i, j in doubtful:
        if labels[i] != labels[j]:
            yield pair(i, j, False)


def _views(column: pa.BinaryArray) -> list[np.ndarray]:
    """The 64-bit words of each value, without a copy."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return [values[a:b].view(np.uint64) for a, b in zip(ends[:-1], ends[1:])]


#: What a task of the search is known by.
TASK = ["task", "wide", "i", "j"]


def block_tasks(held: DataFrame, block_rows: int, shared: int = 16) -> DataFrame:
    """Members of the open regions, each once for every pair of blocks that it is in, with ``TASK``.

    A pair of blocks of a region of more than one is a task of its own: some two blocks' rows,
    however large the region. Regions of one block share tasks of some ``shared`` blocks' rows; they
    are not expanded, so their members are the rows that these tasks get.
    """
    single = F.col("blocks") == 1
    groups = max(1, -(-held.filter(single).count() // (shared * block_rows)))
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    held = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    return held.withColumns({"task": F.when(single, F.pmod(F.xxhash64("pivot"), F.lit(groups))), "wide": F.when(~single, F.col("pivot"))})


def open_members(alive: DataFrame, labels: DataFrame, block_rows: int) -> DataFrame:
    """The rows of regions with more than one class, with ``blocks``, the number of blocks of the region.

    ``alone`` counts the pivots of a document before the one of the region that no other
    document has among its own: the other document of a linked pair lacks them all.
    """
    order = Window.partitionBy("node").orderBy("place")
    rows = alive.select("pivot", "node", "n", "place", (F.col("place") + 1 - F.dense_rank().over(order)).alias("alone"))
    rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    rows = cut_lineage(rows, "jaccard-regions")
    regions = rows.groupBy("pivot").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members"), F.sum("place").alias("places"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("sig"), F.sum(F.xxhash64("node", F.lit(2)).cast("decimal(38,0)")).alias("sig2"),
    ).filter("low <> high")
    # of regions with equal members one is enough: the last in the order, where most is known
    regions = regions.groupBy("members", "sig", "sig2").agg(F.max(F.struct("places", "pivot"))["pivot"].alias("pivot"))
    blocks = F.ceil(F.col("members") / F.lit(block_rows)).cast("int")
    return cut_lineage(rows.join(regions.select("pivot", blocks.alias("blocks")), "pivot"), "jaccard-open")


def open_pairs(held: DataFrame, odds: DataFrame, block_rows: int, forest: bool) -> DataFrame:
    """(x, y, sure) pairs of different classes that meet in a region and may be linked, as ``block_pairs`` has them."""
    held = block_tasks(held, block_rows, shared=4).join(odds, "node").select(*TASK, "pivot", "own", "node", "n", "alone", "label", "odd")

    def run(rows: pa.Table) -> pa.Table:
        odd = [v for chunk in rows.column("odd").chunks for v in _views(chunk)]  # the longest column is neither sorted nor copied
        order = pc.sort_indices(rows.drop_columns(["odd"]), [("pivot", "ascending"), ("i", "ascending"), ("j", "ascending"), ("own", "ascending")]).to_numpy()
        key = np.stack([rows.column(c).to_numpy().astype(np.int64)[order] for c in ("pivot", "i", "j")])
        starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])) if rows.num_rows else np.zeros(0, np.int64)
        nodes, n, alone, labels, own = (rows.column(c).to_numpy().astype(np.int64)[order] for c in ("node", "n", "alone", "label", "own"))
        fine = [odd[at] for at in order]
        coarse = np.array([folded(c, COARSE) for c in fine], np.uint64).reshape(-1, COARSE)
        found = set()
        for a, b in zip(starts, np.append(starts[1:], rows.num_rows)):
            members, i, j = np.arange(a, b), key[1, a], key[2, a]
            left = members if i == j else members[own[a:b] == i]
            found.update(block_pairs(nodes, n, alone, labels, coarse, fine, left, left if i == j else members[own[a:b] == j], forest))
        x, y, sure = zip(*sorted(found)) if found else ((), (), ())
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64()), "sure": pa.array(sure, pa.bool_())})

    return held.groupBy(*TASK).applyInArrow(run, "x long, y long, sure boolean").distinct()


def join_links(docs: DataFrame, sizes: DataFrame, id_column: str = "doc_id", sample_rows: int = 8000, least: int = 3, block_rows: int = 2048) -> DataFrame:
    """(x, y) links that connect all linked documents; ``sizes`` as from ``set_sizes``."""
    texts = _texts(docs, id_column)
    common = common_shingles(texts, sizes.count(), sample_rows, least)
    region = Window.partitionBy("pivot")
    first = F.min(F.struct("node", "n", "place")).over(region)
    alive = region_rows(texts, common).select("*", first.alias("first"), F.max("node").over(region).alias("last")).filter("first.node <> last")
    alive = alive.select("pivot", "node", "n", "place", F.col("first.node").alias("leader"), F.col("first.n").alias("leader_n"), F.col("first.place").alias("leader_place"))
    alive = cut_lineage(alive, "jaccard-alive")
    leaders = cut_lineage(leader_pairs(alive), "jaccard-leaders")
    copies = sizes.filter(F.col("digest").isNotNull() & F.col("node").isNotNull())
    firsts = copies.groupBy("digest").agg(F.min("node").alias("y"), F.max("node").alias("z")).filter("y <> z").select("digest", "y")
    equal = copies.join(firsts, "digest").select(F.col("node").alias("x"), "y").filter("x <> y")
    links = cut_lineage(verified(texts, leaders).unionByName(equal), "jaccard-links")
    labels = components(links)
    held = open_members(alive, labels, block_rows)
    odds = cut_lineage(_odds(texts, held.select("node")), "jaccard-odd")
    pairs = cut_lineage(open_pairs(held, odds, block_rows, forest=True), "jaccard-pairs")
    right = cut_lineage(verified(texts, pairs), "jaccard-links")
    links = links.unionByName(right)
    if pairs.filter("sure").join(right, ["x", "y"], "left_anti").isEmpty():
        return links
    held = open_members(alive, components(links), block_rows)
    pairs = cut_lineage(open_pairs(held, odds, block_rows, forest=False), "jaccard-pairs")
    return links.unionByName(verified(texts, pairs))


def near_copies(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """Per row: id_column, n_shingles, component_id (smallest id that links reach)."""
    sizes = cut_lineage(set_sizes(_texts(docs, id_column)), "jaccard-sizes")
    found = components(join_links(docs, sizes, id_column, **options))
    out = sizes.join(found, "node", "left")
    return out.select(F.col("node").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """One document of each class, that of the smallest id; of rows that repeat an id one stays."""
    found = near_copies(docs, id_column, **options)
    gone = found.filter(F.col(id_column) != F.col("component_id")).select(id_column).distinct()
    kept = docs.join(gone, id_column, "left_anti")
    return kept.filter(F.col(id_column).isNotNull()).dropDuplicates([id_column]).unionByName(kept.filter(F.col(id_column).isNull()))


@query("op2_jaccard_join")
def op2(spark, sf_dir):
    return near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
