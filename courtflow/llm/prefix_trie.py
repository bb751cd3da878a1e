"""The trie of all prefixes of conversations, and what sharing them saves.

A conversation is a sequence of turns, a turn its role and text. Turns become 16-byte digests, so
a conversation is a short binary key. Conversations are range-sorted by (key, id) into shards, which
cuts a group of equal conversations like any other rows. Each shard writes its part of the trie in
preorder as balanced parentheses. Excess minima of blocks, in a tree, find the closing parenthesis
of every node (``find_close``), which delimits its subtree; counts of leaf pairs and cumulative
arrays then give leaves, members and savings of a subtree as differences.

Only the nodes on the paths of a shard's first and last conversation can go on in another shard.
These spines are merged with DataFrame functions: their local values are added up per node; each
merged node counts on the first path that holds it, summed from the end of that path; and the sums
of all paths through a node are its subtree. No task sees all spines.

Bounds: a task holds one shard and, for one conversation, 24 bytes a turn. The ids that end at a node
pass through one task in sorted pieces of ``IDS`` (a SHA-256 has one order), never held together.

Edge cases: null roles and texts are empty; turns are ordered by number (null first), then role,
then digest; repeated rows are turns of their own; rows without id are no conversation; conversations
without turns are members of the root; other columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtflow.llm.common import WORD, cut_lineage, query, table, text_of

#: Bytes of a turn's digest; parentheses of a block; ids in one row of a spine's list.
DIGEST, BLOCK, IDS = 16, 64, 1 << 16


def sequences(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turns: an array of (digest, words) in order, for each id that has rows."""
    who, what = text_of(turns, role), text_of(turns, text)
    named = F.concat(F.length(who).cast("string"), F.lit(":"), who, what)
    row = F.struct(
        turns[turn].alias("turn"), who.alias("role"), F.substring(F.unhex(F.sha2(named, 256)), 1, DIGEST).alias("digest"), F.regexp_count(what, F.lit(WORD)).cast("long").alias("words")
    )
    rows = turns.filter(turns[key].isNotNull()).select(turns[key].cast("long").alias("conv"), row.alias("row"))
    ordered = F.transform(F.sort_array(F.collect_list("row")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    return rows.groupBy("conv").agg(ordered.alias("turns"))


def find_close(parens: np.ndarray) -> np.ndarray:
    """For each opening parenthesis (1) of a balanced row of 1 and -1, in order, the place of its closing one.

    The closing one is the first place after it where the excess falls below the one at the opening.
    Places are sought in the rest of the own block, then by block minima: up their tree until a right
    neighbour reaches low enough, down to the first block that does, and through that block.
    """
    n = len(parens)
    excess = np.cumsum(parens.astype(np.int64))
    opens = np.flatnonzero(parens == 1)
    goal = excess[opens] - 1
    close = np.full(len(opens), -1, np.int64)

    def scan(open_: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Walks from ``at`` to the end of the block; the indexes (of opens) not found there."""
        at = at.copy()
        while len(open_):
            here = at < n
            here[here] = excess[at[here]] == goal[open_[here]]
            close[open_[here]] = at[here]
            at += 1
            rest = ~here & (at % BLOCK != 0)
            missed.append(open_[~here & ~rest])
            open_, at = open_[rest], at[rest]
        return np.concatenate(missed) if missed else open_

    missed: list[np.ndarray] = []
    first = np.arange(len(opens))
    edge = (opens + 1) % BLOCK == 0
    left = scan(first[~edge], opens[~edge] + 1)
    left = np.concatenate([left, first[edge]])
    if not len(left):
        return close
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
    padded[:n] = excess
    level = padded.reshape(blocks, BLOCK).min(axis=1)
    minima = [level]
    while len(level) > 1:
        level = np.minimum(level[::2], np.append(level[1::2], [np.iinfo(np.int64).max] * (len(level) % 2)))
        minima.append(level)
    at, want, done = opens[left] // BLOCK, goal[left], np.zeros(len(left), bool)
    height = np.zeros(len(left), np.int64)
    for h, level in enumerate(minima):  # up: the first right neighbour that reaches the goal
        right = at + 1
        fits = ~done & (at % 2 == 0) & (right < len(level))
        fits[fits] = level[right[fits]] <= want[fits]
        at[fits], height[fits] = right[fits], h
        done |= fits
        at[~done] //= 2
    for h in range(len(minima) - 1, 0, -1):  # down: the left child if it reaches the goal
        go = height == h
        child = 2 * at[go]
        at[go] = np.where(minima[h - 1][child] <= want[go], child, child + 1)
        height[go] = h - 1
    missed.clear()
    scan(left, at * BLOCK)
    return close


def _shard(keys: list[bytes], words: list[np.ndarray], ids: np.ndarray) -> dict[str, np.ndarray]:
    """The trie of sorted conversations, a row per node in preorder."""
    depth_of, parent, word, first_end, marks = [0], [-1], [0], [0], [1]
    path, before = [0], b""
    for at, key in enumerate(keys):
        n = len(key) // DIGEST
        same = _common(before, key)
        closing = len(path) - 1 - same
        if closing:
            marks.extend([-1] * closing)
            del path[same + 1 :]
        for depth in range(same + 1, n + 1):
            marks.append(1)
            parent.append(path[-1])
            path.append(len(depth_of))
            depth_of.append(depth)
            word.append(words[at][depth - 1])
            first_end.append(at)
        before = key
    marks.extend([-1] * len(path))
    parens = np.array(marks, np.int8)
    close = find_close(parens)
    opens = np.flatnonzero(parens == 1)
    size = (close - opens + 1) // 2
    nodes = np.arange(len(opens))
    # the node at which each conversation ends: the last one opened, or one it shares with the one before
    depth_of, parent, first_end = np.array(depth_of), np.array(parent), np.array(first_end)
    ends_at = np.zeros(len(keys), np.int64)
    opened_until = np.searchsorted(first_end, np.arange(len(keys)), "right") - 1
    lengths = np.array([len(k) // DIGEST for k in keys])
    ends_at[:] = np.where(depth_of[opened_until] == lengths, opened_until, 0)
    members_from = first_end
    n_ends = np.bincount(ends_at, minlength=len(nodes))
    total = lambda per_node: np.concatenate([[0], np.cumsum(per_node)])
    within = lambda cumulative: cumulative[nodes + size] - cumulative[nodes]
    n_convs = within(total(n_ends))
    # rank of leaf pairs "()" up to a place
    pairs = total((parens[:-1] == 1) & (parens[1:] == -1))
    leaves = pairs[np.minimum(close, len(pairs) - 1)] - pairs[opens]
    saved = within(total((n_convs - 1) * np.array(word, np.int64)))
    # members are consecutive, in order of (key, id)
    smallest = np.minimum.reduceat(np.append(ids, np.iinfo(np.int64).max), np.stack([members_from, members_from + n_convs], axis=1).ravel())[::2]
    return {
        "depth": depth_of, "parent": parent, "words": np.array(word, np.int64), "n_convs": n_convs, "leaves": leaves, "saved": saved,
        "smallest": smallest, "kids": np.bincount(parent[1:], minlength=len(nodes)), "from": members_from, "n_ends": n_ends, "ends_at": ends_at,
    }


def _common(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with."""
    n = min(len(a), len(b)) // DIGEST
    if a[: n * DIGEST] == b[: n * DIGEST]:
        return n
    low, high = 0, n - 1  # the first turn that differs lies in here
    while low < high:
        mid = (low + high) // 2
        if a[: (mid + 1) * DIGEST] == b[: (mid + 1) * DIGEST]:
            low = mid + 1
        else:
            high = mid
    return low


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted conversations of a shard to nodes: whole ones, and the local part of its spines."""
    from pyspark import TaskContext

    keys, words, ids = [], [], []
    for batch in batches:
        keys += batch.column("key").to_pylist()
        column = batch.column("words")
        flat, cuts = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        words += [flat[a - cuts[0] : b - cuts[0]] for a, b in zip(cuts[:-1], cuts[1:])]
        ids.append(batch.column("conv").to_numpy())
    if not keys:
        return
    ids, shard = np.concatenate(ids), TaskContext.get().partitionId()
    t = _shard(keys, words, ids)
    n = len(t["depth"])
    on_path = [_path(t["parent"], int(t["ends_at"][0])), _path(t["parent"], int(t["ends_at"][-1]))]
    spine = np.zeros(n, bool)
    spine[on_path[0]] = spine[on_path[1]] = True
    names = _names(on_path[0], keys[0]) | _names(on_path[1], keys[-1])

    # what lies below a spine node without the spine itself
    inner = np.flatnonzero(spine[1:]) + 1
    up = t["parent"][inner]
    kids, leaves, saved = t["kids"].copy(), np.where(t["kids"] > 0, t["leaves"], 0), t["saved"] - (t["n_convs"] - 1) * t["words"]
    for below, own in ((kids, np.ones(n, np.int64)), (leaves, t["leaves"]), (saved, t["saved"])):
        np.subtract.at(below, up, own[inner])

    order = np.argsort(t["ends_at"], kind="stable")
    at = np.concatenate([[0], np.cumsum(t["n_ends"])])
    empty = hashlib.sha256(b"").hexdigest()

    def joined(i: int) -> str:
        return hashlib.sha256(",".join(map(str, ids[order[at[i] : at[i + 1]]].tolist())).encode()).hexdigest() if t["n_ends"][i] else empty

    whole = np.flatnonzero(~spine)
    for some in np.array_split(whole, max(1, len(whole) // 20_000)):
        if len(some):
            up = t["parent"][some]
            cut = spine[up]
            yield _rows(
                node=[None] * len(some), parent=[names[p] if c else None for p, c in zip(up.tolist(), cut.tolist())], spine=np.zeros(len(some), bool), depth=t["depth"][some], words=t["words"][some],
                smallest=t["smallest"][some], parent_smallest=pa.array(t["smallest"][up], pa.int64(), mask=cut), n_convs=t["n_convs"][some], kids=t["kids"][some], leaves=t["leaves"][some],
                saved=t["saved"][some], ends_sha256=[joined(i) for i in some.tolist()],
            )
    seen: set[int] = set()
    for side, nodes in enumerate(on_path):
        fresh = np.array([i not in seen for i in nodes])
        seen.update(nodes)
        mine = np.array(nodes)
        yield _rows(
            node=[names[i] for i in nodes], parent=[names[p] if p >= 0 else None for p in t["parent"][mine].tolist()], path=np.full(len(nodes), 2 * shard + side), spine=np.ones(len(nodes), bool), depth=t["depth"][mine],
            words=t["words"][mine], smallest=t["smallest"][mine], n_convs=t["n_convs"][mine] * fresh, kids=kids[mine] * fresh, leaves=leaves[mine] * fresh, saved=saved[mine] * fresh,
        )
        for i, new in zip(nodes, fresh.tolist()):
            if new and t["n_ends"][i]:
                own = ids[order[at[i] : at[i + 1]]]
                for k in range(0, len(own), IDS):
                    yield _rows(node=[names[i]], spine=[None], path=[2 * shard + side], ids=[own[k : k + IDS].tolist()], piece=[k])


def _path(parent: np.ndarray, node: int) -> list[int]:
    out = []
    while node >= 0:
        out.append(node)
        node = int(parent[node])
    return out[::-1]


def _names(path: list[int], key: bytes) -> dict[int, bytes]:
    """A name for each node on the path of a conversation: the running digest of its key."""
    running, out = hashlib.sha256(), {path[0]: b""}
    for depth, node in enumerate(path[1:]):
        running.update(key[depth * DIGEST : (depth + 1) * DIGEST])
        out[node] = running.digest()
    return out


_TYPES = {
    "node": pa.binary(), "parent": pa.binary(), "path": pa.int64(), "spine": pa.bool_(), "depth": pa.int64(), "words": pa.int64(), "smallest": pa.int64(), "parent_smallest": pa.int64(),
    "n_convs": pa.int64(), "kids": pa.int64(), "leaves": pa.int64(), "saved": pa.int64(), "ends_sha256": pa.string(), "ids": pa.list_(pa.int64()), "piece": pa.int64(),
}
_DDL = "node binary, parent binary, path long, spine boolean, depth long, words long, smallest long, parent_smallest long, n_convs long, kids long, leaves long, saved long, ends_sha256 string, ids array<long>, piece long"


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    made = [pa.nulls(n, kind) if columns.get(name) is None else pa.array(columns[name], kind) for name, kind in _TYPES.items()]
    return pa.RecordBatch.from_arrays(made, list(_TYPES))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of ids, sorted by node, shard and place, to one digest per node."""
    node, running = None, None

    def out():
        return pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "ends_sha256": pa.array([running.hexdigest()], pa.string())})

    for batch in batches:
        for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids")):
            text = ",".join(map(str, ids.as_py())).encode()
            if name != node:
                if running is not None:
                    yield out()
                node, running = name, hashlib.sha256(text)
            else:
                running.update(b"," + text)
    if running is not None:
        yield out()


def prefix_trie(chats: DataFrame) -> DataFrame:
    """For ``chats`` of (conv, turns), ids distinct, a row per node of the trie.

    conv_id, the smallest member; depth; parent_conv_id; n_convs; n_children; n_leaves; saved_tokens;
    ends_sha256, of the ids of the conversations that end here, in order and comma-joined.
    """
    keyed = chats.select("conv", F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "").alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))
    keyed = keyed.select("conv", F.unhex("key").alias("key"), "words")
    sharded = keyed.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    nodes = cut_lineage(sharded.mapInArrow(_encode, _DDL), "trie")

    spines = nodes.filter("spine")
    merged = spines.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("smallest").alias("smallest"),
        F.sum("n_convs").alias("n_convs"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.min("path").alias("owner"),
    )
    branches = merged.filter("depth > 0").groupBy("parent").count().select(F.col("parent").alias("node"), F.col("count").alias("branches"))
    merged = cut_lineage(merged.join(branches, "node", "left").withColumn("kids", F.col("kids") + F.coalesce("branches", F.lit(0))).drop("branches"), "spines")
    # a node counts on the first path that holds it: that path has all its later nodes too
    own = merged.select("node", "owner", (F.col("leaves") + (F.col("kids") == 0).cast("long")).alias("leaf"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("gain"))
    on_paths = spines.select("node", "path", "depth").join(own, "node")
    mine = F.col("owner") == F.col("path")
    upwards = Window.partitionBy("path").orderBy(F.desc("depth"))
    sums = on_paths.select("node", F.sum(F.when(mine, F.col("leaf")).otherwise(0)).over(upwards).alias("leaf"), F.sum(F.when(mine, F.col("gain")).otherwise(0)).over(upwards).alias("gain"))
    totals = sums.groupBy("node").agg(F.sum("leaf").alias("n_leaves"), F.sum("gain").alias("saved_tokens"))
    pieces = nodes.filter("ids IS NOT NULL").select("node", "path", "piece", "ids")
    ends = pieces.repartition("node").sortWithinPartitions("node", "path", "piece").select("node", "ids").mapInArrow(_digests, "node binary, ends_sha256 string")
    parents = merged.select(F.col("node").alias("parent"), F.col("smallest").alias("above"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    of_spines = merged.drop("leaves", "saved", "owner").join(totals, "node").join(ends, "node", "left").join(parents, "parent", "left")
    of_spines = of_spines.select(*_result(F.col("above"), F.col("n_leaves"), F.col("saved_tokens"), F.coalesce("ends_sha256", empty)))
    inner = nodes.filter("NOT spine")
    whole = inner.filter("parent IS NULL").select(*_result(F.col("parent_smallest"), F.col("leaves"), F.col("saved"), F.col("ends_sha256")))
    under = inner.filter("parent IS NOT NULL").join(parents, "parent").select(*_result(F.col("above"), F.col("leaves"), F.col("saved"), F.col("ends_sha256")))
    return of_spines.unionByName(whole).unionByName(under)


def _result(above: Column, leaves: Column, saved: Column, ends: Column) -> list[Column]:
    return [
        F.col("smallest").alias("conv_id"), F.col("depth"), above.alias("parent_conv_id"), F.col("n_convs"), F.col("kids").alias("n_children"),
        leaves.alias("n_leaves"), saved.alias("saved_tokens"), ends.alias("ends_sha256"),
    ]


def grafted(chats: DataFrame) -> DataFrame:
    """Conversations with the first turns of another one: h turns of conversation c - c % 20, then
    their own turns after the first h; h is crc32 of the decimal id, modulo 4."""
    taken = F.crc32(F.col("conv").cast("string")) % 4
    heads = chats.filter(F.col("conv") % 20 == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, 3).alias("head"))
    rows = chats.select("conv", "turns", (F.col("conv") - F.col("conv") % 20).alias("base"), taken.cast("int").alias("h")).join(heads, "base", "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return rows.select("conv", F.concat(head, own).alias("turns"))


@query("op12_prefix_trie")
def op12(spark, sf_dir):
    return prefix_trie(grafted(sequences(table(spark, sf_dir, "conversations"))))
