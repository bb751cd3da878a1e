import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from courtflow.llm import prefix_trie as T
from courtflow.llm.common import WORD


def brute(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in seqs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(seqs.get(c - c % 20, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
        ends[built[c]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(WORD, p[-1][1])) if p else 0
        leaves = sum(totals[k][0] for k in kids[p]) or 1
        totals[p] = leaves, (len(members[p]) - 1) * words + sum(totals[k][1] for k in kids[p])
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(
        (members[p][0], len(p), members[p[:-1]][0] if p else -1, len(members[p]), len(kids[p]), *totals[p], digest(ends[p])) for p in members
    )


def rows_of(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(names).collect())


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({"conv": F.lit("x"), "key": F.lit(1), "turns": F.lit(2.0), "node": F.lit(None).cast("string")})
    return rows_of(T.prefix_trie(T.grafted(T.sequences(df))))


def made(seed, n, long=0):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randrange(1, 5) if c % 17 else 1 + long):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a", "a b", "a  b c\t", "", None, "Grüße 日本"])))
    return rows


def test_against_brute_force(spark):
    rows = made(1, 300) + [(None, 0, "user", "lost")] * 3 + [(900, None, "user", "z"), (900, None, "user", "z"), (900, 0, None, None)]
    assert run(spark, rows) == brute(rows)


def test_equal_conversations_over_shards(spark):
    """Two thirds of the conversations are one, so its end, and all of its path, lies in many shards."""
    rows = made(2, 400, 30) + [(c, t, "user", "same words here") for c in range(1000, 2000) for t in range(6)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pieces_of_ids(spark, monkeypatch):
    monkeypatch.setattr(T, "IDS", 7)
    rows = [(c, 0, "user", "same") for c in range(500, 600)] + made(3, 40)
    assert run(spark, rows) == brute(rows)


def test_one_turn_and_no_rows(spark):
    assert run(spark, [(1, 0, "user", None)]) == brute([(1, 0, "user", None)])
    assert run(spark, []) == []
    assert run(spark, [(None, 0, "user", "x")]) == []


def test_find_close():
    r = random.Random(4)
    for n in [1, 2, 5, 40, 64, 65, 500, 3000]:
        marks, depth, opened = [1], 1, 1
        while depth:
            if opened < n and r.random() < 0.55 or depth == 1 and opened < n:
                marks, depth, opened = [*marks, 1], depth + 1, opened + 1
            else:
                marks, depth = [*marks, -1], depth - 1
        stack, want = [], {}
        for at, m in enumerate(marks):
            if m == 1:
                stack.append(at)
            else:
                want[stack.pop()] = at
        assert T.find_close(np.array(marks, np.int8)).tolist() == [want[k] for k in sorted(want)]
