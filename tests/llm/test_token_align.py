import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from courtflow.llm import token_align as T


def brute(texts):
    first = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    size = {v: len(k) for k, v in T.byte_level_pieces(P.path("byte_bpe_50k.json")).items()}
    made = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a, b = first.encode(" " + (text or ""), add_special_tokens=False).ids, second.encode(text or "")
        pieces = [second.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if not text or b"".join(bytes_b) != raw or sum(size[i] for i in a) != len(raw):
            made.append(None)
            continue
        ends = [np.cumsum([size[i] for i in a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, start = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, own) if start < e <= cut) for ids, own in zip((a, b), ends)))
            start = cut
        links = [(x, y) for x, e, s in zip(a, ends[0], [0, *ends[0]]) for y, f, t in zip(b, ends[1], [0, *ends[1]]) if max(s, t) < min(e, f)]
        made.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(p for m in made if m for p in set(m[3]))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for m in made:
        out.append((*m[:3], len(m[3]), sum(count[p] == top[p[0]] for p in m[3]), sum(count[p] for p in m[3]), m[4]) if m else (0, 0, 0, 0, 0, 0, ""))
    return out


TEXTS = [
    None, "", " ", "  two  spaces\n\nand lines\t", "hello world", "hello world", "Grüße aus Köln 日本語 😀😀 'll don't", "<|endoftext|> </s> <s> plain", "▁ a piece mark", "a" * 300, "\x00\x01 bytes \x7f",
    "internationalization of antidisestablishmentarianism, 1234567890.12", "x", "\u00a0nbsp\u3000wide", "ﬁne ① ½",
]


def run(spark, texts):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, docs string")
    docs = docs.withColumn("block", F.lit(1)).repartition(3)
    made = T.align_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"), ["doc_id", "docs", "block"]).collect()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {(r["docs"], r["block"]) for r in made} <= {("clash", 1)}
    return [tuple(r[n] for n in names) for r in sorted(made, key=lambda r: r["doc_id"])]


@pytest.mark.parametrize("chunk, block", [(1_500_000, 16_000_000), (40, 200), (1, 1)])
def test_against_brute_force(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(T, "CHUNK_LINKS", chunk)
    monkeypatch.setattr(T, "BLOCK_LINKS", block)
    r = random.Random(1)
    words = [w for t in TEXTS if t for w in t.split(" ")] + ["the", "of", "tokenizer", "über", "çerç", "Ñandú"]
    texts = TEXTS + [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(40)]
    assert run(spark, texts) == brute(texts)


def test_no_rows(spark):
    assert run(spark, []) == []


def test_align_of_ends():
    r = random.Random(2)
    for _ in range(300):
        n = r.randrange(1, 200)
        a, b = (np.array(sorted({*r.sample(range(1, n + 1), max(1, int(n * r.choice([0.2, 0.9, 0.99, 1])))), n})) for _ in "ab")
        runs, groups, la, lb = T.align(a, b)
        last_a, last_b, la, lb = T._laid_out(runs, groups, la, lb, len(a), len(b))
        both = set(a.tolist()) & set(b.tolist())
        assert set(a[last_a].tolist()) == set(b[last_b].tolist()) == both
        spans = [list(zip([0, *e.tolist()], e.tolist())) for e in (a, b)]
        want = {(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if max(s, t) < min(e, f)}
        assert len(la) == len(want) and set(zip(la.tolist(), lb.tolist())) == want


def test_packed_numbers():
    for numbers in ([], [0], [127, 128, 0, 16383, 16384, 5, 1 << 40]):
        assert T._unpacked(T._packed(np.array(numbers, np.int64))).tolist() == numbers
