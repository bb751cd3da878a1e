"""Small tests of every operator: edge cases, and brute force where SQL has no answer."""

import hashlib
import io
import os
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from check import canonical
from courtflow.llm import bpe, components, fingerprint, jaccard_join, mixing, pii, quality, queries, topk, toxicity, url_filter, warc
from courtflow.llm.common import scratch_path

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    df = queries.QUERIES[name](spark, FOLDER)
    got = pd.DataFrame([list(r) for r in df.collect()], columns=df.columns, dtype=object)
    rel = con.execute(queries.CHECKS[name])
    want = pd.DataFrame(rel.fetchall(), columns=[d[0] for d in rel.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


# -- archives


def test_warc_round_trip_with_small_splits(spark):
    rows = [(i, f"http://h/{i} é", "p" * (i % 7) * 500 if i % 5 else None) for i in range(60)] + [(None, None, "pppp"), (3, "http://again", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    records = warc.with_revisits(pages, "page_id", "html")
    manifest = warc.write_warc(records.repartition(3), scratch_path(spark, "warc"), roll_bytes=2000)
    assert manifest.count() > 3
    got = warc.read_warc(spark, manifest.select("path", "length"), split_bytes=97).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    for r in got:
        if r.record_id is None or r.record_id == "3":
            continue
        html = dict((i, h) for i, _, h in rows)[int(r.record_id)] or ""
        revisit = first[html] != int(r.record_id)
        assert (r.record_type, r.payload_bytes, r.payload_digest) == ("revisit" if revisit else "response", len(html), warc.sha1_base32(html.encode()))
        assert r.refers_to == (str(first[html]) if revisit else None)
    folder = os.path.dirname(manifest.first().path)
    assert warc.read_warc(spark, folder).count() == len(rows)


def test_warc_min_bytes_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a")], "page_id long, url string, html string")
    assert warc.with_revisits(pages, "page_id", "html", min_bytes=2).filter("refers_to is not null").count() == 0
    nothing = warc.write_warc(warc.with_revisits(pages.limit(0), "page_id", "html"), scratch_path(spark, "warc"))
    assert warc.read_warc(spark, nothing).count() == 0


def test_warc_false_magic_is_skipped():
    record = warc.encode_record("1", "u", b"x" * 10, warc.sha1_base32(b"x" * 10), None)
    other = zlib.compressobj(6, zlib.DEFLATED, 31)
    junk = warc.MAGIC + b"junk" + other.compress(b"no archive") + other.flush()
    data = junk + record + junk + record
    assert len(list(warc.scan_range(io.BytesIO(data), 0, len(data)))) == 2
    assert len(list(warc.scan_range(io.BytesIO(data), len(junk) + 1, len(data)))) == 1


def test_warc_record_across_the_end_of_a_block():
    rng = random.Random(3)
    payloads = [rng.randbytes(rng.randrange(20_000)) for _ in range(400)]
    data = b"".join(warc.encode_record(str(i), "u", p, warc.sha1_base32(p), None) for i, p in enumerate(payloads))
    assert len(data) > 3 * warc.BLOCK
    for cut in (0, warc.BLOCK + 5):  # every record is owned by one of the ranges
        got = [b.partition(b"\r\n\r\n")[2] for a, z in ((0, cut), (cut, len(data))) for _, b in warc.scan_range(io.BytesIO(data), a, z)]
        assert got == payloads


def test_warc_header_of_any_length():
    url = "http://h/" + random.Random(3).randbytes(150_000).hex()
    record = warc.encode_record("1", url, b"x" * 10, warc.sha1_base32(b"x" * 10), None)
    (got,) = warc.scan_range(io.BytesIO(record), 0, len(record))
    assert got[0]["warc-target-uri"] == url and got[1].endswith(b"x" * 10)


# -- near copies


def brute_components(rows):
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("options", [{}, {"sample_rows": 30, "least": 2, "block_rows": 3}])
def test_near_copies_brute_force(spark, options):
    random.seed(4)
    base = [f"w{random.randrange(400)}" for _ in range(60)]
    rows = []
    for i in range(120):
        t = list(base) if i % 3 else [f"v{random.randrange(10**6)}" for _ in range(random.choice([0, 2, 5, 40]))] + base[:20]
        for _ in range(random.randrange(6)):
            t[random.randrange(len(t))] = f"w{random.randrange(400)}"
        rows.append((i, " ".join(t)))
    rows += [(200, None), (201, ""), (202, "a b"), (203, "A  b"), (204, "é É"), (205, "é é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_copies(df, **options).collect()}
    assert got == brute_components(rows)


def test_region_of_any_size_has_bounded_tasks(spark):
    """A region of 400 is expanded to 50 rows a member; no task may get more than its two blocks."""
    rows = [(1, i, 50) for i in range(400)] + [(2 + i // 4, 1000 + i, 1) for i in range(400)]
    held = spark.createDataFrame(rows, "pivot long, node long, blocks int")
    tasks = jaccard_join.block_tasks(held, 8).groupBy(*jaccard_join.TASK).agg(F.count(F.lit(1)).alias("n"), F.collect_set("node").alias("nodes"), F.collect_set("pivot").alias("p")).collect()
    assert sum(t.n for t in tasks) == 400 * 50 + 400
    assert max(t.n for t in tasks if t.wide is not None) <= 2 * 3 * 8  # blocks are hashed: up to three times their mean
    assert len([t for t in tasks if t.wide is None]) <= 4 and max(t.n for t in tasks if t.wide is None) <= 3 * 16 * 8
    met = {(a, b) for t in tasks if t.wide is not None for a in t.nodes for b in t.nodes}
    assert len(met) == 400 * 400


def test_near_copies_edges(docs, empty):
    got = {r.doc_id: r.component_id for r in jaccard_join.near_copies(docs).collect()}
    assert (got[1], got[2], got[4], got[5], got[6], got[None]) == (1, 2, 4, 4, 4, None)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 8, 9]
    assert jaccard_join.near_copies(empty).count() == 0


def test_bounds_never_exceed_difference():
    rng = np.random.default_rng(1)
    for n in (3, 50, 3000):
        a = np.unique(rng.integers(0, 2**63, n, np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n, np.uint64) * np.uint64(2)]))
        bound = jaccard_join.apart(*(np.frombuffer(jaccard_join.odd_buckets(s), np.uint64) for s in (a, b)))
        assert bound <= len(np.setxor1d(a, b))
        near = np.unique(np.concatenate([a[: n - n // 7], rng.integers(0, 2**63, n // 7, np.uint64) * np.uint64(2)]))
        bound = jaccard_join.apart(*(np.frombuffer(jaccard_join.odd_buckets(s), np.uint64) for s in (a, near)))
        assert bound >= 0.85 * len(np.setxor1d(a, near)) - 2


@pytest.mark.parametrize("block_rows", [16, 2048])
def test_template_family(spark, block_rows):
    """One template with own words in place of a few of its own, in one stretch or spread: similarities
    all around the threshold, so that some pairs that the bounds allow are no links."""
    random.seed(9)
    template, rows = [f"t{k}" for k in range(120)], []
    for i in range(140):
        t = list(template)
        at = random.randrange(100)
        for k in range(at, at + random.randrange(4, 16)) if i % 2 else random.sample(range(120), random.randrange(1, 5)):
            t[k % 120] = f"own{i}x{k}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_copies(df, block_rows=block_rows).collect()}
    assert got == brute_components(rows)


def test_forest_connects_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 400, np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, 365, replace=False), rng.integers(0, 2**63, int(rng.integers(0, 60)), np.uint64)])) for _ in range(60)]
    fine = [np.frombuffer(jaccard_join.odd_buckets(s), np.uint64) for s in sets]
    coarse = np.array([jaccard_join.folded(f, jaccard_join.COARSE) for f in fine])
    nodes, n, alone = np.arange(60), np.array([len(s) for s in sets]), np.zeros(60, np.int64)
    every, tree = ({p[:2] for p in jaccard_join.block_pairs(nodes, n, alone, np.arange(60), coarse, fine, nodes, nodes, forest)} for forest in (False, True))
    linked = {(i, j) for i in range(60) for j in range(i + 1, 60) if jaccard_join.linked(sets[i], sets[j])}
    assert linked <= every and tree <= every and 0 < len(tree) < len(every)

    def classes(pairs):
        label = list(range(60))
        for i, j in pairs:
            label = [label[i] if x == label[j] else x for x in label]
        return {frozenset(k for k in range(60) if label[k] == x) for x in label}

    assert classes(tree) == classes(every)


def test_forest_pairs_that_are_no_links(spark, monkeypatch):
    """Were pairs up to the bound sure, some forests would hold pairs that are no links: the search is repeated."""
    searches = []
    plain = jaccard_join.open_pairs
    monkeypatch.setattr(jaccard_join, "SURE", 2.0)
    monkeypatch.setattr(jaccard_join, "open_pairs", lambda *a, **k: searches.append(k) or plain(*a, **k))
    test_template_family(spark, 2048)
    assert [s["forest"] for s in searches] == [True, False]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20, 60)] + [(1, 2), (5, 5)], "x long, y long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {1: 1, 2: 1, **dict.fromkeys(range(20, 61), 20)}


# -- tokens


@pytest.fixture(scope="module")
def tokens():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_tiktoken(spark, docs, empty, tokens):
    ranks, public = tokens
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, ["doc_id", "source"], frequent=5, block_words=40)
    rows = encoded.select("doc_id", "ids", bpe.decode(F.col("ids"), ranks).alias("raw")).collect()
    want = sorted((r.doc_id or 0, public.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
    assert sorted((r.doc_id or 0, list(r.ids), bytes(r.raw)) for r in rows) == want
    assert bpe.encode(empty, ranks, public_tokenizers.PATTERN, ["doc_id"]).count() == 0


def test_bpe_query(spark, tokens):
    got = {r.doc_id: r for r in queries.QUERIES["op3_bpe"](spark, FOLDER).collect()}
    for i, t in texts(spark).items():
        ids = tokens[1].encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_long_words_merge_alike(tokens):
    random.seed(0)
    for _ in range(50):
        word = bytes(random.choice(b"abcdeth ns") for _ in range(random.randint(2, 150)))
        assert bpe.merge_long(word, tokens[0]) == (tokens[1]._encode_single_piece(word) if word not in tokens[0] else [tokens[0][word]])


# -- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "phone" and 10 <= len(digits) <= 15) or (kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)):
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def test_personal_data_brute_force(spark):
    random.seed(7)
    parts = ["a@b.c", "d@e.f", "_", ".", "1.2.3.4", "256.1.1.1", "4012888888881881", "4012-8888 8888 1881", "+1 (255) 555-8013", "😀", " ", "é", "12", "@", "x%"]
    rows = [(i, "".join(random.choice(parts) for _ in range(random.randrange(12)))) for i in range(300)]
    rows += [(1000, None), (1001, "a" * 50_000), (1002, "1" * 20_000), (1003, "a@" + "b." * 9000 + "c"), (1004, "+" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find(df, ["doc_id"]).select("doc_id", pii.spans_text(F.col("spans")).alias("s")).collect()}
    assert got == {i: base_spans(t or "") for i, t in rows}


def test_personal_data_found_by_context(spark):
    rows = [(i, f"key: u{i}@m.example.com end") for i in range(30)] + [(90, "key: zq81x end"), (91, "other zq99x text"), (92, "version 3.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find(df, ["doc_id"]).select("doc_id", pii.spans_text(F.col("all_spans")).alias("s")).collect()}
    assert (got[90], got[91], got[92]) == ("id:5:10", "", "")


def test_redaction(docs, empty):
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = {r.doc_id: r.text for r in out.collect()}
    assert rows[7] == "call [PHONE] now" and rows[1] is None and rows[2] == "" and "@" not in rows[3]
    assert pii.redact(empty).count() == 0


# -- fingerprints


def test_redaction_keeps_columns_of_any_name(spark):
    rows = [(1, "write to a.b@example.com now", "s", 5, "w", "k", 2.0), (2, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email int, words string, kept string, row double")
    got = pii.redact(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(1, "write to [EMAIL] now", "s", 5, "w", "k", 2.0), (2, None, None, None, None, None, None)]


def test_edited_fingerprints(spark):
    rows = sorted(texts(spark).items())
    df = spark.createDataFrame(rows + [(10**6, None)], "doc_id long, text string").repartition(5)
    got = sorted(fingerprint.edited_fingerprints(df, partitions=7).collect())
    all_texts = [t for _, t in rows] + [""]
    for k, r in enumerate(got):
        t, following = all_texts[k], all_texts[(k + 1) % len(all_texts)]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.fingerprint(t), fingerprint.fingerprint(changed))
        assert r.near_next == pytest.approx(fingerprint.likeness(r.fingerprint, fingerprint.fingerprint(following)))
        assert 0 <= r.near_edited <= 1
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.9


def test_fingerprint_edges(docs, empty):
    assert fingerprint.likeness(fingerprint.fingerprint(""), fingerprint.fingerprint("")) == 1
    assert fingerprint.edited_fingerprints(docs).count() == docs.count()
    assert fingerprint.edited_fingerprints(empty).count() == 0
    assert fingerprint.with_fingerprint(docs).filter("fingerprint is null").count() == 0


# -- url rules


def test_automaton_brute_force():
    random.seed(3)
    globs = ["**/ads/**", "*.x/**", "a?c", "**b", "*", "**", "ab*c/d"] + ["".join(random.choice("ab/?*") for _ in range(5)) for _ in range(40)]
    urls = ["", "a", "abc", "é/b"] + ["".join(random.choice("ab/c.xd") for _ in range(random.randrange(12))) for _ in range(300)]
    got = url_filter.Automaton([url_filter.glob_places(g) for g in globs]).matches(urls, cells=64)
    for k, g in enumerate(globs):
        parts = {"*": "[^/]*", "**": ".*", "?": "."}
        pattern = re.compile("".join(parts.get(e, re.escape(e)) for e in url_filter.glob_places(g)), re.S)
        assert [bool(pattern.fullmatch(u)) for u in urls] == list(got[:, k]), g


def test_url_edges(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://EXAMPLE.com/EN/"), (4, "x://evil.org/a.com/x"), (5, "http://a.net/fr/?q=/es/"), (6, "http://com"), (7, "http://h/login/x")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("old"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.com", "/EN/", "com/", "allow") and got[4][2] is None
    assert got[5] == ("a.net", "/fr/", "net/fr/", "block") and got[6] == ("com", "", None, "allow") and got[7][3] == "block"
    assert url_filter.judge(df.limit(0)).count() == 0


# -- classifiers


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    scored = queries.QUERIES["op7_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    held = scored.filter("held_out").toPandas()
    assert (held.predicted == held.quality).mean() > 0.93


def test_quality_edges(docs, empty, spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        model = quality.fit(docs, known)
        rows = quality.with_scores(docs, model).collect()
        assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
        assert quality.with_scores(empty, model).count() == 0


def test_toxicity_finds_sentences(spark):
    random.seed(5)
    clean = lambda: " ".join(random.choice(["the", "dog", "ran", "over", "hill", "sun"]) for _ in range(8)) + ". "
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, clean() * 2 + ("you vile rat. " if bad else "") + clean()))
        marks.append((i, None, int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    scored = toxicity.with_scores(df, model).collect()
    assert all((r.score >= 0.3) == (r.doc_id % 4 == 0) for r in scored)
    assert {r.sentence.strip() for r in toxicity.offending_sentences(df, model).collect()} == {"you vile rat."}


def test_wanted_sets_take_one_python_worker(spark):
    docs = spark.range(1200).select(F.col("id").alias("node"), F.concat(F.lit("a b c d e f "), "id").alias("text"))
    wanted = docs.filter("node % 7 = 0").select("node")
    for made, name, make in ((jaccard_join._sets, "s", lambda x: x.tobytes()), (jaccard_join._odds, "odd", jaccard_join.odd_buckets)):
        got = made(docs, wanted)
        assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        rows = {r.node: bytes(r[name]) for r in got.collect()}
        assert set(range(0, 1200, 7)) <= rows.keys()
        assert all(v == make(jaccard_join.shingles(f"a b c d e f {k}")) for k, v in rows.items())


def test_toxicity_holds_a_slice_of_texts(spark):
    model = toxicity.NoisyOr()
    model.weights = {"rat": 9.0}
    rows = [(i, None if i % 5 == 0 else "you rat" if i % 3 == 0 else f"nice w{i}") for i in range(2 * toxicity.SLICE + 7)]
    scored = toxicity.with_scores(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), model)
    assert "ArrowEvalPython" in scored._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.score for r in scored.collect()} == {i: model.document_score(t or "") for i, t in rows}
    assert model._seen["nice"] is model._seen["w1"]  # tokens without weight share one dictionary


def test_toxicity_edges(docs, empty, spark):
    labels = spark.createDataFrame([(4, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.with_scores(docs, model).collect()}
    assert got[1] == got[2] == 0 and all(0 <= s <= 1 for s in got.values())
    assert toxicity.with_scores(empty, model).count() == 0 and toxicity.fit(empty, labels.limit(0)).weights == {}


# -- mixing


def test_mixing_sums_and_caps(docs, empty):
    rows = mixing.mix(docs, per_range=2).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert r.taken <= 3 * r.size
        by.setdefault((r.target, r.source_size), []).append(r.taken)
    assert all(abs(sum(v) - t) <= 1 for (t, _), v in by.items() if t)
    assert sum(t for t, _ in by) <= sum(r.size for r in rows) + 1e-6
    assert mixing.mix(empty).count() == 0


def test_training_order_follows_schedule(spark):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    order = [r.doc_id % 2 for r in mixing.training_order(mixing.mix(df, schedules=((3.0, 0.0001), (0.0001, 3.0)))).collect()]
    assert len(order) == 400 and np.mean(order[:100]) < 0.3 < 0.7 < np.mean(order[-100:])
    assert mixing.mixed_documents(df).columns == df.columns


# -- exact search


def test_top_k_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8) * (1 + i % 9) * (5 if i < 4 else 1)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 400)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (420, [float("inf")]), (440, [0.0] * 8), (460, [1.0, 2.0]), (480, []), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = topk.integer_vectors(df, "vec_id", "embedding")
    got = sorted(tuple(r) for r in topk.top_k(v, v.filter("id % 20 = 0"), bucket_rows=16, query_rows=4, first_rows=30).collect())
    ok = {i: [int(np.floor(64 * x)) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    want = []
    for q in sorted(ok):
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(ok[q], e)), i) for i, e in ok.items() if i != q)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:20])]
    assert got == sorted(want)
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_mixed_documents_keep_rows_of_equal_text(spark):
    schema = "doc_id long, source string, text string, row string, lang string"
    rows = [(None, "x", "one two three", None, "en"), (None, "y", "one two three", "r", "en"), (None, "y", "one two three", "r", "fr"), (7, None, "a b", "", None)]
    df = spark.createDataFrame([*rows, rows[0]], schema)
    even = {"schedules": ((1.0, 1.0),)}
    readings = mixing.mix(df, **even).agg(F.sum(F.size("passes")).alias("n")).first().n
    got = [tuple(r) for r in mixing.mixed_documents(df, **even).collect()]
    assert set(got) == set(rows) and len(got) == readings
