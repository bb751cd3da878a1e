"""Toxicity by multiple-instance learning: document labels train a scorer of sentences.

A sentence's score is the logistic of the weights of its features: its lower-case words and
their first four characters, each counted once. A document's score is the noisy-or of its
sentences, 1 - prod(1 - p). Only documents have labels: the gradient of a document's likelihood
reaches each sentence in proportion to how far it explains the document. Offending sentences
are those whose own score is high.

Learning: full-batch steps (Adam with an L1 pull to zero) over the labelled rows, at most
``max_rows`` per class, those with the smallest hash of the id: a documented bound, so what the
driver holds does not grow with the data. Features seen in few of these documents are left
out. The weights, a bounded dictionary, go to the scoring tasks, which read every whole text
once and shuffle nothing.

Edge cases: null and empty texts have no sentence and score 0; where the labels have one class
or none, no weight is learnt and scores are those of the start bias; very long texts are scored
sentence by sentence, sentences without end are cut after ``MAX_WORDS`` words; copies of a row
are scored alike; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm.common import query, table, text_of
from courtflow.llm.features import held_out, one_label

#: A sentence ends with its end mark or line, and after this many words.
MAX_WORDS = 64
PREFIX = 4
#: Texts that are Python strings at once, and tokens whose weights a task remembers.
SLICE, MEMORY = 500, 50_000
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_TOKEN = re.compile(r"\w+")
_NONE: dict[str, float] = {}  # one for all tokens without weight


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences."""
    out = []
    for m in _SENTENCE.finditer(text):
        start, words = m.start(), 0
        for token in _TOKEN.finditer(text, m.start(), m.end()):
            words += 1
            if words > MAX_WORDS:
                out.append((start, token.start()))
                start, words = token.start(), 1
        if words:
            out.append((start, m.end()))
    return out


def token_features(token: str) -> tuple[str, str]:
    return token, "^" + token[:PREFIX]


def features(sentence: str) -> set[str]:
    return {f for token in set(_TOKEN.findall(sentence.lower())) for f in token_features(token)}


class NoisyOr:
    """Weights by feature, and the bias, of the sentence scorer."""

    def __init__(self, bias: float = -7.0):
        self.weights: dict[str, float] = {}
        self.bias = bias
        self._seen: dict[str, dict[str, float]] = {}

    def sentence_scores(self, text: str, spans: Iterable[tuple[int, int]]) -> np.ndarray:
        seen, weights, sums = self._seen, self.weights, []
        if len(seen) > MEMORY:
            seen.clear()
        for start, end in spans:
            own: dict[str, float] = {}
            for token in set(_TOKEN.findall(text[start:end].lower())):
                known = seen.get(token)
                if known is None:
                    known = seen[token] = {f: weights[f] for f in token_features(token) if f in weights} or _NONE
                if known:
                    own.update(known)
            sums.append(sum(own[f] for f in sorted(own)))
        return 1 / (1 + np.exp(-np.clip(np.array(sums, float) + self.bias, -40, 40)))

    def document_score(self, text: str) -> float:
        p = self.sentence_scores(text, sentences(text))
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0

    def fit(
        self, docs: list[list[Collection[str]]], labels: Iterable[int], least: float = 0.005, l1: float = 3e-4, steps: int = 300, rate: float = 0.1
    ) -> NoisyOr:
        """Learn from documents given as sentences given as features."""
        keep = [(d, y) for d, y in zip(docs, labels) if d]
        y = np.array([k[1] for k in keep], float)
        if not keep or y.min() == y.max():
            return self
        spread = Counter(f for d, _ in keep for f in set().union(*d))
        known = sorted(f for f, n in spread.items() if n >= max(5, least * len(keep)))
        if not known:
            return self
        index = {f: i for i, f in enumerate(known)}
        rows = [sorted(index[f] for f in s if f in index) for d, _ in keep for s in d]
        flat = np.array([i for r in rows for i in r], np.int64)
        sentence = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        sizes = np.array([len(d) for d, _ in keep])
        doc = np.repeat(np.arange(len(keep)), sizes)
        w, b = np.zeros(len(known)), self.bias
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for step in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(sentence, w[flat], len(rows)) + b, -30, 30)))
            none = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(keep)))  # no sentence toxic
            none = np.clip(none, 1e-9, 1 - 1e-9)
            # a sentence's slope: p in a clean document, -p none / (1 - none) in a toxic one
            slope = np.repeat(np.where(y == 1, -none / (1 - none), 1.0) / len(keep), sizes) * p
            gw = np.bincount(flat, np.repeat(slope, np.bincount(sentence, minlength=len(rows))), len(known))
            gw = np.where(w != 0, gw + l1 * np.sign(w), np.sign(gw) * np.maximum(np.abs(gw) - l1, 0))
            gb = slope.sum()
            m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            c1, c2 = 1 - 0.9**step, 1 - 0.99**step
            moved = w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-6)
            w = np.where(w * moved < 0, 0.0, moved)
            b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
        self.weights = {f: float(x) for f, x in zip(known, w) if x != 0}
        self.bias = float(b)
        return self


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", modulus: int = 4, remainder: int = 2, max_rows: int = 1000) -> NoisyOr:
    """Learn from the labelled rows that are not held out; of each class the ``max_rows`` with the smallest hash of the id."""
    known = one_label(labels, column).filter(~held_out("doc_id", modulus, remainder))
    ranked = known.withColumn("key", F.xxhash64(F.col("doc_id"), F.lit(7)))
    parts = [ranked.filter(F.col("label") == k).orderBy("key", "doc_id").limit(max_rows) for k in (0, 1)]
    picked = parts[0].unionByName(parts[1]).select(F.col("doc_id").cast("long").alias("doc_id"), "label")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).join(F.broadcast(picked), "doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[sorted(features(t[s:e])) for s, e in sentences(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(made, pa.list_(pa.list_(pa.string())))], ["doc_id", "label", "made"])

    # copies of an id count once, whichever row comes first
    got = rows.mapInArrow(encode, "doc_id long, label int, made array<array<string>>").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("made").alias("made"))
    got = got.orderBy("label", "doc_id").toArrow()
    names: dict[str, str] = {}  # one string for each feature: documents are made one at a time and share them
    made = [[tuple(names.setdefault(f, f) for f in s) for s in d.as_py()] for d in got.column("made")]
    return NoisyOr().fit(made, got.column("label").to_pylist())


def with_scores(docs: DataFrame, model: NoisyOr, name: str = "score") -> DataFrame:
    """Add the document's score; a column of this name is replaced."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:  # a slice's texts at a time are Python strings
            slices = (texts.slice(at, SLICE).to_pylist() for at in range(0, len(texts), SLICE))
            yield pa.array([model.document_score(t) for part in slices for t in part], pa.float64())

    return docs.withColumn(name, F.arrow_udf(run, "double")(text_of(docs)))


def offending_sentences(docs: DataFrame, model: NoisyOr, threshold: float = 0.3, id_column: str = "doc_id") -> DataFrame:
    """(id, start, end, score, sentence) of the sentences that score ``threshold`` or more."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = []
            for text in texts:
                spans = sentences(text)
                rows.append([(s, e, float(p)) for (s, e), p in zip(spans, model.sentence_scores(text, spans)) if p >= threshold])
            yield pd.Series(rows)

    found = F.pandas_udf(run, "array<struct<start:int,end:int,score:double>>")(text_of(docs))
    rows = docs.select(id_column, text_of(docs).alias("__text"), F.explode(found).alias("s"))
    return rows.select(id_column, "s.*", F.col("__text").substr(F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("sentence"))


@query("op8_toxicity")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
