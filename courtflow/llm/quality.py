"""Quality classifier: regularised quadratic discriminant over document statistics.

Every whole text becomes a short vector of transformed statistics (logs and log-odds of
shares, so that classes are nearer to normal). Fitting needs, per class, the count, the sum
and the sum of outer products: tasks add these up and Spark sums one row per task and class,
so all labelled rows are used and only class totals reach the driver. Covariances are shrunk
to the pooled one and its diagonal; their Cholesky factors are computed once and shipped with
the scoring tasks, where the score is the logistic of the difference of the log densities
plus the log prior odds. Scoring is one pass without shuffle.

Edge cases: null and empty texts have the statistics of the empty text and get a score; a
class without rows takes the pooled moments, and with no labels at all scores are 0.5;
several labels of one id count as the largest; copies of a row are scored alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm.common import query, table, text_of
from courtflow.llm.features import held_out, one_label

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Character classes counted in the UTF-8 bytes.
_CLASSES = np.zeros((256, 5), np.float64)
for _i, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), [10], b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")):
    _CLASSES[list(_chars), _i] = 1
_CLASSES[128:, 1] += 0.5  # letters beyond ASCII take two bytes for the most part


def _odds(part: float, whole: float) -> float:
    return math.log((part + 0.5) / (max(whole - part, 0.0) + 0.5))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text."""
    words = _WORD.findall(text)
    n = len(words)
    counts = Counter(words)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    size = len(raw)
    upper, lower, digits, lines, marks = np.bincount(raw, minlength=256) @ _CLASSES
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n if n else 0.0
    spread = math.sqrt(sum((x - mean) ** 2 for x in lengths) / n) if n else 0.0
    plain = sum(w.isalpha() for w in words)
    shout = sum(w.isupper() and len(w) > 1 for w in words)
    ends = sum(w[-1] in ".!?" for w in words)
    rows = [r for r in text.split("\n") if r]
    most = max(counts.values(), default=0)
    return [
        math.log1p(n), math.log1p(mean), math.log1p(spread), _odds(len(counts), n), _odds(pairs, max(n - 1, 0)), _odds(repeats, max(n - 1, 0)),
        _odds(most, n), _odds(upper, size), _odds(digits, size), _odds(marks, size), _odds(plain, n), _odds(shout, n), _odds(ends, n),
        _odds(lines, n + 1), _odds(len(rows) - len(set(rows)), len(rows)), math.log1p(marks / (n + 1)), _odds(lower, size),
    ]


SIZE = len(statistics(""))


def class_moments(labelled: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products per class of (x, label) rows, x being statistics."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: [0, np.zeros(SIZE), np.zeros((SIZE, SIZE))] for k in (0, 1)}
        for batch in batches:
            labels = np.array(batch.column("label").to_pylist())
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, SIZE)
            for k in (0, 1):
                own = x[labels == k]
                sums[k][0] += len(own)
                sums[k][1] += own.sum(axis=0)
                sums[k][2] += own.T @ own
        rows = [{"label": k, "n": n, "moments": np.concatenate([s, q.ravel()]).tolist()} for k, (n, s, q) in sums.items() if n]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("label", pa.int32()), ("n", pa.int64()), ("moments", pa.list_(pa.float64()))]))

    parts = labelled.mapInArrow(add_up, "label int, n long, moments array<double>")
    cells = parts.select("label", F.posexplode(F.concat(F.array(F.col("n").cast("double")), "moments")).alias("at", "value"))
    totals = {(r["label"], r["at"]): r["total"] for r in cells.groupBy("label", "at").agg(F.sum("value").alias("total")).collect()}
    out = {}
    for k in sorted({k for k, _ in totals}):  # two classes of 1 + SIZE + SIZE * SIZE cells
        n, *m = (totals[k, i] for i in range(1 + SIZE + SIZE * SIZE))
        out[k] = (int(n), np.array(m[:SIZE]), np.array(m[SIZE:]).reshape(SIZE, SIZE))
    return out


class Discriminant:
    """Class means, Cholesky factors of the shrunk covariances, log determinants, priors."""

    def __init__(self, moments: dict, shrink: float = 0.2, ridge: float = 1e-3, temper: float = 1.0):
        self.temper = temper
        n_all = sum(n for n, _, _ in moments.values())
        self.classes = []
        if not n_all:
            return
        means = {k: s / n for k, (n, s, _) in moments.items()}
        covs = {k: q / n - np.outer(means[k], means[k]) for k, (n, _, q) in moments.items()}
        pooled = sum(moments[k][0] * covs[k] for k in covs) / n_all
        base = np.diag(np.diag(pooled)) + ridge * np.eye(SIZE)
        grand = sum(s for _, s, _ in moments.values()) / n_all
        for k in (0, 1):
            n = moments[k][0] if k in moments else 0
            own = covs.get(k, pooled)
            weight = shrink + (1 - shrink) * SIZE / (SIZE + n)  # a small class leans on the pooled moments
            cov = (1 - weight) * own + weight * (0.5 * pooled + 0.5 * base) + ridge * np.eye(SIZE)
            factor = np.linalg.cholesky(cov)
            self.classes.append((means.get(k, grand), np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), math.log((n + 1) / (n_all + 2))))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        if not self.classes:
            return np.full(len(x), 0.5)
        density = []
        for mean, inverse, log_det, prior in self.classes:
            z = (x - mean) @ inverse.T
            density.append(prior - 0.5 * ((z * z).sum(axis=1) + log_det))
        gap = np.clip((density[1] - density[0]) / self.temper, -700, 700)
        return 1 / (1 + np.exp(-gap))


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", modulus: int = 3, remainder: int = 1) -> Discriminant:
    known = one_label(labels, column).filter(~held_out("doc_id", modulus, remainder))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t) for t in texts], dtype=object)

    # statistics before the join: the shuffle then carries a few numbers instead of texts
    rows = docs.select("doc_id", F.pandas_udf(run, "array<double>")(text_of(docs)).alias("x")).join(known, "doc_id").select("x", "label")
    return Discriminant(class_moments(rows))


def with_scores(docs: DataFrame, model: Discriminant, name: str = "score") -> DataFrame:
    """Add the score of class 1; a column of this name is replaced."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(np.array([statistics(t) for t in texts]).reshape(-1, SIZE)))

    return docs.withColumn(name, F.pandas_udf(run, "double")(text_of(docs)))


@query("op7_quality")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
