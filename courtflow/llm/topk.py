"""Exact top-k search by inner product with norm buckets.

Candidates are grouped by length (eighths of an octave of the norm: a few hundred classes at
most, whatever the data), each class cut by hash into buckets of about ``bucket_rows``. A first
look at the ``first_rows`` longest vectors (a fixed number, shipped to the tasks) gives every
query a lower bound of its k-th score. A class whose longest vector cannot reach that bound
is left out; for each other bucket a query has a local cosine threshold, bound / (|q| x longest),
which decides how the bucket is pruned: by length alone when it is low, by the interval its
strongest coordinate must lie in when it is high. What remains is verified with exact products.
Both prunings only leave out vectors that provably score below the bound.

Scale: work units are (bucket, block of queries), both bounded; a query sends each unit at most
one row and gets at most k rows back, so no unit emits all its pairs. Spark spreads the units.

Edge cases: vectors that are null, or hold null or non-finite components, or have no id, take no
part; shorter vectors count as padded with zeros; of queries that repeat an id one vector (the
largest as an array) is taken, and no row with its id is a candidate for it; ties go to the
smaller id; zero queries score 0 everywhere; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtflow.llm.common import cut_lineage, query, table

CLASSES_PER_OCTAVE = 8
#: Above this local cosine threshold the coordinate interval prunes more than it costs.
STEEP = 0.3
EXACT = float(1 << 53)


def integer_vectors(df: DataFrame, id_column: str, vector: str, scale: float = 64.0) -> DataFrame:
    """(id, v, norm): floor(scale * x) of each component, for the rows that take part."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = df.filter(F.col(vector).isNotNull() & F.col(id_column).isNotNull() & finite)
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).withColumn("norm", F.sqrt(squares))


def _matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Rows of a list column as integers, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width, int(lengths.max(initial=0)))
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _products(rows: np.ndarray, q: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products; ``largest`` bounds their size."""
    if largest < EXACT:
        return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(r, q)) for r in rows], dtype=object)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def search_bucket(ids, rows, norms, queries: Iterator, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of up to k candidates a query; ``queries`` has (id, vector, norm, bound)."""
    order = np.argsort(-norms, kind="stable")
    ids, rows, norms = ids[order], rows[order], norms[order]
    unit = rows / np.maximum(norms, 1e-300)[:, None]
    out = []
    for qid, q, q_norm, bound in queries:
        n, mask = len(ids), None
        if bound is not None and bound > 0 and q_norm > 0:
            least = bound / q_norm * (1 - 1e-9)
            n = int(np.searchsorted(-norms, -least, side="right"))
            local = least / norms[0] if norms[0] > 0 else 2.0
            if local > 1 or n == 0:
                continue
            if local > STEEP:
                f = int(np.abs(q).argmax())
                c = q[f] / q_norm
                spread = np.sqrt(max(0.0, (1 - local * local) * (1 - c * c))) + 1e-9
                low, high = local * c - spread, local * c + spread
                # beyond the interval's turning point a component may be up to 1 (or -1)
                high = 1.0 if c >= local else high
                low = -1.0 if -c >= local else low
                mask = np.flatnonzero((unit[:n, f] >= low) & (unit[:n, f] <= high))
        part, names = (rows[:n], ids[:n]) if mask is None else (rows[mask], ids[mask])
        other = names != qid
        scores = _products(part, q, float(norms[0]) * q_norm)
        if bound is not None:
            other &= scores >= bound
        scores, names = scores[other], names[other]
        out += [(qid, int(names[i]), int(scores[i])) for i in _best(scores, names, k)]
    return out


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, bucket_rows: int = 4096, query_rows: int = 1024, first_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query, both as from
    ``integer_vectors``."""
    length_class = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * CLASSES_PER_OCTAVE)).otherwise(-10_000).cast("int")
    rows = candidates.withColumn("class", length_class)
    rows = cut_lineage(rows, "topk-candidates")
    classes = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).collect()  # a few hundred at most
    first = rows.orderBy(F.desc("norm"), "id").limit(first_rows).select("id", "v", "norm").toArrow()
    first_ids, first_norm = first.column("id").to_numpy(), float(max(first.column("norm").to_pylist(), default=0.0))
    first_rows_matrix = _matrix(first.column("v")) if first.num_rows else np.zeros((0, 0), np.int64)
    one_each = queries.groupBy("id").agg(F.max("v").alias("v"), F.max("norm").alias("norm"))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("v"), first_rows_matrix.shape[1])
            mine = np.pad(first_rows_matrix, ((0, 0), (0, q.shape[1] - first_rows_matrix.shape[1])))
            got = []
            for i, (qid, norm) in enumerate(zip(batch.column("id").to_pylist(), batch.column("norm").to_pylist())):
                scores = _products(mine[first_ids != qid], q[i], norm * first_norm)
                got.append(float(np.sort(scores)[-k]) if len(scores) >= k else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), batch.column("norm"), pa.array(got, pa.float64())], ["id", "v", "norm", "bound"])

    asked = cut_lineage(one_each.mapInArrow(bounds, "id long, v array<long>, norm double, bound double"), "topk-queries")
    n_queries = asked.count()
    blocks = max(1, -(-n_queries // query_rows))
    parts = {r["class"]: -(-r["n"] // bucket_rows) for r in classes}
    units = F.array(*[
        F.struct(F.lit(r["class"]).alias("class"), F.lit(float(r["longest"])).alias("longest"), F.lit(parts[r["class"]]).alias("parts")) for r in classes
    ]) if classes else None
    if units is None:
        return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)

    def fits(u: Column) -> Column:
        return F.col("bound").isNull() | (F.col("bound") <= 0) | (u["longest"] * F.col("norm") * (1 + 1e-9) >= F.col("bound"))

    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = asked.select("*", F.explode(F.filter(units, fits)).alias("u")).select("*", F.explode(F.sequence(F.lit(0), F.col("u.parts") - 1)).alias("part"))
    asked = asked.select(F.col("u.class").alias("class"), "part", "block", "id", "v", "norm", "bound")
    n_parts = F.element_at(F.create_map(*[F.lit(x) for c, p in parts.items() for x in (c, p)]), F.col("class"))
    held = rows.withColumn("part", F.pmod(F.xxhash64("id"), n_parts).cast("int"))
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        width = max(_matrix(left.column("v")).shape[1], _matrix(right.column("v")).shape[1])
        own = zip(right.column("id").to_pylist(), _matrix(right.column("v"), width), right.column("norm").to_pylist(), right.column("bound").to_pylist())
        found = search_bucket(left.column("id").to_numpy(), _matrix(left.column("v"), width), left.column("norm").to_numpy(), own, k)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], [], []))], schema=schema)

    keys = ["class", "part", "block"]
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


SQL = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20"""


@query("op10_topk", SQL)
def op10(spark, sf_dir):
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("id") % 20 == 0))
