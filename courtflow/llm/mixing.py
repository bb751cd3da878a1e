"""Mixing sources by a time-varying curriculum, with DataFrame functions only.

Each source has a weight schedule, linear from its weight at the start of training to
the one at the end. Its integral is the source's weight in the mix: targets share the
total words by weight, none above ``cap`` times its source's size, the excess shared
again by weight. A source is read pass after pass in a fixed shuffled order (by MD5 of
the id) until its target is met. Its demand by time t is

    D(t) = target * (a t + (b - a) t^2 / 2) / ((a + b) / 2),   a, b = weights at start, end

and the training position of a document is the t at which the demand reaches the words
before it: the inverse of D. Sorting by position (a range sort) gives the order in which
to train.

Scale: only (source, id, size) is shuffled, never the text. Cumulative words within a
source are exact without walking a source in one task: a source is cut into hash ranges of
about ``per_range`` documents, sums of ranges are accumulated, then documents within each
range. Sources join by a table with one row per source, which Spark broadcasts only if it
is small; beyond that the join is a shuffle whose hot partitions are split at run time.

Edge cases: a null or empty text has size 0 and takes nothing; a source of size 0 has target
0; the null source is a source of its own and sorts last; repeated rows each count; an empty
table gives an empty result; input columns are not kept except the id.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtflow.llm.common import WORD, cut_lineage, query, table, text_of

#: (weight at start, weight at end) of the sources in code point order, repeating. Integrals: 5, 2, 1.
SCHEDULES = ((6.0, 4.0), (2.0, 2.0), (0.5, 1.5))


def sizes(docs: DataFrame, id_column: str = "doc_id", row_key: str | None = None) -> DataFrame:
    """id, source, words, the MD5 keys of the reading order, and ``row_key`` if there is one."""
    text = text_of(docs)
    return docs.select(
        F.col(id_column).alias("id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit(""))).alias("k1"),
        F.md5(text).alias("k2"),
        *([F.col(row_key).alias("row_key")] if row_key else []),
    )


def source_targets(base: DataFrame, schedules: Sequence[tuple[float, float]] = SCHEDULES, cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """One row per source: sid, source_size, n_docs, start, end, target."""
    per = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    which = F.pmod("sid", F.lit(len(schedules)))
    at = lambda i: F.element_at(F.array(*[F.lit(float(s[i])) for s in schedules]), which + 1)
    per = per.select("*", at(0).alias("start"), at(1).alias("end")).withColumn("weight", (F.col("start") + F.col("end")) / 2)
    # sources by how soon they fill up; those before the first that does not are at their cap
    per = per.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "sid")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    rest = total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weights = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", rest / weights)
    per = per.withColumn("full", F.col("limit") <= F.col("weight") * F.col("level"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), "sid", "level"))).over(everything)["level"]
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * level)
    return per.select("source", "sid", "source_size", "n_docs", "start", "end", target.alias("target"))


def _position(words, target, start, end):
    """The time at which a source's demand reaches ``words``."""
    u = F.least(F.try_divide(words, target), F.lit(1.0)) * (start + end) / 2
    steep = end - start
    root = F.sqrt(F.greatest(start * start + steep * u * 2, F.lit(0.0)))
    return F.when(steep == 0, F.try_divide(u, start)).otherwise(F.try_divide(root - start, steep))


def mix(
    docs: DataFrame,
    schedules: Sequence[tuple[float, float]] = SCHEDULES,
    cap: float = 3.0,
    share: float = 1.0,
    per_range: int = 20_000,
    id_column: str = "doc_id",
    row_key: str | None = None,
) -> DataFrame:
    """One row per document: id_column, k2 (MD5 of the text), row_key (a column that names
    the row, if one is given), size, source_size, target, taken and ``passes``, an array with (pass, words, position) for each time the document
    is read. Words taken from a source add up to the whole part of its target."""
    base = cut_lineage(sizes(docs, id_column, row_key), "mix-sizes")
    sources = cut_lineage(source_targets(base, schedules, cap, share), "mix-sources")
    joined = base.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).drop("source")
    ranges = F.ceil(F.col("n_docs") / F.lit(per_range))
    at = F.conv(F.substring("k1", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    joined = joined.withColumn("range", F.floor(at * ranges))
    sums = joined.groupBy("sid", "range").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("sid").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("carry"))
    within = Window.partitionBy("sid", "range").orderBy("k1", "id", "k2", *(["row_key"] if row_key else [])).rowsBetween(Window.unboundedPreceding, 0)
    joined = joined.withColumn("own", F.sum("size").over(within) - F.col("size"))
    joined = joined.join(sums, (F.col("sid") == F.col("s")) & (F.col("range") == F.col("r")))
    before = F.col("carry") + F.col("own")
    goal = F.floor("target").cast("long")

    def one_pass(p):
        at = F.col("source_size") * p + before
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - at))
        position = _position(at.cast("double"), F.col("target"), F.col("start"), F.col("end"))
        return F.struct(F.lit(p).alias("pass"), words.alias("words"), position.alias("position"))

    passes = F.filter(F.array(*[one_pass(p) for p in range(ceil(cap))]), lambda x: x["words"] > 0)
    out = joined.withColumn("passes", passes)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda acc, x: acc + x["words"])
    key = ["row_key"] if row_key else []
    return out.select(F.col("id").alias(id_column), "k2", *key, "size", "source_size", "target", taken.alias("taken"), "passes")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per reading of a document, range-sorted by training position."""
    each = mixed.select("*", F.inline("passes")).drop("passes")
    return each.orderBy("position", mixed.columns[0], "k2")


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """``docs`` as often as the mix reads them, range-sorted by training position; same columns.

    A document whose last pass is cut by the end of its source's target is read whole then.
    Only rows that are equal in every column are one row here, read as often as all of them together.
    """
    whole = docs.select(F.struct(*docs.columns).alias("row"))
    keyed = whole.select("row", F.md5(F.to_json("row", {"ignoreNullFields": "false"})).alias("row_key"))
    named = keyed.select(F.col("row")[id_column].alias(id_column), F.col("row.source"), F.col("row.text"), "row_key")
    each = training_order(mix(named, id_column=id_column, row_key="row_key", **options)).select("row_key", "position")
    read = keyed.dropDuplicates(["row_key"]).join(each, "row_key")
    return read.orderBy("position", "row_key").select("row.*")


SQL = r"""WITH b AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k1, md5(coalesce(text, '')) AS k2 FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM b GROUP BY source),
w AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, source_size * 3e0 AS lim FROM s),
l AS (SELECT *, (SUM(source_size) OVER () * 1e0 - coalesce(SUM(lim) OVER (ORDER BY lim / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
  / SUM(weight) OVER (ORDER BY lim / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN lim <= weight * level THEN lim ELSE weight * (SELECT arg_min(level, lim / weight) FROM l WHERE lim > weight * level) END AS target FROM l),
c AS (SELECT b.doc_id, b.size, t.source_size, t.target, SUM(b.size) OVER (PARTITION BY b.source ORDER BY k1, doc_id, k2 ROWS UNBOUNDED PRECEDING) - b.size AS before
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, CAST(floor(target) AS BIGINT) - before))
  + greatest(0, least(size, CAST(floor(target) AS BIGINT) - source_size - before)) + greatest(0, least(size, CAST(floor(target) AS BIGINT) - 2 * source_size - before)) AS BIGINT) AS taken FROM c"""


@query("op9_mixing", SQL)
def op9(spark, sf_dir):
    mixed = mix(table(spark, sf_dir, "documents"))
    first = F.element_at(F.col("passes"), 1)["position"]
    placed = mixed.withColumn("first", F.when(F.size("passes") > 0, first)).orderBy("first", "doc_id")
    return placed.select("doc_id", "size", "source_size", "target", "taken")
