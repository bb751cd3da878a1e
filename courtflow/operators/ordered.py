"""Ordered (per-match, by-frame) computation that does not put a match in one task.

A window partitioned by match alone walks the whole match in a single task, so a
match holding a third of all rows decides the run time. Every helper here cuts a
match into chunks of consecutive frame numbers, works per (match, chunk), and
moves only what crosses a chunk border through one small row per chunk:

* ``with_lookback``  - functions of the last ``n`` rows: the rows before a chunk
  are copied into it ("halo"), then any window over (match, chunk) is exact.
* ``last_before``    - last non-null value strictly before a row.
* ``next_after``     - first non-null value strictly after a row.
* ``running_sum``    - prefix sums.
* ``blended``        - x = w v + (1 - w) x, row after row: a scan of affine steps.

Each pass shuffles its rows once, by (match, chunk). The per-chunk summary is built
from that same exchange: it carries whole rows, so both readers of the exchange need
the same columns and Spark runs it once. Only the summaries are ordered per match.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_FRAMES = 1 << 14
_CHUNK = "__chunk"
_HALO = "__halo"
_NO_FRAME = (1 << 63) - 1


def add_chunk(df: DataFrame, order: str, size: int, name: str = _CHUNK) -> DataFrame:
    return df.withColumn(name, F.floor(F.col(order) / F.lit(float(size))).cast("long"))


def _chunked(df: DataFrame, keys: list[str], order: str, size: int, tasks: int | None = None) -> tuple[DataFrame, list[str]]:
    """Rows with their chunk, shuffled so that a chunk sits in one partition, and the columns
    that stand for the keys.

    A null key is a group of its own, as in a window, and rows without a frame are a chunk
    after all others. Equal joins don't match nulls, and null-safe ones would shuffle the rows
    again, so each key is a filled value and a flag: both readers then share one exchange.
    """
    d = add_chunk(df, order, size)
    d = d.withColumn(_CHUNK, F.coalesce(_CHUNK, F.lit(_NO_FRAME)))
    by = []
    for k in keys:
        filled, missing = f"__key_{k}", f"__null_{k}"
        d = d.withColumns({filled: F.coalesce(k, F.lit(0).cast(df.schema[k].dataType)), missing: F.col(k).isNull()})
        by += [filled, missing]
    return d.repartition(*([] if tasks is None else [tasks]), *by, _CHUNK), by


def _order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])


def _sorted(order: Sequence[str], forward: bool = True) -> list[Column]:
    """Nulls last, or first when read backwards."""
    return [F.col(c).asc_nulls_last() if forward else F.col(c).desc_nulls_first() for c in order]


def with_lookback(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows: int,
    compute: Callable[[DataFrame, object], DataFrame],
    size: int = CHUNK_FRAMES,
) -> DataFrame:
    """Run ``compute(df, window)`` where each row may look back ``rows`` rows.

    ``order[0]`` is the integer frame column that is cut into chunks; ``order``
    as a whole must be a total order within ``keys``. ``compute`` may add columns
    using the window it is given (partitioned by keys and chunk).
    """
    keys, order = list(keys), list(order)
    columns = df.columns
    d, by = _chunked(df, keys, order[0], size)
    in_chunk = Window.partitionBy(*by, _CHUNK)
    tail = (
        d.withColumn("__rn", F.row_number().over(in_chunk.orderBy(*_sorted(order, forward=False))))
        .filter(F.col("__rn") <= rows)
        .groupBy(*by, _CHUNK)
        .agg(F.sort_array(F.collect_list(F.struct(_order_struct(order).alias("__o"), F.struct(*columns).alias("__r")))).alias("__tail"))
    )
    by_chunk = Window.partitionBy(*by).orderBy(_CHUNK)
    halo = (
        tail.withColumn("__prev", F.flatten(F.collect_list("__tail").over(by_chunk.rowsBetween(-rows, -1))))
        .withColumn("__prev", F.when(F.size("__prev") > rows, F.slice("__prev", -rows, rows)).otherwise(F.col("__prev")))
        .select(*by, _CHUNK, F.explode("__prev").alias("__p"))
        .select("__p.__r.*", *by, _CHUNK, F.lit(True).alias(_HALO))
    )
    # partitioned like the rows, so that the union needs no further shuffle
    both = d.withColumn(_HALO, F.lit(False)).unionByName(halo.repartition(*by, _CHUNK))
    out = compute(both, in_chunk.orderBy(*_sorted(order)))
    return out.filter(~F.col(_HALO)).drop(*by, _CHUNK, _HALO)


def _carry(df, keys, order, values, size, forward, earliest=(), tasks=None):
    """Carry values from rows strictly before (``forward``) or after each row.

    Nearest non-null value, or the most distant one for names in ``earliest``.
    """
    keys, order = list(keys), list(order)
    d, by = _chunked(df, keys, order[0], size, tasks)
    row = F.struct(*df.columns).alias("r")

    def summarise(name, v):
        latest = forward != (name in earliest)
        pick = F.max_by if latest else F.min_by
        return pick(F.struct(v.alias("v"), row), F.when(v.isNotNull(), _order_struct(order))).alias(f"__s_{name}")

    def fold(name, c, window):
        return (F.first if name in earliest else F.last)(c, ignorenulls=True).over(window)

    summary = d.groupBy(*by, _CHUNK).agg(*[summarise(n, v) for n, v in values.items()])
    sort = F.col(_CHUNK).asc() if forward else F.col(_CHUNK).desc()
    across = Window.partitionBy(*by).orderBy(sort).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *by, _CHUNK, *[fold(n, F.col(f"__s_{n}.v"), across).alias(f"__c_{n}") for n in values]
    )
    within = (
        Window.partitionBy(*by, _CHUNK).orderBy(*_sorted(order, forward)).rowsBetween(Window.unboundedPreceding, -1)
    )

    def combine(name):
        here, there = F.col(f"__h_{name}"), F.col(f"__c_{name}")
        return F.coalesce(there, here) if name in earliest else F.coalesce(here, there)

    # the carried values join rows that the window has sorted by chunk, so they are not sorted with them
    out = d.withColumns({f"__h_{n}": fold(n, v, within) for n, v in values.items()}).join(carry, [*by, _CHUNK])
    out = out.withColumns({n: combine(n) for n in values})
    return out.drop(*by, _CHUNK, *[f"__{x}_{n}" for n in values for x in "hc"])


def last_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    size: int = CHUNK_FRAMES,
    earliest: Sequence[str] = (),
    tasks: int | None = None,
) -> DataFrame:
    """Add ``name`` = last non-null ``value`` on rows strictly before this one
    (the first such value for names in ``earliest``). ``tasks``: how many tasks get
    the chunks; by default Spark's own number, whatever the size of the table."""
    return _carry(df, keys, order, values, size, forward=True, earliest=earliest, tasks=tasks)


def next_after(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], size: int = CHUNK_FRAMES
) -> DataFrame:
    """Add ``name`` = first non-null ``value`` on rows strictly after this one."""
    return _carry(df, keys, order, values, size, forward=False)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], size: int = CHUNK_FRAMES
) -> DataFrame:
    """Add ``name`` = sum of ``value`` up to and including this row."""
    keys, order = list(keys), list(order)
    d, by = _chunked(df, keys, order[0], size)
    summary = d.groupBy(*by, _CHUNK).agg(
        *[F.sum(v).alias(f"__s_{n}") for n, v in values.items()], F.max(F.struct(*df.columns)).alias("__r")
    )
    across = Window.partitionBy(*by).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *by, _CHUNK, *[F.coalesce(F.sum(f"__s_{n}").over(across), F.lit(0)).alias(f"__c_{n}") for n in values]
    )
    within = Window.partitionBy(*by, _CHUNK).orderBy(*_sorted(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = d.join(carry, [*by, _CHUNK]).withColumns(
        {n: F.coalesce(F.sum(v).over(within), F.lit(0)) + F.col(f"__c_{n}") for n, v in values.items()}
    )
    return out.drop(*by, _CHUNK, *[f"__c_{n}" for n in values])


def blended(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, weight: Column, name: str, size: int = 1 << 10
) -> DataFrame:
    """Add ``name``: x after each row, where a row of ``value`` v (an array of doubles) and ``weight``
    w turns x into w v + (1 - w) x, element by element. The first v of a group is x as it is; a row with
    null v leaves x alone; rows without frame get null.

    What a chunk does to any x is one affine step (a, b), and what it makes of no x at all is n. These
    are combined over the chunks of a group, so that each chunk then runs from its own entry value.
    """
    keys, order, columns = list(keys), list(order), df.columns
    placed = F.col(order[0]).isNotNull()
    d, by = _chunked(df.filter(placed).withColumns({"__v": value.cast("array<double>"), "__w": weight.cast("double")}), keys, order[0], size)
    item = F.struct(_order_struct(order).alias("o"), F.col("__v").alias("v"), F.col("__w").alias("w"), F.struct(*columns).alias("r"))
    chunks = d.groupBy(*by, _CHUNK).agg(F.sort_array(F.collect_list(item)).alias("items"))

    def mixed(x: Column, i: Column) -> Column:
        both = F.zip_with(x, i["v"], lambda p, q: i["w"] * q + (F.lit(1.0) - i["w"]) * p)
        return F.when(i["v"].isNull(), x).when(x.isNull(), i["v"]).otherwise(both)

    def after(x: Column, e: Column) -> Column:
        return F.when(x.isNull(), e["n"]).when(e["b"].isNull(), x).otherwise(F.zip_with(x, e["b"], lambda p, q: e["a"] * p + q))

    def chained(e: Column, i: Column) -> Column:
        a = F.when(i["v"].isNull(), e["a"]).otherwise((F.lit(1.0) - i["w"]) * e["a"])
        added = F.zip_with(e["b"], i["v"], lambda p, q: i["w"] * q + (F.lit(1.0) - i["w"]) * p)
        b = F.when(i["v"].isNull(), e["b"]).when(e["b"].isNull(), F.transform(i["v"], lambda q: i["w"] * q)).otherwise(added)
        return F.struct(a.alias("a"), b.alias("b"), mixed(e["n"], i).alias("n"))

    none = F.lit(None).cast("array<double>")
    nothing = F.struct(F.lit(1.0).alias("a"), none.alias("b"), none.alias("n"))
    effects = chunks.select(*by, F.struct(F.col(_CHUNK).alias("c"), F.aggregate("items", nothing, chained).alias("e")).alias("e"))
    effects = effects.groupBy(*by).agg(F.sort_array(F.collect_list("e")).alias("es"))
    entries = F.aggregate(
        "es",
        F.struct(none.alias("x"), F.array().cast("array<struct<c:bigint,x:array<double>>>").alias("out")),
        lambda acc, e: F.struct(after(acc["x"], e["e"]).alias("x"), F.array_append(acc["out"], F.struct(e["c"].alias("c"), acc["x"].alias("x"))).alias("out")),
        lambda acc: acc["out"],
    )
    entries = effects.select(*by, F.explode(entries).alias("n")).select(*by, F.col("n.c").alias(_CHUNK), F.col("n.x").alias("__x"))
    run = F.aggregate(
        "items",
        F.struct(F.col("__x").alias("x"), F.array().cast("array<array<double>>").alias("out")),
        lambda acc, i: F.struct(mixed(acc["x"], i).alias("x"), F.array_append(acc["out"], mixed(acc["x"], i)).alias("out")),
        lambda acc: acc["out"],
    )
    rows = chunks.join(entries, [*by, _CHUNK]).select(F.explode(F.arrays_zip(F.col("items"), run.alias("xs"))).alias("z"))
    out = rows.select("z.items.r.*", F.col("z.xs").alias(name))
    return out.unionByName(df.filter(~placed).withColumn(name, none))
