"""Order-dependent operators that do not put one key into one task.

A window partitioned by a key runs the whole key in one task, which fails when a key holds a
third of all rows. Here the rows are range-partitioned on (keys, order), so a hot key spreads
over many chunks; each chunk is scanned on its own and a small per-(key, chunk) summary carries
the state from the chunks before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.session import cut

CHUNK = "_chunk"


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], partitions: int | None = None) -> DataFrame:
    """Range-partition on (keys, order) and name the chunk; materialised so it cannot change."""
    cols = [*keys, *order]
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    return cut(ranged.withColumn(CHUNK, F.spark_partition_id()))


def _inside(keys: Sequence[str], order: Sequence[Column | str]):
    return Window.partitionBy(CHUNK, *keys).orderBy(*order)


def _carry(summary: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """Fold the per-chunk summaries of the chunks before; at most one row per chunk and key."""
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return summary.withColumn(out, value.over(before)).select(*keys, CHUNK, out)


def prefix_sum(c: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, out: str) -> DataFrame:
    """Running sum per key up to and including each row."""
    w = _inside(keys, order)
    local = c.withColumn("_v", value).withColumn("_s", F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    carry = _carry(c.groupBy(*keys, CHUNK).agg(F.sum(value).alias("_t")), keys, F.sum("_t"), "_carried")
    return (
        local.join(carry, [*keys, CHUNK])
        .withColumn(out, F.col("_s") + F.coalesce("_carried", F.lit(0)))
        .drop("_v", "_s", "_carried")
    )


def prefix_max_before(c: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, out: str) -> DataFrame:
    """Largest value among the rows before each row of its key; NULL for the first."""
    w = _inside(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    local = c.withColumn("_v", value).withColumn("_m", F.max("_v").over(w))
    carry = _carry(c.groupBy(*keys, CHUNK).agg(F.max(value).alias("_t")), keys, F.max("_t"), "_carried")
    return (
        local.join(carry, [*keys, CHUNK]).withColumn(out, F.greatest("_m", "_carried")).drop("_v", "_m", "_carried")
    )


def previous(c: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Value of the row before each row of its key; NULL for the first."""
    w = _inside(keys, order)
    local = c.withColumn("_lagged", F.lag(F.struct(F.col(value).alias("v"))).over(w))
    last = c.groupBy(*keys, CHUNK).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_t"))
    step = Window.partitionBy(*keys).orderBy(CHUNK)
    carry = last.withColumn("_carried", F.lag("_t").over(step)).select(*keys, CHUNK, "_carried")
    return (
        local.join(carry, [*keys, CHUNK]).withColumn(out, F.coalesce("_lagged", "_carried")["v"]).drop("_lagged", "_carried")
    )


def last_seen(c: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Last non-NULL value at or before each row of its key."""
    w = _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    local = c.withColumn("_l", F.last(value, ignorenulls=True).over(w))
    newest = F.max_by(F.when(F.col(value).isNotNull(), F.col(value)),
                      F.when(F.col(value).isNotNull(), F.struct(*order)))
    summary = c.groupBy(*keys, CHUNK).agg(newest.alias("_t"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.withColumn("_carried", F.last("_t", ignorenulls=True).over(before)).select(*keys, CHUNK, "_carried")
    return local.join(carry, [*keys, CHUNK]).withColumn(out, F.coalesce("_l", "_carried")).drop("_l", "_carried")


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str = "n") -> DataFrame:
    """Exact ``row_number`` per key (or over everything) without a single-task window."""
    tmp = df if keys else df.withColumn("_all", F.lit(0))
    ks = list(keys) or ["_all"]
    c = chunked(tmp, ks, order)
    local = c.withColumn("_r", F.row_number().over(_inside(ks, order)))
    carry = _carry(c.groupBy(*ks, CHUNK).agg(F.count(F.lit(1)).alias("_t")), ks, F.sum("_t"), "_carried")
    res = local.join(carry, [*ks, CHUNK]).withColumn(out, F.col("_r") + F.coalesce("_carried", F.lit(0)))
    return res.drop("_r", "_carried", CHUNK, "_all")


#: Rows of the cell that holds the cut from which on it is ordered instead of being cut again.
EDGE = 100_000


def smallest(df: DataFrame, n: int, rank: Column, order: Sequence[Column | str], bits: int = 16) -> DataFrame:
    """Exactly the ``n`` rows of lowest (``rank``, ``order``), or all if fewer; ``rank`` is a non-negative BIGINT.

    Radix selection: rows are counted by the next ``bits`` of their rank (at most 2 ** ``bits`` counts), and
    only the cell that holds the cut is looked at again, until it is small or its ranks are all equal.
    Its rows are then numbered over range partitions of (rank, order), so that no task holds them, however
    many ranks are equal. Rows with a NULL rank are never taken.
    """
    c = df.withColumn("_k", rank).filter("_k IS NOT NULL")
    if n <= 0:
        return c.filter("false").drop("_k")
    low, width, left = 0, 63, n
    upto = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        width = max(0, width - bits)
        inside = c.filter(F.col("_k") >= low) if width + bits >= 63 else c.filter(F.col("_k").between(low, low + (1 << (width + bits)) - 1))
        counts = inside.groupBy(F.shiftright(F.col("_k") - low, width).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
        # At most 2 ** bits rows pass through this one window.
        marks = counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        cut_cell = marks.filter((F.col("_before") < left) & (F.col("_before") + F.col("_n") >= left)).first()
        if cut_cell is None:
            return c.drop("_k")
        low += cut_cell["_cell"] << width
        left -= cut_cell["_before"]
        if width == 0 or cut_cell["_n"] <= EDGE:
            break
    top = low + (1 << width) - 1
    whole, edge = c.filter(F.col("_k") < low), c.filter(F.col("_k").between(low, top))
    numbered = ordinal(edge, [], ["_k", *order], "_r").filter(F.col("_r") <= left).drop("_r")
    return whole.unionByName(numbered).drop("_k")
