"""Exact percentiles (linear interpolation) that never gather a group.

The value axis is cut twice: into cells of the binary logarithm (a fixed, data-independent and
monotone mapping) and then each cell that holds a wanted rank into equal slices. Counts per cell
are combined map-side, so only a few thousand rows per group are shuffled; raw values are touched
only inside the slices that hold a wanted rank, and there they are counted per distinct value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.session import broadcast_if_small, cut

PER_OCTAVE = 64
FLOOR_EXP = -40
SLICES = 4096
SMALL_CELL = 200_000
MAX_BROADCAST_ROWS = 200_000


def _cell(v: Column) -> Column:
    """Monotone cell number: 0 near zero, growing with the logarithm on both sides; infinities have their own."""
    size = F.greatest(F.abs(v), F.lit(2.0**FLOOR_EXP))
    finite = F.floor((F.log2(F.least(size, F.lit(2.0**1023))) - FLOOR_EXP) * PER_OCTAVE)
    steps = F.when(size == float("inf"), F.lit((1026 - FLOOR_EXP) * PER_OCTAVE)).otherwise(finite)
    return F.when(v < 0, -steps - 1).otherwise(steps).cast("int")


def _slice(v: Column) -> Column:
    wide = F.col("_max") > F.col("_min")
    pos = F.floor((v - F.col("_min")) / F.when(wide, F.col("_max") - F.col("_min")) * SLICES)
    return F.coalesce(F.least(F.lit(SLICES - 1), pos), F.lit(0)).cast("int")


def _wanted(counts: DataFrame, keys: list[str], part: str, offset: Column, ranks: str) -> DataFrame:
    """Keep the parts that hold a wanted rank, with the rank they start at."""
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    c = counts.withColumn("_from", offset + F.coalesce(F.sum("_n").over(before), F.lit(0)))
    hit = F.exists(ranks, lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_n")))
    return c.filter(hit)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """One row per key: ``n`` and ``q0, q1, ...`` for the given fractions; NULL and NaN are ignored."""
    ks = list(keys)
    base = df.select(*ks, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    base = base.withColumn("_cell", _cell(F.col("_v")))
    cells = base.groupBy(*ks, "_cell").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    total = F.sum("_n").over(Window.partitionBy(*ks))
    cells = cells.withColumn("_total", total)
    at = [F.lit(float(p)) * (F.col("_total") - 1) for p in probs]
    ranks = F.array_distinct(F.array(*[f for a in at for f in (F.floor(a), F.ceil(a))]).cast("array<bigint>"))
    cells = cells.withColumn("_ranks", ranks)
    need1 = _wanted(cells, ks, "_cell", F.lit(0), "_ranks")
    # At most two cells per fraction and key.
    need1 = cut(need1.select(*ks, "_cell", "_min", "_max", "_n", F.col("_from").alias("_start"), "_total", "_ranks"))
    size = need1.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max("_n"), F.lit(0)).alias("biggest")).first()
    need1 = need1.drop("_n")
    if size.rows <= MAX_BROADCAST_ROWS:
        need1 = F.broadcast(need1)
    if size.biggest <= SMALL_CELL:
        # No cell is large: its values can be ordered directly.
        rows = base.join(need1, [*ks, "_cell"])
        values = rows.groupBy(*ks, "_cell", "_v").agg(
            F.count(F.lit(1)).alias("_n"), F.first("_start").alias("_start"), F.first("_total").alias("_total"), F.first("_ranks").alias("_ranks"))
        found = _wanted(values, [*ks, "_cell"], "_v", F.col("_start"), "_ranks")
        return _interpolate(found.select(*ks, "_total", "_ranks", "_from", "_n", "_v"), ks, probs)

    inner = base.join(need1, [*ks, "_cell"]).withColumn("_slice", _slice(F.col("_v")))
    slices = inner.groupBy(*ks, "_cell", "_slice").agg(
        F.count(F.lit(1)).alias("_n"), F.first("_start").alias("_start"), F.first("_ranks").alias("_ranks"),
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    need2 = _wanted(slices, [*ks, "_cell"], "_slice", F.col("_start"), "_ranks")
    need2 = broadcast_if_small(need2.select(*ks, "_cell", "_slice", F.col("_from").alias("_start2"), F.col("_n").alias("_n2"), "_lo", "_hi"))

    # A slice with one distinct value needs no further look at the data.
    flat = need2.filter(F.col("_lo") == F.col("_hi")).join(
        need1.select(*ks, "_cell", "_total", "_ranks"), [*ks, "_cell"]
    ).select(*ks, "_total", "_ranks", F.col("_start2").alias("_from"), F.col("_n2").alias("_n"), F.col("_lo").alias("_v"))
    deep = inner.join(need2.filter(F.col("_lo") < F.col("_hi")).select(*ks, "_cell", "_slice", "_start2"), [*ks, "_cell", "_slice"])
    values = deep.groupBy(*ks, "_cell", "_slice", "_v").agg(
        F.count(F.lit(1)).alias("_n"), F.first("_start2").alias("_start2"),
        F.first("_total").alias("_total"), F.first("_ranks").alias("_ranks"))
    found = _wanted(values, [*ks, "_cell", "_slice"], "_v", F.col("_start2"), "_ranks")
    found = found.select(*ks, "_total", "_ranks", "_from", "_n", "_v").unionByName(flat)
    return _interpolate(found, ks, probs)


def _interpolate(found: DataFrame, ks: list[str], probs: Sequence[float]) -> DataFrame:
    # A few rows per key are left: pick each fraction's two neighbours and interpolate.
    def value_at(rank: Column) -> Column:
        inside = (rank >= F.col("_from")) & (rank < F.col("_from") + F.col("_n"))
        return F.max(F.when(inside, F.col("_v")))

    picks = []
    for i, p in enumerate(probs):
        a = F.lit(float(p)) * (F.col("_total") - 1)
        picks += [value_at(F.floor(a)).alias(f"_a{i}"), value_at(F.ceil(a)).alias(f"_b{i}")]
    out = found.groupBy(*ks).agg(F.max("_total").alias("n"), *picks)
    res = []
    for i, p in enumerate(probs):
        a = F.lit(float(p)) * (F.col("n") - 1)
        frac = a - F.floor(a)
        low, high = F.col(f"_a{i}"), F.col(f"_b{i}")
        # Equal neighbours need no step, which between infinities would be undefined.
        res.append(F.when(low == high, low).otherwise(low + (high - low) * frac).alias(f"q{i}"))
    return out.select(*ks, "n", *res)
