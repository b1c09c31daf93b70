"""Operator 10: mix sources to target weights by Poisson replication.

Every source has a target repetition rate (target size over available size). A document's copies
are drawn by inverting the Poisson distribution of that mean at a uniform number hashed from a seed
and the document's key; the row is exploded by its count, and all rows are shuffled by a second
hash, so that each output partition is an even mixture in random order. A rate above ``STEP`` is drawn
as the sum of independent draws of equal rates of at most ``STEP``, which has the same distribution.

Defined results: NULL sources are one source of their own. Rows that repeat a key draw the same count.
Rows with a NULL key draw by a hash of their text instead, so that each text draws on its own; only
rows equal in both share a draw. Places are hashed from key, text and copy number, so that neither NULL
nor repeated keys gather in a partition. NULL or empty texts have size 0; a source of size 0 has rate 0. Sources without a rate are
left out (rate 0). Empty tables give empty results. Other columns are kept untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.text import fresh
from canopyframe.session import broadcast_if_small

#: The highest rate of one draw.
STEP = 64.0
#: Rates above this are taken for a mistake. Those of ``temperature_rates`` with exponent 0.7 and one epoch are
#: at most (all characters) ** 0.3, which is below it for every size that a bigint holds.
MAX_RATE = float(1 << 19)


def row_key(docs: DataFrame, key: str) -> Column:
    """The key as text, or a hash of the row's text where it is NULL."""
    text = F.coalesce("text", F.lit("")) if "text" in docs.columns else F.lit("")
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("~"), F.md5(text)))


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest."""
    parts = [F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("~")) for k in key]]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def temperature_rates(docs: DataFrame, exponent: float = 0.7, epochs: float = 1.0) -> DataFrame:
    """(source, rate): target weight proportional to size ** exponent, total size ``epochs`` times the input."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint")).alias("size"))
    weighed = sizes.withColumn("w", F.pow(F.col("size").cast("double"), F.lit(exponent)))
    # One row of totals.
    total = weighed.agg(F.sum("size").alias("all_size"), F.sum("w").alias("all_w"))
    share = weighed.join(F.broadcast(total), F.lit(True))
    rate = epochs * F.col("all_size").cast("double") * (F.col("w") / F.col("all_w")) / F.col("size")
    return share.select("source", F.when(F.col("size") > 0, rate).otherwise(F.lit(0.0)).alias("rate"))


def with_cdf(rates: DataFrame) -> DataFrame:
    """Adds ``draws``, the number of draws, and ``cdf``: one draw's P(X <= k) for k = 0, 1, ... until it no
    longer grows (mean + 12 deviations + 20)."""
    bad = F.raise_error(F.lit(f"a repetition rate is negative, not a number or above {MAX_RATE}"))
    ok = (F.col("rate") >= 0) & (F.col("rate") <= MAX_RATE)
    checked = rates.withColumn("rate", F.when(ok, F.col("rate")).otherwise(bad.cast("double")))
    counted = checked.withColumn("draws", F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int")).withColumn("part", F.col("rate") / F.col("draws"))
    return counted.withColumn("cdf", F.expr("""
        aggregate(sequence(1, cast(ceil(part + 12 * sqrt(part) + 20) as int)),
          named_struct('p', exp(-part), 'c', exp(-part), 'all', array(exp(-part))),
          (s, k) -> named_struct('p', s.p * part / k, 'c', s.c + s.p * part / k, 'all', array_append(s.all, s.c + s.p * part / k)),
          s -> s.all)""")).drop("part")


def poisson_count(cdf: Column, u: Column) -> Column:
    """The smallest k with CDF(k) > u."""
    return F.size(F.filter(cdf, lambda c: c <= u))


def replicate(docs: DataFrame, rates: DataFrame, key: str = "doc_id", seed: int = 17, copy: str | None = None,
              place: str | None = None) -> DataFrame:
    """Rows of ``docs``, each repeated by its draw, in global random order.

    ``copy`` (from 0) and ``place`` (the hash that rows are ordered by inside a partition) name
    optional extra columns.
    """
    src, cdf, m, n, c, p = (fresh(docs, x) for x in ("_mx_source", "_mx_cdf", "_mx_draws", "_mx_n", "_mx_copy", "_mx_place"))
    table = broadcast_if_small(with_cdf(rates).select(F.col("source").alias(src), F.col("cdf").alias(cdf), F.col("draws").alias(m)), 10_000)
    own = row_key(docs, key)
    more = F.transform(F.sequence(F.lit(1), F.col(m) - 1), lambda i: uniform(seed, own, i))
    rest = F.aggregate(more, F.lit(0), lambda s, u: s + poisson_count(F.col(cdf), u))
    count = poisson_count(F.col(cdf), uniform(seed, own)) + F.when(F.col(m) > 1, rest).otherwise(0)
    drawn = docs.join(table, F.col("source").eqNullSafe(F.col(src))).withColumn(n, count)
    copies = drawn.filter(F.col(n) > 0).withColumn(c, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    placed = copies.withColumn(p, F.xxhash64(F.lit(seed), own, *([F.col("text")] if "text" in docs.columns else []), F.col(c)))
    extra = [F.col(a).alias(b) for a, b in ((c, copy), (p, place)) if b]
    kept = placed.select(*docs.columns, c, p, *extra)
    return kept.repartition(F.col(p), F.col(c)).sortWithinPartitions(p).drop(c, p)
