"""Operator 1: URL filters with a Bloom filter cascade.

Level 0 encodes the listed keys; level 1 the keys of the corpus that level 0 wrongly lets pass;
level 2 the listed keys that level 1 wrongly lets pass; and so on until no key is wrong. A key of
the universe the cascade was built for is then judged exactly by walking the levels, without a join:
the first level that does not know it decides. Rules given as ``host/path`` text come before.

The cascade takes about 1.5 bits per level and encoded key; ``MAX_BITS`` bounds what is broadcast. A
longer list is split into shards by hash, each with a cascade of its own that is built and asked
alone, so any length is handled exactly, one pass per shard.

Defined results: a NULL url, or one without ``://``, has an empty host and path. Repeated rows get
equal verdicts. An empty list blocks nothing; empty tables give empty results. Rules of equal length
are taken in the given order. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.text import LOWER, UPPER, mix
from canopyframe.session import cut

#: Bits of all levels of one shard's cascade: 64 MB.
MAX_BITS = 1 << 29


def host_path(url: Column) -> tuple[Column, Column]:
    """Lower-case host and path of a url column, empty where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; NULL where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, say in sorted(reversed(rules), key=lambda r: len(r[0])):  # longer rules, then earlier ones, wrap the others
        of_host, slash, of_path = text.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(slash + of_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def _positions(a: np.ndarray, b: np.ndarray, level: int, hashes: int, bits: int) -> np.ndarray:
    """Bit positions of keys (given by two 64-bit hashes): one row per hash function."""
    a = mix(a.astype(np.int64).view(np.uint64) + np.uint64(level))
    b = b.astype(np.int64).view(np.uint64) | np.uint64(1)
    return np.stack([(mix(a + np.uint64(i) * b) % np.uint64(bits)).astype(np.int64) for i in range(hashes)])


def _holds(table: np.ndarray, p: np.ndarray) -> np.ndarray:
    return ((table[p >> 3] >> (p & 7)) & 1).astype(bool).all(axis=0)


class Cascade:
    """Levels of (bit table, bits, hash functions); a key is listed if the walk ends on an even level."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, int, int]] = []

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        alive = np.arange(len(a))
        for level, (table, bits, hashes) in enumerate(self.levels):
            alive = alive[_holds(table, _positions(a[alive], b[alive], level, hashes, bits))]
            out[alive] = level % 2 == 0
        return out


def with_hashes(df: DataFrame, key: str, first: str = "_h1", second: str = "_h2") -> DataFrame:
    return df.withColumn(first, F.xxhash64(F.lit(1), F.col(key))).withColumn(second, F.xxhash64(F.lit(2), F.col(key)))


def _level(keys: DataFrame, level: int, hashes: int, bits: int) -> np.ndarray:
    """The bit table of one level: tasks report set words, Spark combines them."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.unique(_positions(b.column(0).to_numpy(), b.column(1).to_numpy(), level, hashes, bits))
            if len(p):
                w, first = np.unique(p >> 6, return_index=True)
                v = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (p & 63).astype(np.uint64)), first)
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(v.view(np.int64))], ["w", "v"])

    table = np.zeros(-(-bits // 64), np.int64)
    merged = keys.select("_h1", "_h2").mapInArrow(words, "w bigint, v bigint").groupBy("w").agg(F.bit_or("v").alias("v"))
    for r in merged.toLocalIterator():  # as many rows as the level has words
        table[r["w"]] = r["v"]
    return table.view(np.uint8)


def _passing(shared: Broadcast, level: int, hashes: int, bits: int):
    @F.pandas_udf("boolean")
    def passes(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_holds(shared.value, _positions(a.to_numpy(), b.to_numpy(), level, hashes, bits)))

    return passes


def _asking(shared: Broadcast):
    @F.pandas_udf("boolean")
    def listed(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(shared.value.listed(a.to_numpy(), b.to_numpy()))

    return listed


def build_cascade(keys: DataFrame) -> Cascade:
    """Cascade over ``keys(_h1, _h2, listed)``, the whole universe, each key once."""
    cascade = Cascade()
    spark = keys.sparkSession
    inside, outside = keys.filter("listed"), keys.filter("not listed")
    n_in, n_out = inside.count(), outside.count()
    level = 0
    while n_in:
        rate = min(0.5, n_in * math.sqrt(0.5) / n_out) if level == 0 and n_out else 0.5
        hashes = max(1, round(-math.log2(rate)))
        bits = max(64, int(math.ceil(n_in * hashes / math.log(2))))
        table = _level(inside, level, hashes, bits)
        cascade.levels.append((table, bits, hashes))
        shared = spark.sparkContext.broadcast(table)
        wrong = cut(outside.filter(_passing(shared, level, hashes, bits)("_h1", "_h2")))
        inside, outside = wrong, inside
        n_in, n_out = wrong.count(), n_in
        level += 1
    return cascade


def listed_keys(df: DataFrame, key: str, universe: DataFrame, out: str, max_bits: int = MAX_BITS) -> DataFrame:
    """Adds boolean ``out``: whether ``key`` is listed. ``universe(key, listed)`` holds every key of ``df``."""
    whole = universe.groupBy(F.col("key")).agg(F.max("listed").alias("listed"))
    hashed = cut(with_hashes(whole, "key").select("_h1", "_h2", "listed"))
    # Level 0 takes at most log2(n_out / n_in) + 1 hash functions; 64 bits a key is above every case.
    shards = max(1, math.ceil(hashed.filter("listed").count() * 64 / max_bits))
    out_df = with_hashes(df, key, "_uf_1", "_uf_2").withColumn(out, F.lit(False))
    for shard in range(shards):
        mine = lambda c, shard=shard: F.pmod(F.col(c), F.lit(shards)) == shard
        cascade = build_cascade(hashed if shards == 1 else hashed.filter(mine("_h1")))
        ask = _asking(df.sparkSession.sparkContext.broadcast(cascade))
        out_df = out_df.withColumn(out, F.when(mine("_uf_1"), ask("_uf_1", "_uf_2")).otherwise(F.col(out)))
    return out_df.drop("_uf_1", "_uf_2")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], universe: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; ``universe(key, listed)`` names blocked hosts."""
    host, path = host_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    asked = listed_keys(parts, "host", universe, "_listed")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("_listed"), "block").otherwise("allow")
    return asked.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))
