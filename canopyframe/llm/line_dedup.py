"""Operator 8: drop lines that many documents share.

Two Bloom filters over the hashes of all long lines, one for hashes seen once and one for hashes
seen again, are built per task and merged. Only lines that the second filter knows can be repeats;
they alone are shuffled, counted exactly by their text, and the document that keeps them is chosen.

The filters' size follows the number of rows (``bits_for``) between two fixed bounds, so what is
broadcast is at most 2 x 32 MB; a fuller filter lets more lines through to the exact count and
never changes the result.

Defined results: a NULL or empty text is one empty line. Rows with a NULL ``doc_id`` can neither be
counted nor ranked and stay as they are. Rows that repeat a ``doc_id`` are one document: a line is
counted once for them, and kept or dropped in all of them. Empty tables give empty results. Other
columns are kept untouched, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.text import LOWER, SPACE_CHARS, UPPER, fresh
from canopyframe.session import cut

#: Bits of one filter piece; a piece is what one merging group handles at a time.
PIECE = 1 << 17
MIN_BITS, MAX_BITS = 1 << 22, 1 << 28


def bits_for(rows: int) -> int:
    """About 128 bits a document (some 8 long lines, two bits each, an eighth full)."""
    wanted = max(1, rows) * 128
    return min(MAX_BITS, max(MIN_BITS, 1 << (wanted - 1).bit_length()))


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), UPPER, LOWER)


def _lines(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.explode(F.split(text, "\n")).alias("line")).select(
        "doc_id", F.btrim("line", F.lit(SPACE_CHARS)).alias("line"))


def _hashed(lines: DataFrame, min_chars: int) -> DataFrame:
    # Lower-casing all letters can only join more keys, so no repeat is missed.
    return lines.filter(F.char_length("line") >= min_chars).withColumn("h", F.xxhash64(F.lower("line")))


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = h.view(np.uint64) if h.dtype == np.int64 else h.astype(np.int64).view(np.uint64)
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def pack_table(table: np.ndarray) -> bytes:
    return zlib.compress(table.tobytes(), 1)


def partial_filters(hashes: DataFrame, bits: int) -> DataFrame:
    """(piece, once, twice): the two filters of each task, without empty pieces."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        any_row = False
        for b in batches:
            h = np.sort(b.column(0).to_numpy(zero_copy_only=False))
            if not len(h):
                continue
            any_row = True
            new = np.concatenate([[True], h[1:] != h[:-1]])
            u = h[new]
            again = np.diff(np.concatenate([np.flatnonzero(new), [len(h)]])) > 1
            p, q = _places(u, bits)
            seen = (once[p >> 3] >> (p & 7)) & (once[q >> 3] >> (q & 7)) & 1
            again |= seen.astype(bool)
            for x in (p, q):
                np.bitwise_or.at(twice, x[again] >> 3, np.left_shift(1, x[again] & 7).astype(np.uint8))
                np.bitwise_or.at(once, x >> 3, np.left_shift(1, x & 7).astype(np.uint8))
        if not any_row:
            return
        step = PIECE // 8
        for i in range(bits // PIECE):
            part = once[i * step : (i + 1) * step]
            if part.any():
                yield pa.RecordBatch.from_pydict({
                    "piece": pa.array([i], pa.int32()), "once": pa.array([pack_table(part)], pa.binary()),
                    "twice": pa.array([pack_table(twice[i * step : (i + 1) * step])], pa.binary())})

    return hashes.select("h").mapInArrow(build, "piece int, once binary, twice binary")


def _merge(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
    once, twice = np.zeros(PIECE // 8, np.uint8), np.zeros(PIECE // 8, np.uint8)
    for a, b in zip(part["once"], part["twice"]):
        a, b = np.frombuffer(zlib.decompress(a), np.uint8), np.frombuffer(zlib.decompress(b), np.uint8)
        twice |= b | (once & a)
        once |= a
    return pd.DataFrame({"piece": [key[0]], "once": [pack_table(once)], "twice": [pack_table(twice)]})


def merged_table(parts: DataFrame, bits: int) -> np.ndarray:
    """The filter of places seen again, ``bits`` / 8 bytes, from (piece, once, twice) rows, merged in two steps."""
    schema = "piece int, once binary, twice binary"
    some = parts.withColumn("_some", F.expr("cast(rand(7) * 64 as int)")).groupBy("piece", "_some").applyInPandas(_merge, schema)
    whole = some.groupBy("piece").applyInPandas(_merge, schema).select("piece", "twice")
    table = np.zeros(bits // 8, np.uint8)
    for r in whole.toLocalIterator():
        table[r.piece * (PIECE // 8) : (r.piece + 1) * (PIECE // 8)] = np.frombuffer(zlib.decompress(r.twice), np.uint8)
    return table


def seen_again(hashes: DataFrame, bits: int) -> np.ndarray:
    """The filter of hashes that occur more than once."""
    return merged_table(partial_filters(hashes, bits), bits)


def shared_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, salts: int = 16) -> DataFrame:
    """(doc_id, keys): the keys that each document loses."""
    spark = docs.sparkSession
    hashed = _hashed(_lines(docs.select("doc_id", "text")), min_chars)
    bits = bits_for(docs.count())
    table = spark.sparkContext.broadcast(seen_again(hashed, bits))

    @F.pandas_udf("boolean")
    def suspected(h: pd.Series) -> pd.Series:
        p, q = _places(h.to_numpy(), bits)
        t = table.value
        return pd.Series(((t[p >> 3] >> (p & 7)) & (t[q >> 3] >> (q & 7)) & 1).astype(bool))

    # Read twice below, so found once.
    suspects = cut(hashed.filter(suspected("h")).select("doc_id", F.translate("line", UPPER, LOWER).alias("key")).distinct())
    frequent = (
        suspects.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n") >= min_docs).select("key", "keeper", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    # A line of a third of all documents is spread over the salts.
    return (
        suspects.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        .join(frequent, ["key", "salt"]).filter(F.col("doc_id") != F.col("keeper"))
        .groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    )


def drop_shared_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, n_lines: str | None = None,
                      n_dropped: str | None = None) -> DataFrame:
    """``docs`` with ``text`` rebuilt from the lines that stay (joined by a line feed).

    ``n_lines`` and ``n_dropped`` name optional extra columns: lines before, and lines dropped.
    """
    keys, parts, left = (fresh(docs, c) for c in ("_ld_keys", "_ld_lines", "_ld_left"))
    other = fresh(docs, "_ld_doc")
    lost = shared_lines(docs, min_docs, min_chars).select(F.col("doc_id").alias(other), F.col("keys").alias(keys))
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.join(lost, F.col("doc_id") == F.col(other), "left").drop(other)
    stays = F.filter(parts, lambda x: ~F.array_contains(F.col(keys), line_key(x)))
    out = out.withColumn(parts, F.split(text, "\n"))
    out = out.withColumn(left, F.when(F.col(keys).isNotNull(), stays))
    shown = []
    for c in docs.columns:
        shown.append(F.when(F.col(keys).isNull(), F.col(c)).otherwise(F.array_join(left, "\n")).alias(c) if c == "text" else F.col(c))
    if n_lines:
        shown.append(F.size(parts).cast("bigint").alias(n_lines))
    if n_dropped:
        shown.append(F.when(F.col(keys).isNull(), F.lit(0)).otherwise(F.size(parts) - F.size(left)).cast("bigint").alias(n_dropped))
    return out.select(*shown)
