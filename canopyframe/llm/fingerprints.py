"""Operator 7: document fingerprints by winnowing.

Every run of ``GRAM`` code points is hashed by a rolling polynomial; in every window of ``WINDOW``
such hashes the smallest is kept, the rightmost of equal ones, with its position. Two texts that
share ``GRAM + WINDOW - 1`` code points anywhere share a kept hash. A fingerprint is the hexadecimal
text of its (hash, position) pairs, 32 bits each, in order of position; likeness is the Jaccard
index of the hash sets.

The query also needs each document's successor in descending ``doc_id``. Documents are dealt into
ranges of ``doc_id``; each range's first document is copied to the range before, so that every
document meets its successor in one shuffle without a global window.

Defined results: a NULL or empty text has an empty fingerprint; two empty ones are alike (1.0), an
empty and another are not (0.0). A text shorter than ``GRAM`` is one gram, one with fewer hashes than
a window is one window. Rows with equal ``doc_id`` follow each other by text. A NULL ``doc_id`` has no
place in the order: its successor counts as empty. A single document follows itself. Empty tables
give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.text import _powers_at_least, mix

GRAM, WINDOW = 32, 96
#: Documents of one range, on average.
RANGE_ROWS = 500
#: Code points that one step of a task handles (plus one text).
CHUNK = 1 << 18


def winnow(points: list[np.ndarray], gram: int = GRAM, window: int = WINDOW) -> list[np.ndarray]:
    """For each text (as code points) the kept (hash << 32 | position), in order of position."""
    n = np.fromiter(map(len, points), np.int64, len(points))
    first = np.cumsum(n) - n
    flat = np.concatenate(points).astype(np.uint64) if len(points) and n.sum() else np.zeros(0, np.uint64)
    grams = np.where(n >= gram, n - gram + 1, np.minimum(n, 1))
    up, down = _powers_at_least(max(12, (len(flat) + 1).bit_length()))
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(mix(flat + np.uint64(1)) * up[: len(flat)], out=sums[1:])
    # All grams of all texts, one after the other.
    total = int(grams.sum())
    at_doc = np.cumsum(grams) - grams
    doc = np.repeat(np.arange(len(points)), grams)
    pos = np.arange(total) - at_doc[doc]
    start = first[doc] + pos
    stop = start + np.minimum(gram, n[doc])
    h = mix((sums[stop] - sums[start]) * down[start]) >> np.uint64(32)
    key = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - pos.astype(np.uint64))  # least hash, then rightmost
    wide = 1
    low = key
    while 2 * wide <= window and len(low) > wide:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    out = []
    for i in range(len(points)):
        a, g = int(at_doc[i]), int(grams[i])
        if g == 0:
            out.append(np.zeros(0, np.uint64))
        elif g <= window:
            out.append(key[a : a + g].min(keepdims=True))
        else:
            last = g - window + 1
            m = np.minimum(low[a : a + last], low[a + window - wide : a + window - wide + last])
            out.append(m[np.concatenate([[True], m[1:] != m[:-1]])])
    return [(k & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - (k & np.uint64(0xFFFFFFFF))) for k in out]


def as_text(kept: np.ndarray) -> str:
    return kept.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    x, y = np.unique(a >> np.uint64(32)), np.unique(b >> np.uint64(32))
    if not len(x) and not len(y):
        return 1.0
    at = np.searchsorted(y, x) if len(y) else np.zeros(0, np.int64)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
    return common / (len(x) + len(y) - common)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def dealt(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(part, tail, doc_id, text): ranges of descending ``doc_id``, each followed by its successor (``tail``)."""
    slim = docs.select("doc_id", "text")
    known = slim.filter(F.col("doc_id").isNotNull())
    parts = max(1, min(20_000, docs.count() // range_rows))
    bounds = sorted(set(known.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    cuts = np.array([-b for b in reversed(bounds)])

    @F.pandas_udf("int")
    def part_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, -x.to_numpy(), "left").astype(np.int32))

    numbered = known.withColumn("part", part_of("doc_id"))
    heads = sorted((r["part"], r["head"]) for r in numbered.groupBy("part").agg(F.max("doc_id").alias("head")).collect())
    if not heads:
        placed = numbered.withColumn("tail", F.lit(False))
    else:
        # The first document of a part is also sent to the part before; the very first to the last.
        follow = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
        kind = slim.schema["doc_id"].dataType.simpleString()
        tails = docs.sparkSession.createDataFrame(follow, f"_head {kind}, _before int")
        # At most one row per part.
        copies = numbered.join(F.broadcast(tails), F.col("doc_id") == F.col("_head")).select("doc_id", "text", F.col("_before").alias("part"), F.lit(True).alias("tail"))
        placed = numbered.withColumn("tail", F.lit(False)).unionByName(copies)
    loose = slim.filter(F.col("doc_id").isNull()).select("doc_id", "text", (-1 - F.pmod(F.xxhash64("text"), F.lit(parts))).cast("int").alias("part"), F.lit(False).alias("tail"))
    return placed.unionByName(loose).select("part", "tail", "doc_id", "text").repartition(parts, "part").sortWithinPartitions(
        "part", "tail", F.desc("doc_id"), F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and both likenesses."""

    def flush(rows: list[tuple], follower: tuple | None) -> pa.RecordBatch | None:
        """Results of ``rows``; ``follower`` is the row after the last."""
        texts = [r[3] for r in rows]
        after = texts[1:] + ([follower[3]] if follower else [""])
        nexts = []
        for i, r in enumerate(rows):
            other = rows[i + 1] if i + 1 < len(rows) else follower
            nexts.append(after[i] if r[0] >= 0 and other is not None and other[0] == r[0] else "")
        own = [i for i, r in enumerate(rows) if not r[1]]
        if not own:
            return None
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + nexts[i][: len(texts[i]) // 2] for i in own]
        kept = winnow([_points(texts[i]) for i in own], gram, window)
        new = winnow([_points(t) for t in edited], gram, window)
        coming = winnow([_points(nexts[own[-1]])], gram, window)[0]
        at = {i: k for i, k in zip(own, kept)}
        following = [at[i + 1] if i + 1 in at and nexts[i] == texts[i + 1] else (coming if i == own[-1] else winnow([_points(nexts[i])], gram, window)[0]) for i in own]
        return pa.RecordBatch.from_arrays([
            pa.array([rows[i][2] for i in own], kind), pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
            pa.array(list(map(as_text, kept))), pa.array(list(map(as_text, new))),
            pa.array([likeness(a, b) for a, b in zip(kept, new)]), pa.array([likeness(a, b) for a, b in zip(kept, following)])],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            columns = [b.column(i) for i in range(4)]
            for i in range(b.num_rows):
                row = (columns[0][i].as_py(), columns[1][i].as_py(), columns[2][i].as_py(), columns[3][i].as_py() or "")
                if size > CHUNK:
                    out = flush(held, row)
                    held, size = [], 0
                    if out is not None:
                        yield out
                held.append(row)
                size += len(row[3])
        if held:
            out = flush(held, None)
            if out is not None:
                yield out

    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
    return dealt(docs).mapInArrow(run, schema)
