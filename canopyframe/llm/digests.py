"""SHA-256 of a group's values joined in order, with constant memory in every task.

SHA-256 reads its input in sequence, so one task must see the bytes of one digest. The rows of a
group first spread over range partitions, which join neighbours into strings of bounded size; the
last step streams these few strings through the hash. No task ever holds a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Characters that neighbours are joined up to.
CHARS = 1 << 16


def joined_sha256(df: DataFrame, key: str, order: str, value: str, separator: str, out: str) -> DataFrame:
    """(``key``, ``out``): lowercase hex SHA-256 of each key's strings joined in ``order`` (unique in a key).

    Groups are by equal keys, NULL being one of them; NULL strings count as empty. No rows, no groups.
    """
    kinds = [df.schema[c].dataType for c in (key, order)]
    arrow = [to_arrow_type(k) for k in kinds]
    names = ["k", "o", "v"]

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: tuple[list, list, list] = ([], [], [])
            at = 0
            keys, orders, values = (b.column(i).to_pylist() for i in range(3))
            for k, run in groupby(keys):
                end = at + sum(1 for _ in run)
                while at < end:
                    stop, size = at, 0
                    while stop < end and size < CHARS:
                        size += len(values[stop] or "")
                        stop += 1
                    rows[0].append(k)
                    rows[1].append(orders[at])
                    rows[2].append(separator.join(v or "" for v in values[at:stop]))
                    at = stop
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], arrow[0]), pa.array(rows[1], arrow[1]), pa.array(rows[2], pa.string())], names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held = None, None
        for b in batches:
            done: list[tuple] = []
            for k, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if state is not None and k == held:
                    state.update(separator.encode())
                else:
                    if state is not None:
                        done.append((held, state.hexdigest()))
                    state, held = hashlib.sha256(), k
                state.update(v.encode("utf-8", "surrogatepass"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], arrow[0]), pa.array([d[1] for d in done])], names[:2])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], arrow[0]), pa.array([state.hexdigest()])], names[:2])

    slim = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).alias("v"))
    fields = f"k {kinds[0].simpleString()}, o {kinds[1].simpleString()}"
    chunks = slim.repartitionByRange("k", "o").sortWithinPartitions("k", "o").mapInArrow(chunk, f"{fields}, v string")
    found = chunks.repartition("k").sortWithinPartitions("k", "o").mapInArrow(digest, f"k {kinds[0].simpleString()}, d string")
    return found.select(F.col("k").alias(key), F.col("d").alias(out))
