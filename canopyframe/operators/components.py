"""Connected components of an edge list by rounds of randomised contraction.

In every round each node picks, among itself and its neighbours, the one with the smallest hash,
and the edges are rewritten to the picks. Whatever the shape of the graph (chains and stars
included) the expected number of nodes falls by a constant factor per round, so the rounds grow
with the logarithm of the size (the contraction idea of Bogeholz, Brand and Todor, "In-database
connected component analysis"). A round is written to the checkpoint folder; the driver only
learns how many edges are left. Once they are at most ``SMALL`` (a few megabytes, whatever the size of
the input), one task merges the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from canopyframe.session import cut


def _canonical(e: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return e.filter(a != b).select(
        F.when(a < b, a).otherwise(b).alias("a"), F.when(a < b, b).otherwise(a).alias("b")).distinct()


#: Edges that one task may merge: 16 bytes each.
SMALL = 100_000


def _merged(e: DataFrame) -> DataFrame:
    """(node, root) of at most ``SMALL`` edges by union-find; the root is the smallest node.

    Nodes may be structs; they compare field by field.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        value: dict = {}

        def key(x):
            k = tuple(x.values()) if isinstance(x, dict) else x
            value.setdefault(k, x)
            parent.setdefault(k, k)
            return k

        def find(k):
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        kind = None
        for part in parts:
            kind = part.schema.field(0).type
            for x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                a, b = find(key(x)), find(key(y))
                if a != b:
                    parent[max(a, b)] = min(a, b)
        if parent:
            nodes = list(parent)
            yield pa.RecordBatch.from_arrays([
                pa.array([value[k] for k in nodes], kind), pa.array([value[find(k)] for k in nodes], kind)], ["node", "root"])

    kind = e.schema["a"].dataType
    return e.select("a", "b").repartition(1).mapInArrow(run, StructType([StructField("node", kind), StructField("root", kind)]))


def connected(edges: DataFrame, max_rounds: int = 80, small: int = SMALL) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; the root is the smallest node it reaches."""
    e = cut(_canonical(edges))
    left = e.count()
    if left <= small:
        return _merged(e)
    nodes = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()
    labels = nodes.withColumn("root", F.col("node"))
    for turn in range(max_rounds):
        if left <= small:
            last = _merged(e).select(F.col("node").alias("root"), F.col("root").alias("_to"))
            labels = labels.join(last, "root", "left").withColumn("root", F.coalesce("_to", "root")).drop("_to")
            # Picks are arbitrary members; name each component by its smallest node.
            names = labels.groupBy("root").agg(F.min("node").alias("_name"))
            return labels.join(names, "root").select("node", F.col("_name").alias("root"))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        mark = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        pick = both.groupBy("a").agg(F.min(mark("b")).alias("_best")).select(
            F.col("a").alias("_from"), F.least(mark("a"), F.col("_best"))["n"].alias("_to"))
        pick = cut(pick)

        def moved(df: DataFrame, column: str, pick: DataFrame = pick) -> DataFrame:
            p = pick.withColumnRenamed("_from", column)
            return df.join(p, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")

        labels = cut(moved(labels, "root"))
        e = cut(_canonical(moved(moved(e, "a"), "b")))
        left = e.count()
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
