"""Session helpers: builder for tests and benches, and the shared checkpoint folder."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("canopyframe")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only a ``local`` master without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="canopyframe-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing refers to; they stay until the driver collects its garbage."""
    gc.collect()
    for pause in (0.3, 0):  # what the first finds is let go of by other threads
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as compressed columns in the checkpoint folder, which go when the block ends; its shuffle files go at once."""
    spark, schema = df.sparkSession, df.schema
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    del df
    release(spark)
    try:
        yield spark.read.schema(schema).parquet(path)
    finally:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows to all tasks (by ``keys``, else evenly) before each is blown up.

    With their number given, few and small partitions are not put together again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Checkpoint a side table and hint a broadcast only when its counted rows and measured bytes allow it.

    Beyond either bound the side is returned without a hint and Spark shuffles it.
    """
    side = cut(df)
    if side.count() > max_rows:
        return side
    size = side.agg(F.sum(F.length(F.to_json(F.struct("*"))).cast("bigint"))).first()[0]
    return F.broadcast(side) if (size or 0) <= max_bytes else side
