"""Job-event streams: parsing, followers, throttling, cancellation, rate windows, auto-scoring.

The stateful rules run in micro-batches: each trigger hands its events, the events still waiting and
one small state row per job to a batch rule, which orders them as a whole. Nothing depends on how
rows are cut into chunks or files, and a job that owns most events is spread by the ordered scans.
Events wait until the newest one seen is ``delay_s`` younger, so disorder of up to that much across
files is put right; older ones that come later are stale. Every trigger writes its output, state and
waiting events under its own number and overwrites them on a replay. State of jobs that have been
silent for ``ttl_s`` (event time) expires.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyframe.operators import events as EV
from canopyframe.operators import ordered as O
from canopyframe.session import ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Terminal event kinds, throttle steps, silence and timeout, seconds.
TERMINAL = EV.TERMINAL
MIN_INTERVAL_S, MIN_STEP = 0.5, 0.02
SILENCE_S, STREAM_TIMEOUT_S, CANCEL_TTL_S = 15, 3600, 3600

PAYLOAD = "job_id string, status string, progress double, step string, timestamp timestamp"
ORDER = ["us", "event_id"]
DAY_S = 86400.0


def read_job_events(stream: DataFrame, text: str = "value") -> DataFrame:
    """Parse ``{"event": kind, "data": {...}}`` messages of a text or Kafka stream."""
    m = F.from_json(F.col(text).cast("string"), f"event string, data struct<{PAYLOAD.replace(' ', ':').replace(',:', ',')}>")
    return stream.select(m.alias("m")).select(F.col("m.event").alias("kind"), "m.data.*").filter(F.col("job_id").isNotNull())


def format_message(kind: str = "kind") -> Any:
    """The message text of an event row, the inverse of ``read_job_events``."""
    data = F.struct("job_id", "status", "progress", "step", "timestamp")
    return F.to_json(F.struct(F.col(kind).alias("event"), data.alias("data")))


@dataclass
class Rule:
    """A batch rule: ``step(events, state, now_us) -> (output, new state)`` and the state's columns.

    ``now_us`` is the clock in microseconds where keep-alives are wanted, else None.
    """

    step: Callable[[DataFrame, DataFrame, int | None], tuple[DataFrame, DataFrame]]
    state: str


# ------------------------------------------------------------------ rules

FOLLOW_STATE = "job_id bigint, event_id bigint, us bigint, kind string, status string, progress double, done boolean, heard_us bigint, beats bigint"


def follower(keep_alive: bool = False) -> Rule:
    """Snapshot first, then only status changes or higher progress; silent after a terminal event.

    With ``keep_alive`` every trigger also emits the keep-alives due since a job was last heard, one
    per silence, up to the stream timeout (``event_id`` -1).
    """

    def step(events: DataFrame, state: DataFrame, now_us: int | None) -> tuple[DataFrame, DataFrame]:
        cols = ["job_id", "event_id", "us", "kind", "status", "progress"]
        done = state.filter("done").select("job_id")
        # The state row stands before the new events as the last one handled.
        old = state.filter("not done").select(*cols, F.lit(True).alias("_old"))
        fresh = events.select(*cols).join(done, "job_id", "left_anti").withColumn("_old", F.lit(False))
        c = O.chunked(old.unionByName(fresh), ["job_id"], ORDER)
        c = EV.until_terminal(c)
        c = EV.scan_changes(c)
        out = c.filter(EV.passed_on() & ~F.col("_old")).select("job_id", "event_id", "kind", "status", "progress")
        last = F.struct(F.col("event_id"), F.col("us"), F.col("kind"), F.col("status"), F.greatest("progress", "_top").alias("progress"))
        heard = c.groupBy("job_id").agg(
            F.max_by(last, F.struct(*ORDER)).alias("s"), F.max(F.col("kind").isin(*TERMINAL) & ~F.col("_old")).alias("done"), F.max(~F.col("_old")).alias("_new"))
        before = state.select("job_id", F.col("heard_us").alias("_h"), F.col("beats").alias("_b"))
        clock = F.lit(now_us).cast("bigint") if now_us is not None else F.col("s.us")
        new = heard.join(before, "job_id", "left").select(
            "job_id", "s.*", "done", F.when(F.col("_new"), clock).otherwise(F.col("_h")).alias("heard_us"),
            F.when(F.col("_new"), F.lit(0)).otherwise(F.col("_b")).cast("bigint").alias("beats"))
        if keep_alive and now_us is not None:
            silence = SILENCE_S * 1_000_000
            due = F.least(F.lit(STREAM_TIMEOUT_S // SILENCE_S), F.floor((F.lit(now_us) - F.col("heard_us")) / silence)).cast("bigint")
            timed = new.withColumn("_due", F.when(F.col("done"), F.col("beats")).otherwise(F.greatest(due, F.col("beats"))))
            beats = timed.filter("_due > beats").withColumn("_n", F.explode(F.expr("sequence(beats + 1, _due)")))
            out = out.unionByName(beats.select("job_id", F.lit(-1).cast("bigint").alias("event_id"), F.lit("keep-alive").alias("kind"), "status", "progress"))
            new = timed.withColumn("beats", F.col("_due")).drop("_due")
        return out, new.select(*[x.split()[0] for x in FOLLOW_STATE.split(", ")]).unionByName(state.filter("done"))

    return Rule(step, FOLLOW_STATE)


THROTTLE_STATE = "job_id bigint, us bigint, event_id bigint, progress double"


def throttle(min_interval_s: float = MIN_INTERVAL_S, min_step: float = MIN_STEP) -> Rule:
    """Drop an update that is both too soon and too small since the last one passed on.

    ``forced`` rows always pass; progress is clamped to [0, 1]. Each decision needs the one before, so
    a job's events are read in order by one task, as a stream of sorted batches with one row of memory.
    """
    gap = min_interval_s * 1e6

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, us, top = None, float("-inf"), 0.0
        for pdf in parts:
            keep = []
            for e in pdf.itertuples(index=False):
                if e.job_id != job:
                    job, us, top = e.job_id, float("-inf"), 0.0
                if e.old:  # the state row
                    us, top = float(e.us), float(e.progress)
                    keep.append(True)
                    continue
                p = min(max(float(e.progress), 0.0), 1.0)
                passes = bool(e.forced) or e.us - us >= gap or p - top >= min_step
                if passes:
                    us, top = float(e.us), p
                keep.append(passes)
            pdf = pdf[keep]
            yield pdf.assign(progress=pdf["progress"].clip(0.0, 1.0))

    def step(events: DataFrame, state: DataFrame, now_us: int | None) -> tuple[DataFrame, DataFrame]:
        cols = ["job_id", "event_id", "us", "kind", "status", "progress", "forced"]
        old = state.select("job_id", "event_id", "us", F.lit("").alias("kind"), F.lit("").alias("status"), "progress", F.lit(False).alias("forced"), F.lit(True).alias("old"))
        rows = old.unionByName(events.select(*cols).withColumn("old", F.lit(False)))
        schema = "job_id bigint, event_id bigint, us bigint, kind string, status string, progress double, forced boolean, old boolean"
        passed = rows.repartition("job_id").sortWithinPartitions("job_id", F.desc("old"), *ORDER).mapInPandas(run, schema).checkpoint()
        last = passed.groupBy("job_id").agg(F.max_by(F.struct("us", "event_id", "progress"), F.struct(*ORDER)).alias("s"))
        return passed.filter("not old").select("job_id", "event_id", "kind", "status", "progress"), last.select("job_id", "s.us", "s.event_id", "s.progress")

    return Rule(step, THROTTLE_STATE)


CANCEL_STATE = "job_id bigint, us bigint, event_id bigint, action string"


def cancellations(ttl_s: float = CANCEL_TTL_S) -> Rule:
    """Per event whether its job is cancelled at that point; ``action`` is cancel, retry or other.

    A cancellation holds for ``ttl_s`` and is cleared by a retry.
    """

    def step(events: DataFrame, state: DataFrame, now_us: int | None) -> tuple[DataFrame, DataFrame]:
        rows = state.withColumn("_old", F.lit(True)).unionByName(
            events.select("job_id", "us", "event_id", "action").withColumn("_old", F.lit(False)))
        c = O.chunked(rows.withColumn("_said", F.when(F.col("action").isin("cancel", "retry"), F.struct("action", "us"))), ["job_id"], ORDER)
        c = O.last_seen(c, ["job_id"], ORDER, "_said", "_last")
        on = (F.col("_last.action") == "cancel") & (F.col("us") - F.col("_last.us") <= ttl_s * 1e6)
        out = c.filter("not _old").select("job_id", "event_id", F.coalesce(on, F.lit(False)).alias("cancelled"))
        said = c.filter(F.col("_said").isNotNull()).groupBy("job_id").agg(F.max_by(F.struct("us", "event_id", "action"), F.struct(*ORDER)).alias("s"))
        return out, said.select("job_id", "s.us", "s.event_id", "s.action")

    return Rule(step, CANCEL_STATE)


# ------------------------------------------------------------------ running

def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the session's checkpoints, shared by all executors."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def run_rule(
    events: DataFrame, rule: Rule, name: str = "rule", delay_s: float = DAY_S, ttl_s: float = 30 * DAY_S,
    clock: Callable[[], int] | None = None, folder: str | None = None,
) -> DataFrame:
    """Run a rule over all events available now and return its output table.

    ``clock`` gives the time in microseconds for keep-alives (default: the system's). A run that names the
    ``folder`` of an earlier one (on storage that driver and executors share) goes on where that stopped or
    was lost: events it has handled are not read again, and what it released at its end only for want of
    later events is decided anew. Events without a time can't be ordered; they go to the table ``rejected``
    of the folder (see ``rejected_events``) and count nowhere else.
    """
    spark = events.sparkSession
    known = folder is not None
    folder = folder or work_folder(spark, name)
    fields = events.schema
    now = clock or (lambda: time.time_ns() // 1000)
    done: list[int] = []

    def table(kind: str, epoch: int, schema: Any) -> DataFrame:
        if epoch < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{folder}/{kind}/epoch={epoch}")

    def handle(batch: DataFrame | None, epoch: int) -> None:
        waiting, state = table("waiting", epoch - 1, fields), table("state", epoch - 1, rule.state)
        marks = table("mark", epoch - 1, "newest bigint, released bigint").first()
        newest, released = (marks.newest, marks.released) if marks else (None, None)
        if batch is None:
            ready, rest, bound = waiting, waiting.filter("false"), newest
        else:
            batch.filter("us IS NULL").write.mode("overwrite").parquet(f"{folder}/rejected/epoch={epoch}")
            batch = batch.filter("us IS NOT NULL")
            # What is older than the events already handled is stale.
            fresh = batch if released is None else batch.filter(F.col("us") > released)
            rows = waiting.unionByName(fresh)
            top = fresh.agg(F.max("us")).first()[0]
            newest = max(x for x in (newest, top) if x is not None) if (newest is not None or top is not None) else None
            bound = None if newest is None else newest - int(delay_s * 1e6)
            ready, rest = (rows.filter(F.col("us") <= bound), rows.filter(F.col("us") > bound)) if bound is not None else (rows, rows.filter("false"))
            if released is not None and bound is not None:
                bound = max(bound, released)
        out, new = rule.step(ready, state, now())
        out.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")
        if newest is not None:
            new = new.filter(F.col("us") >= newest - int(ttl_s * 1e6))
        new.write.mode("overwrite").parquet(f"{folder}/state/epoch={epoch}")
        rest.write.mode("overwrite").parquet(f"{folder}/waiting/epoch={epoch}")
        spark.createDataFrame([(newest, bound)], "newest bigint, released bigint").write.mode("overwrite").parquet(f"{folder}/mark/epoch={epoch}")
        done.append(epoch)

    q = events.writeStream.option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).foreachBatch(handle).start()
    q.awaitTermination()
    # Nothing more can come for now: release what still waits. The next batch of a later run overwrites this.
    if done or not (known and _exists(spark, f"{folder}/out")):
        handle(None, max(done, default=-1) + 1)
    return spark.read.parquet(f"{folder}/out/*")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def rejected_events(spark: SparkSession, folder: str, schema: Any) -> DataFrame:
    """Events without a time that the runs of ``run_rule`` in this folder have put aside."""
    if not _exists(spark, f"{folder}/rejected"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/rejected/*")


def rate_stream(events: DataFrame, limit: int, period: str = "1 minute", delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Requests and rejections per key and fixed window; the watermark bounds the state."""
    g = events.withWatermark(ts, delay).groupBy(F.window(ts, period), "job_id").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("rejected", F.greatest(F.lit(0).cast("bigint"), F.col("n") - limit))


def job_state(events: DataFrame) -> DataFrame:
    """Latest state per job, for an update-mode query."""
    return events.groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "kind"), F.struct("us", "event_id")).alias("s")).select(
        "job_id", "s.status", "s.progress", "s.kind")


@contextmanager
def _options(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session options for the start of one query (a running query keeps its own copy), then put back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Process everything available now into a Parquet table and return it."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True)
    with _options(spark, **{"spark.sql.streaming.stateStore.providerClass": ROCKSDB}):
        if mode == "append":
            q = writer.format("parquet").option("path", f"{folder}/out").outputMode("append").start()
        else:
            def upsert(batch: DataFrame, epoch: int) -> None:
                batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

            q = writer.outputMode("update").foreachBatch(upsert).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out") if mode == "append" else spark.read.parquet(f"{folder}/out/*")


def upsert_latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """Collapse the per-epoch rows of an update-mode run to the newest row per key."""
    cols = [c for c in table.columns if c not in (*keys, "epoch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*cols), "epoch").alias("s")).select(*keys, "s.*")


def auto_score(scenes: DataFrame, process: Callable[[DataFrame], DataFrame], name: str = "auto-score") -> DataFrame:
    """New scenes from a stream run through ``process(new_scenes) -> zones``; returns the zone table.

    Each micro-batch writes its own folder and overwrites it on a replay. A scene whose rows arrive in
    several batches is scored again with what is known then; only its latest scoring is returned.
    """
    spark = scenes.sparkSession
    folder = work_folder(spark, name)

    def run(batch: DataFrame, epoch: int) -> None:
        new = batch.select("scene_id").distinct()
        new.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/scored/batch={epoch}")
        process(new).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/out/batch={epoch}")

    q = scenes.writeStream.option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).foreachBatch(run).start()
    q.awaitTermination()
    latest = spark.read.parquet(f"{folder}/scored/*").groupBy("scene_id").agg(F.max("epoch").alias("epoch"))
    return spark.read.parquet(f"{folder}/out/*").join(latest, ["scene_id", "epoch"], "left_semi").drop("epoch")
