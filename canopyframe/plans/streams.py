"""Registered streaming queries: the ``events`` table read as a stream until it is exhausted."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyframe.operators import events as EV
from canopyframe.operators import zones as Z
from canopyframe.plans import adapters as A
from canopyframe.plans import rasters as RA
from canopyframe.plans.adapters import rnd
from canopyframe.plans.registry import Tables, query, r4, r6, with_ctes
from canopyframe.streaming import job_events as JE


class StreamTables(Tables):
    """The same tables opened as file streams."""

    def __call__(self, name: str):
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)


def live(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.folder)


@query("st1_job_event_messages", with_ctes(A.EVENTS_SQL, body=f"SELECT CAST(job_id AS VARCHAR) AS job_id, kind, status, {r6('progress')} AS progress FROM ev"))
def _(t):
    """Events published as JSON messages and parsed back from the stream."""
    e = A.events(live(t)).select(F.col("job_id").cast("string").alias("job_id"), "kind", "status", "progress", F.lit("run").alias("step"), F.lit(None).cast("timestamp").alias("timestamp"))
    parsed = JE.read_job_events(e.select(JE.format_message().alias("value")))
    return JE.run_available(parsed, name="st1").select("job_id", "kind", "status", rnd("progress").alias("progress"))


@query("st2_job_follower", with_ctes(A.EVENTS_SQL, body="""
, f AS (SELECT job_id, min(us * 1000000 + event_id) AS stop FROM ev WHERE kind IN ('complete', 'error') GROUP BY job_id),
c AS (SELECT ev.* FROM ev LEFT JOIN f USING (job_id) WHERE stop IS NULL OR us * 1000000 + event_id <= stop),
a AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY us, event_id) AS ps FROM c),
b AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> status THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY us, event_id) AS run FROM a),
d AS (SELECT *, max(progress) OVER (PARTITION BY job_id, run ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM b)
SELECT event_id, job_id, kind, status FROM d WHERE top IS NULL OR progress > top"""))
def _(t):
    """Per-job follower with one state row: snapshot, changes, stop at a terminal event."""
    e = A.events(live(t)).select("job_id", "event_id", "us", "kind", "status", "progress")
    return JE.run_rule(e, JE.follower(), "st2").select("event_id", "job_id", "kind", "status")


@query("st3_progress_throttle", """
WITH RECURSIVE ev AS (
  SELECT event_id, user_id AS job_id, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS us, event_type = 'purchase' AS forced,
         CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END AS status,
         greatest(0.0, least(value / 100.0::DOUBLE, 1.0)) AS p FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY us, event_id) AS i FROM ev),
w AS (
  SELECT event_id, job_id, status, p, i, TRUE AS pass, us AS last_us, p AS top FROM n WHERE i = 1
  UNION ALL
  SELECT n.event_id, n.job_id, n.status, n.p, n.i, n.forced OR n.us - w.last_us >= 86400000000 OR n.p - w.top >= 0.3,
         CASE WHEN n.forced OR n.us - w.last_us >= 86400000000 OR n.p - w.top >= 0.3 THEN n.us ELSE w.last_us END,
         CASE WHEN n.forced OR n.us - w.last_us >= 86400000000 OR n.p - w.top >= 0.3 THEN n.p ELSE w.top END
  FROM w JOIN n ON n.job_id = w.job_id AND n.i = w.i + 1)
SELECT event_id, job_id, status, round(p, 6) + 0.0 AS progress FROM w WHERE pass""")
def _(t):
    """Throttled progress (interval one day, step 0.3 on this sparse table)."""
    e = A.events(live(t)).select("job_id", "event_id", "us", "kind", "status", "progress", (F.col("kind") == "complete").alias("forced"))
    return JE.run_rule(e, JE.throttle(86400.0, 0.3), "st3").select("event_id", "job_id", "status", rnd("progress").alias("progress"))


@query("st5_cancellation_flags", with_ctes(A.EVENTS_SQL, body="""
, m AS (SELECT *, max(CASE WHEN kind = 'error' OR status = 'queued' THEN us * 100 + CASE WHEN kind = 'error' THEN 1 ELSE 0 END END) OVER (PARTITION BY job_id ORDER BY us, event_id) AS last FROM ev)
SELECT event_id, job_id, coalesce(last % 100 = 1 AND us - last // 100 <= 604800000000, FALSE) AS cancelled FROM m"""))
def _(t):
    """Cancellation state that expires after a week; an error stands for a cancel request, a sign-up for a retry."""
    action = F.when(F.col("kind") == "error", "cancel").when(F.col("status") == "queued", "retry").otherwise("none")
    e = A.events(live(t)).select("job_id", "event_id", "us", action.alias("action"))
    return JE.run_rule(e, JE.cancellations(7 * 86400.0), "st5").select("event_id", "job_id", "cancelled")


@query("st6_keep_alives", with_ctes(A.EVENTS_SQL, body="""
, p AS (SELECT *, lag(us) OVER (PARTITION BY job_id ORDER BY us, event_id) AS p FROM ev)
SELECT event_id, job_id, CAST(coalesce(least(864000000000, us - p) // 43200000000, 0) AS BIGINT) AS n_beats FROM p"""))
def _(t):
    """Keep-alives due before each event (silence of half a day, ten days at most)."""
    return EV.keep_alives(A.events(t), 43200, 864000).select("event_id", "job_id", "n_beats")


@query("st7_job_state_stream", with_ctes(A.EVENTS_SQL, body="SELECT job_id, arg_max(status, us) AS status, arg_max(kind, us) AS kind FROM ev GROUP BY job_id"))
def _(t):
    """Latest state per job from an update-mode stream."""
    table = JE.run_available(JE.job_state(A.events(live(t))), mode="update", name="st7")
    return JE.upsert_latest(table, ["job_id"]).select("job_id", "status", "kind")


@query("st8_rate_window_stream", with_ctes(A.EVENTS_SQL, body='SELECT job_id, us // 86400000000 AS "window", count(*) AS n, greatest(0, count(*) - 2) AS rejected FROM ev GROUP BY 1, 2'))
def _(t):
    """Fixed-window request counts per key from a stream with a watermark."""
    e = live(t)("events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"))
    table = JE.run_available(JE.rate_stream(e, 2, "1 day"), mode="update", name="st8")
    rows = JE.upsert_latest(table, ["window", "job_id"])
    day = F.floor(F.timestamp_diff("MICROSECOND", F.to_timestamp(F.lit("2024-01-01")), F.col("window.start")) / 86400000000)
    return rows.select("job_id", day.alias("window"), "n", "rejected")


@query("st9_auto_scoring", RA.zone_sql(f"SELECT scene_id, rc AS risk_class, zone, CAST(n_pixels AS BIGINT) AS n_pixels, {r4('risk')} AS risk_score FROM zs WHERE n_pixels >= greatest(1, ceil(1.0 / {RA.ACRES_SQL}))", RA.ZS_SQL))
def _(t):
    """New scenes in a stream trigger zone extraction on their pixels."""
    scenes = A.raster(live(t)).select("scene_id")

    def process(new):
        px = A.raster(t).join(new, "scene_id", "left_semi")
        return Z.extract_zones(px, RA._grid(t), block=RA.BLOCK).select("scene_id", "risk_class", "zone", "n_pixels", rnd("risk_score", 4).alias("risk_score"))

    return JE.auto_score(scenes, process)
