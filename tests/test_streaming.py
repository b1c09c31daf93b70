"""Streaming rules against plain loops, whatever the size and number of micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from canopyframe.operators import events as EV
from canopyframe.plans import adapters as A
from canopyframe.plans.registry import Tables
from canopyframe.plans.streams import live
from canopyframe.streaming import job_events as JE

COLS = ["job_id", "event_id", "us", "kind", "status", "progress"]
SCHEMA = "job_id bigint, event_id bigint, us bigint, kind string, status string, progress double, forced boolean, action string"


def events(n, jobs=1, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = "complete" if jobs > 1 and rng.random() < 0.002 else "progress"
        rows.append((rng.randrange(jobs), i, i * 1000 + rng.randrange(1000), kind, rng.choice(["queued", "running"]) if i % 50 == 0 else "running",
                     rng.random() * (i + 1) / n, rng.random() < 0.001, rng.choice(["cancel", "retry", "none", "none"])))
    rng.shuffle(rows)
    return rows


def stream_of(spark, rows, tmp_path, files=1):
    folder = str(tmp_path / "in")
    for i in range(files):
        spark.createDataFrame(rows[i::files], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def follow_loop(rows):
    out, state = set(), {}
    for job, event, us, kind, status, progress, *_ in sorted(rows, key=lambda r: (r[2], r[1])):
        old, top, done = state.get(job, (None, -1.0, False))
        if done:
            continue
        if status != old or progress > top:
            out.add(event)
        state[job] = (status, progress if status != old else max(top, progress), kind in JE.TERMINAL)
    return out


def throttle_loop(rows, gap, step):
    out, state = set(), {}
    for job, event, us, _, _, progress, forced, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        last, top = state.get(job, (float("-inf"), 0.0))
        p = min(max(progress, 0.0), 1.0)
        if forced or us - last >= gap or p - top >= step:
            state[job] = (us, p)
            out.add(event)
    return out


def cancel_loop(rows, ttl):
    out, state = {}, {}
    for job, event, us, *_, action in sorted(rows, key=lambda r: (r[2], r[1])):
        if action in ("cancel", "retry"):
            state[job] = (action, us)
        said = state.get(job)
        out[event] = bool(said and said[0] == "cancel" and us - said[1] <= ttl)
    return out


@pytest.mark.parametrize("case", ["one hot job", "tiny Arrow batches", "five shuffled files"])
def test_rules_do_not_depend_on_batches(spark, tmp_path, case):
    rows = events(30_000) if case == "one hot job" else events(4_000, jobs=5)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if case == "tiny Arrow batches":
        spark.conf.set(key, "7")
    try:
        stream = stream_of(spark, rows, tmp_path, 5 if "five" in case else 1)
        got = JE.run_rule(stream, JE.follower(), delay_s=3600).collect()
        assert sorted(r.event_id for r in got) == sorted(follow_loop(rows))
        if case == "one hot job":
            table = spark.createDataFrame(rows, SCHEMA)
            assert {r.event_id for r in EV.progress_changes(table.select(*COLS)).select("event_id").collect()} == {r.event_id for r in got}
        got = JE.run_rule(stream, JE.throttle(0.5, 0.2), delay_s=3600).collect()
        assert sorted(r.event_id for r in got) == sorted(throttle_loop(rows, 5e5, 0.2))
        got = JE.run_rule(stream, JE.cancellations(0.05), delay_s=3600).collect()
        assert {r.event_id: r.cancelled for r in got} == cancel_loop(rows, 5e4)
    finally:
        spark.conf.set(key, before)


def test_events_in_order_need_no_waiting(spark, tmp_path):
    """Files in time order, no delay: state alone carries the rules from trigger to trigger."""
    rows = sorted(events(2_000, jobs=3), key=lambda r: (r[2], r[1]))
    folder = str(tmp_path / "in")
    for i in range(4):
        spark.createDataFrame(rows[i * 500:(i + 1) * 500], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    got = JE.run_rule(stream, JE.follower(), delay_s=0).collect()
    assert sorted(r.event_id for r in got) == sorted(follow_loop(rows))
    got = JE.run_rule(stream, JE.throttle(0.5, 0.2), delay_s=0).collect()
    assert sorted(r.event_id for r in got) == sorted(throttle_loop(rows, 5e5, 0.2))
    got = JE.run_rule(stream, JE.cancellations(0.05), delay_s=0).collect()
    assert {r.event_id: r.cancelled for r in got} == cancel_loop(rows, 5e4)


def test_keep_alives_fire(spark, tmp_path):
    """Job 1 falls silent while job 2 keeps triggering; job 3 has ended. The clock is ours."""
    s = 1_000_000
    files = [[(1, 1, 0, "progress", "running", 0.1, False, "none"), (3, 2, 1, "complete", "succeeded", 1.0, False, "none")],
             [(2, 3, 2, "progress", "running", 0.1, False, "none")], [(2, 4, 3, "progress", "running", 0.2, False, "none")]]
    folder = str(tmp_path / "in")
    for f in files:
        spark.createDataFrame(f, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    ticks = iter([0, 20 * s, 47 * s, 47 * s, 47 * s])
    got = JE.run_rule(stream, JE.follower(keep_alive=True), delay_s=0, clock=lambda: next(ticks)).collect()
    beats = [r.job_id for r in got if r.kind == "keep-alive"]
    # 20 s: one beat of job 1; 47 s: two more (job 2 spoke in between).
    assert sorted(beats) == [1, 1, 1] and {r.event_id for r in got} == {-1, 1, 2, 3, 4}


def test_state_of_silent_jobs_expires(spark, tmp_path):
    day = 86_400_000_000
    rows = [(1, 1, 0, "complete", "succeeded", 1.0, False, "none"), (2, 2, 40 * day, "progress", "running", 0.1, False, "none"),
            (1, 3, 41 * day, "progress", "running", 0.1, False, "none")]
    folder = str(tmp_path / "in")
    for r in rows:
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    ids = lambda ttl: {r.event_id for r in JE.run_rule(stream, JE.follower(), delay_s=0, ttl_s=ttl).collect()}
    assert ids(30 * 86400.0) == {1, 2, 3} and ids(90 * 86400.0) == {1, 2}


def test_scene_in_two_batches_is_scored_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    for part in (["a"], ["a", "b"]):
        spark.createDataFrame([(x,) for x in part], "scene_id string").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("scene_id string").option("maxFilesPerTrigger", 1).parquet(folder)
    got = JE.auto_score(stream, lambda new: new.withColumn("zone", F.lit(1))).collect()
    assert sorted(r.scene_id for r in got) == ["a", "b"]


def test_options_are_put_back(spark, folder):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    JE.run_available(JE.job_state(A.events(live(Tables(spark, folder)))), mode="update")
    assert spark.conf.get(key, None) == before


def test_follower_stops_at_the_terminal_event(spark, folder):
    rows = JE.run_rule(A.events(live(Tables(spark, folder))).select(*COLS), JE.follower()).collect()
    per = {}
    for r in rows:
        per.setdefault(r.job_id, []).append(r.kind)
    assert all(sum(k in JE.TERMINAL for k in kinds) <= 1 for kinds in per.values())


def test_a_run_goes_on_where_the_last_one_stopped(spark, tmp_path):
    """The same folder again: earlier files are not read twice, waiting events are decided with the later ones."""
    rows = sorted(events(300, jobs=3), key=lambda r: (r[2], r[1]))
    source, work = str(tmp_path / "in"), str(tmp_path / "work")

    def run(part):
        if part:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        return sorted(r.event_id for r in JE.run_rule(stream, JE.follower(), delay_s=3600, folder=work).collect())

    assert run(rows[1::2]) == sorted(follow_loop(rows[1::2]))
    assert run(rows[::2]) == sorted(follow_loop(rows))
    assert run([]) == sorted(follow_loop(rows))


def test_events_without_a_time_are_put_aside(spark, tmp_path):
    rows = [(1, 1, 0, "progress", "running", 0.1, False, "none"), (1, 2, None, "progress", "queued", 0.9, False, "none"), (1, 3, 5, "progress", "running", 0.4, False, "none")]
    work = str(tmp_path / "work")
    got = JE.run_rule(stream_of(spark, rows, tmp_path), JE.follower(), folder=work).collect()
    assert sorted(r.event_id for r in got) == [1, 3]
    assert [r.event_id for r in JE.rejected_events(spark, work, SCHEMA).collect()] == [2]
    assert JE.rejected_events(spark, str(tmp_path / "none"), SCHEMA).count() == 0
