"""The job queue: a plain fold, its batch query and its stream agree."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from broadsheet.streaming.jobs import EVENT, job_history, leased_jobs


def made(n, seed=4):
    rng = random.Random(seed)
    kinds = ["submit", "claim", "claim", "claim", "done", "failed", "failed", "broken", "deferred"]
    return [(rng.randrange(9), i, 1_000_000 + i * 12 + rng.randrange(30), k := rng.choice(kinds), rng.randrange(2) if k == "submit" else None, None if k == "submit" else rng.choice("ab")) for i in range(n)]


def plain(events, as_of):
    """One job after the other, the rules written out again."""
    out = []
    for job in sorted({e[0] for e in events}):
        s = None

        def note(seq, at, job=job):
            out.append((job, seq, at, s["status"], s["attempts"], s["next"]))

        def expire(at):
            if s and s["status"] == "running" and s["until"] < at:
                back = s["until"] + 1
                s.update(status="failed" if s["attempts"] >= 3 else "pending", next=None if s["attempts"] >= 3 else back, lease=None)
                note(None, back)

        for _, seq, at, kind, version, lease in sorted((e for e in events if e[0] == job and e[2] <= as_of), key=lambda e: (e[2], e[1])):
            expire(at)
            mine = s and s["status"] == "running" and s["lease"] == lease
            if kind == "submit" and (not s or s["version"] != version or s["status"] == "completed"):
                s = {"version": version, "status": "pending", "attempts": 0, "next": at, "lease": None}
            elif kind == "claim" and s and s["status"] == "pending" and s["attempts"] < 3 and s["next"] <= at:
                s.update(status="running", attempts=s["attempts"] + 1, next=None, lease=lease, until=at + 300)
            elif kind == "done" and mine:
                s.update(status="completed", lease=None)
            elif kind == "deferred" and mine:
                s.update(status="pending", attempts=s["attempts"] - 1, next=at + 15, lease=None)
            elif kind == "failed" and mine and s["attempts"] < 3:
                s.update(status="pending", next=at + 60 * s["attempts"], lease=None)
            elif kind in ("failed", "broken") and mine:
                s.update(status="failed", lease=None)
            else:
                continue
            note(seq, at)
        expire(as_of)
    return sorted(out, key=repr)


def test_history(spark):
    events = made(600)
    as_of = events[-1][2] - 500
    table = spark.createDataFrame(random.Random(1).sample(events, len(events)), EVENT)
    got = sorted((tuple(r) for r in job_history(table, as_of).collect()), key=repr)
    assert got == plain(events, as_of) and sum(r[1] is None for r in got) > 10 and {r[3] for r in got} == {"pending", "running", "completed", "failed"}
    assert job_history(table.limit(0), as_of).count() == 0


def test_stream_matches_the_batch(spark, tmp_path):
    events = made(240, 8)
    end = events[-1][2]
    # a last event of another job moves the watermark on, so that all leases run out
    events.append((99, 999, end + 5000, "submit", 0, None))
    for k in range(4):
        spark.createDataFrame([*events[k * 61 : (k + 1) * 61]], EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = leased_jobs(stream, "0 seconds").writeStream.format("memory").queryName("jobs").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(240)
    finally:
        spark.conf.set(provider, before)
    got = sorted((tuple(r) for r in spark.table("jobs").collect()), key=repr)
    assert got == sorted((tuple(r) for r in job_history(spark.createDataFrame(events, EVENT), end + 5000).collect()), key=repr)
    assert spark.table("jobs").where(F.col("seq").isNull()).count() > 3


def test_events_pass_one_by_one():
    from broadsheet.streaming import jobs

    events = [(k, 100 * k, ["submit", "claim", "failed", "claim", "done"][k % 5], 1.0 if k % 5 == 0 else float("nan"), "a") for k in range(40)]
    job, out = None, []
    for event in events:
        job = jobs._after(7, job, event, out)
    assert (job, out) == jobs.transitions(7, None, pd.DataFrame(events, columns=["seq", "at", "kind", "version", "lease"]))
    assert out
