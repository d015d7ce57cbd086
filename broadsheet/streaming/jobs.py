"""A queue of jobs with leases: submitted, claimed, done or failed, tried again later, recovered when a lease runs out.

The rules are one step function over a job's state. A stream keeps the state by job (``transformWithStateInPandas``) with a timer
for the lease; the batch twin folds the same events in order and is held against the stream. Both give one row a transition.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Tries of a job, seconds of a lease, of the wait after a failure (times the tries so far) and after a deferral.
TRIES, LEASE, WAIT, DEFERRED = 3, 300, 60, 15
#: ``kind``: submit (version), claim (lease), done (lease), failed (lease), broken (lease; for good), deferred (lease). ``at``: seconds.
EVENT = "job long, seq long, at long, kind string, version long, lease string"
TRANSITION = "job long, seq long, at long, status string, attempts int, next_at long"
_EVENT = ["seq", "at", "kind", "version", "lease"]
_NAMES = [c.split()[0] for c in TRANSITION.split(", ")]


class Job(NamedTuple):
    version: int
    status: str
    attempts: int
    next_at: int | None = None
    lease: str | None = None
    until: int | None = None


def recovered(job: Job | None, at: int) -> tuple[Job | None, int | None]:
    """The job after its lease ran out before ``at``, and when it was taken back; (job, None) if it did not."""
    if job is None or job.status != "running" or job.until >= at:
        return job, None
    back = job.until + 1
    if job.attempts >= TRIES:
        return Job(job.version, "failed", job.attempts), back
    return Job(job.version, "pending", job.attempts, back), back


def step(job: Job | None, kind: str, at: int, version: int | None, lease: str | None) -> Job | None:
    """The job after an event; the same job if the event does not apply."""
    if kind == "submit":
        if job is None or job.version != version or job.status == "completed":
            return Job(version, "pending", 0, at)
        return job
    if job is None:
        return None
    if kind == "claim":
        ready = job.status == "pending" and job.attempts < TRIES and job.next_at <= at
        return Job(job.version, "running", job.attempts + 1, None, lease, at + LEASE) if ready else job
    if job.status != "running" or job.lease != lease:
        return job  # whoever had the lease has lost it
    if kind == "done":
        return Job(job.version, "completed", job.attempts)
    if kind == "deferred":
        return Job(job.version, "pending", max(job.attempts - 1, 0), at + DEFERRED)
    if kind == "failed" and job.attempts < TRIES:
        return Job(job.version, "pending", job.attempts, at + WAIT * job.attempts)
    return Job(job.version, "failed", job.attempts)


def transitions(job_id: int, job: Job | None, events: pd.DataFrame) -> tuple[Job | None, list[tuple]]:
    """The job after ``events`` (in order), and a row for each change; a recovery has no seq."""
    out = []
    for event in events[_EVENT].itertuples(index=False, name=None):
        job = _after(job_id, job, event, out)
    return job, out


def _after(job_id: int, job: Job | None, event: tuple, out: list[tuple]) -> Job | None:
    """The job after one event (seq, at, kind, version, lease); a row for each change goes to ``out``."""
    seq, at, kind, version, lease = event
    job, back = recovered(job, at)
    if back is not None:
        out.append((job_id, None, back, job.status, job.attempts, job.next_at))
    new = step(job, kind, int(at), None if pd.isna(version) else int(version), lease if isinstance(lease, str) else None)
    if new != job:
        job = new
        out.append((job_id, int(seq), int(at), job.status, job.attempts, job.next_at))
    return job


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({"seq": "Int64", "next_at": "Int64"})


def job_history(events: DataFrame, as_of: int) -> DataFrame:
    """All transitions (TRANSITION) of jobs up to ``as_of``, leases that have run out by then taken back. A job's events pass in order; only its state is held."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, job = None, None
        for pdf in batches:
            out = []
            # jobs have few events each, so these pass one by one, not as a table a job
            for job_id, *event in zip(*(pdf[c].tolist() for c in ("job", *_EVENT)), strict=True):
                if job_id != now:
                    out += _ended(now, job, as_of)
                    now, job = job_id, None
                job = _after(job_id, job, event, out)
            yield _frame(out)
        yield _frame(_ended(now, job, as_of))

    known = events.where(F.col("job").isNotNull() & (F.col("at") <= as_of)).select(*[c.split()[0] for c in EVENT.split(", ")])
    return known.repartition("job").sortWithinPartitions("job", "at", "seq").mapInPandas(fold, TRANSITION)


def _ended(job_id: int | None, job: Job | None, as_of: int) -> list[tuple]:
    job, back = recovered(job, as_of)
    return [] if back is None else [(int(job_id), None, back, job.status, job.attempts, job.next_at)]


class LeasedJobs(StatefulProcessor):
    """The state of one job, with a timer at the end of its lease (event time)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "version long, status string, attempts int, next_at long, lease string, until long")

    def _get(self) -> Job | None:
        return Job(*self.job.get()) if self.job.exists() else None

    def _put(self, job: Job | None) -> None:
        if job is None:
            return
        self.job.update(tuple(job))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if job.until is not None:
            self.handle.registerTimer((job.until + 1) * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        job, out = transitions(int(key[0]), self._get(), pd.concat(list(rows)).sort_values(["at", "seq"]))
        self._put(job)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = _ended(int(key[0]), self._get(), expiredTimerInfo.getExpiryTimeInMs() // 1000 + 1)
        if out:
            self._put(recovered(self._get(), expiredTimerInfo.getExpiryTimeInMs() // 1000 + 1)[0])
        yield _frame(out)

    def close(self) -> None:
        pass


def leased_jobs(events: DataFrame, late: str) -> DataFrame:
    """TRANSITION rows of a stream of events (EVENT); ``late``: how late an event may come. The session needs the RocksDB state store."""
    timed = events.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", late)
    return timed.groupBy("job").transformWithStateInPandas(LeasedJobs(), TRANSITION, "Append", "EventTime")
