"""Job state in a keyed state store, with event-time timers that forget ended jobs.

Each micro-batch touches only the jobs it has actions of: their state is read from the
store, the actions are folded in, and one row per changed job goes out. A job that ended
gets a timer at the end of its record; when the watermark passes it, the job is removed
from the store and an ``expired`` row goes out. The fold is the one of
``operators.jobs.advance_jobs``, one job at a time.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Collection, Iterator
from itertools import islice

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from contactloom.functions.records import JOB_STATES
from contactloom.operators.jobs import KEPT_HOURS

# The actions of the job log, in the order of JOB_STATES.
ACTIONS = ("enqueue", "start", "complete", "fail", "cancel")
_ENDS = {"complete", "fail", "cancel"}
_WRITES = {"enqueue", "complete", "fail"}
_STATUS = dict(zip(ACTIONS, JOB_STATES, strict=True))

# Times are microseconds since the epoch.
STATE = (
    "status string, created_at long, started_at long, completed_at long, updated_at long, "
    "active boolean, guard string, seen_at long"
)
_STATE_NAMES = [part.split()[0] for part in STATE.split(", ")]
OUTPUT = (
    "kind string, job_id string, status string, created_at long, started_at long, "
    "completed_at long, updated_at long, active boolean, seen_at long, ts long, seq long, action string, "
    "revision long"
)
_OUT_NAMES = [part.split()[0] for part in OUTPUT.split(", ")]
_OUT_STATE = [name for name in _OUT_NAMES if name in _STATE_NAMES]
# Groups that jobs are dealt to; a stream keeps the number it began with.
BUCKETS = 1024
# From this many jobs of a batch on, a bucket's map is read in one go, up to so many stored
# jobs for each job asked for: a row read this way costs a small part of a call of its own.
MANY_JOBS, READ_AHEAD = 64, 8
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# The processor runs in Python workers, which need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def fold_job(old: dict | None, actions: list[tuple[int, int, str]], hours: int) -> tuple[dict | None, list]:
    """The state of one job after its next actions (``ts, seq, action``, sorted), and the late ones.

    Actions older than the newest one seen are late and left out. A cancel while the job
    runs is refused; a start or cancel after the record ran out (``hours`` after the last
    accepted change, or before any record) finds no job. Returns ``None`` as state when
    nothing was accepted and there was no state before.
    """
    span = hours * 3_600_000_000
    seen = old["seen_at"] if old else None
    late = [a for a in actions if seen is not None and a[0] < seen]
    actions = [a for a in actions if seen is None or a[0] >= seen]
    if not actions:
        return old, late
    old_guard = old["guard"] if old else None
    old_ts = old["updated_at"] if old else None
    guard = previous = written = gap_at = None
    status = created = started = completed = updated = None
    ended = False
    new_guard = None
    for ts, seq, action in actions:
        running = (guard if guard is not None else old_guard) == "start"
        guarded = action == "cancel" and running
        before = previous if previous is not None else old_ts
        if action in _WRITES:
            written = (ts, seq)
        if action in ("start", "cancel") and before is not None and ts >= before + span:
            gap_at = (ts, seq)
        last_write = written[0] if written is not None else old_ts
        if last_write is None:
            lost = True
        elif written is None:
            lost = gap_at is not None
        else:
            lost = gap_at is not None and gap_at > written
        accepted = not guarded and not (action in ("start", "cancel") and lost)
        if action == "enqueue":
            created = ts if created is None else min(created, ts)
        if accepted:
            status = _STATUS[action]
            updated = ts
            if action == "start":
                started = ts
            if action in _ENDS:
                completed = ts
                ended = True
        if action != "cancel":
            guard = new_guard = action
        if not guarded:
            previous = ts
    def newest(new, name):
        return new if new is not None else (old[name] if old else None)

    state = {
        "status": newest(status, "status"),
        "created_at": old["created_at"] if old and old["created_at"] is not None else created,
        "started_at": newest(started, "started_at"),
        "completed_at": newest(completed, "completed_at"),
        "updated_at": newest(updated, "updated_at"),
        "active": (not ended) and (old["active"] if old and old["active"] is not None else True),
        "guard": newest(new_guard, "guard"),
        "seen_at": max(a[0] for a in actions) if seen is None else max(seen, max(a[0] for a in actions)),
    }
    return (state if state["status"] is not None else old), late


class JobFold(StatefulProcessor):
    """Folds the actions of jobs into their states; with ``expire`` ended jobs are forgotten
    when the watermark passes the end of their record.

    Jobs are dealt to buckets by a hash, and a bucket holds its jobs in a map state by
    ``job_id``: the rows of a bucket cross to Python and back together, and what is read and
    written in the store is the jobs that have actions (see ``_held`` for large batches). A bucket
    has one timer, at the earliest end of a record; when it fires, the jobs in ``due`` that ran out go.

    With ``refold`` the actions of each job are kept as well, and an action
    older than the newest one folded makes the job be folded again from its whole log, so
    late actions change what they must instead of being set aside.

    Memory per bucket and batch: its actions of the batch, about 100 bytes each (with
    ``refold``, the whole log of a job when a late one comes), and its jobs in ``due``, so the stream's source
    must bound its batches (``maxFilesPerTrigger``). Each state row carries a ``revision`` that grows
    per job, so the last one written wins even when a refold leaves ``seen_at`` as it was.
    """

    def __init__(self, hours: int = KEPT_HOURS, expire: bool = True, refold: bool = False):
        self.hours, self.expire, self.refold = hours, expire, refold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One JSON list per job: its id, the columns of STATE, revision, parts. Python reads and writes
        # the schema of a state row with each row, so rows of many columns are slow.
        self.jobs = handle.getMapState("jobs", "job_id string", "record string")
        if self.expire:
            self.due = handle.getMapState("due", "job_id string", "at long")
            self.timer = handle.getValueState("timer", "at long")
        if self.refold:
            self.log = handle.getMapState(
                "log", "job_id string, part long", "ts array<long>, seq array<long>, action array<string>"
            )

    def _row(self, kind: str, job: str, state: dict | None, late=(None, None, None), revision=None) -> tuple:
        values = [state[name] if state else None for name in _OUT_STATE]
        return kind, job, *values, *late, revision

    def _due_at(self, state: dict | None) -> int | None:
        """Millisecond at which the record of an ended job runs out."""
        if state is None or state["active"]:
            return None
        return -(-(state["updated_at"] + self.hours * 3_600_000_000) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["ts_us", "seq"], kind="stable")
        logs: dict[str | None, list] = {}
        columns = (frame[name].tolist() for name in ("job_id", "ts_us", "seq", "action"))
        for job, *action in zip(*columns):
            logs.setdefault(job if isinstance(job, str) else None, []).append(tuple(action))
        out, earliest = [], None
        held = self._held(logs)
        for job, actions in logs.items():
            at = self._fold(job, held.get(job), actions, out)
            if at is not None:
                earliest = at if earliest is None else min(earliest, at)
        if earliest is not None:
            self._set_timer(earliest)
        if out:
            yield pd.DataFrame(out, columns=_OUT_NAMES)

    def _held(self, jobs: Collection[str | None]) -> dict[str | None, list]:
        """What the store holds of ``jobs``.

        Each call to the store is an exchange between two processes. For many jobs the map is
        read from its start, in large pieces; the jobs that this does not reach are read one by one.
        """
        found, rest = {}, jobs
        if len(jobs) >= MANY_JOBS:
            stored = self.jobs.values()
            for (record,) in islice(stored, READ_AHEAD * len(jobs)):
                job, *held = json.loads(record)
                if job in jobs:
                    found[job] = held
            ended = next(stored, None) is None
            rest = [] if ended else [job for job in jobs if job not in found]
        for job in rest:
            row = self.jobs.getValue((job,))
            if row is not None:
                found[job] = json.loads(row[0])[1:]
        return found

    def _fold(self, job: str | None, held: list | None, actions: list, out: list) -> int | None:
        """Fold one job, of which the store holds ``held``, and add its rows to ``out``; the end
        of its record, if that is new."""
        old = dict(zip(_STATE_NAMES, held)) if held and held[0] is not None else None
        revision, parts = held[-2:] if held else (0, 0)
        before = old
        if self.refold:
            self.log.updateValue((job, parts), tuple(map(list, zip(*actions))))
            parts += 1
            # Without a state there may be actions that nothing accepted so far.
            if parts > 1 and (old is None or actions[0][0] <= old["seen_at"]):
                old = None
                kept = (self.log.getValue((job, part)) for part in range(parts))
                actions = sorted(a for columns in kept for a in zip(*columns))
        state, late = fold_job(old, actions, self.hours)
        out += [self._row("late", job, None, a) for a in late]
        changed = state is not None and state != old
        revision += changed
        if changed:
            out.append(self._row("state", job, state, revision=revision))
        if changed or self.refold:
            columns = [state[name] if state else None for name in _STATE_NAMES]
            self.jobs.updateValue((job,), (json.dumps([job, *columns, revision, parts]),))
        at = self._due_at(state) if self.expire and changed else None
        if at is None or at == self._due_at(before):
            return None
        self.due.updateValue((job,), (at,))
        return at

    def _set_timer(self, at: int) -> None:
        before = self.timer.get()
        if before is not None and before[0] <= at:
            return
        if before is not None:
            self.handle.deleteTimer(before[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due = [(job, at) for (job,), (at,) in self.due.iterator()]
        self.timer.clear()
        later = [at for _, at in due if at > passed]
        if later:
            self._set_timer(min(later))
        out = []
        for job in (job for job, at in due if at <= passed):
            held = json.loads(self.jobs.getValue((job,))[0])[1:]
            self.jobs.removeKey((job,))
            self.due.removeKey((job,))
            for part in range(held[-1]):
                self.log.removeKey((job, part))
            out.append(self._row("expired", job, dict(zip(_STATE_NAMES, held)), revision=held[-2]))
        if out:
            yield pd.DataFrame(out, columns=_OUT_NAMES)

    def close(self) -> None:
        pass


def keyed_job_changes(
    events: DataFrame, hours: int = KEPT_HOURS, expire: bool = True, delay: str = "0 seconds", refold: bool = False
) -> DataFrame:
    """Rows of changed jobs per batch (``kind`` ``state``), late actions (``late``) and, with
    ``expire``, jobs forgotten by their timer (``expired``); times in microseconds.

    ``events`` is a stream of ``job_id, ts, seq, action``; with ``expire`` it gets a
    watermark of ``delay`` on ``ts`` for the timers. Rows of a NULL job go to a job of
    their own key NULL. ``refold``: see ``JobFold``.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    if expire:
        events = events.withWatermark("ts", delay)
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)).alias("bucket")
    given = events.select(
        bucket, "job_id", *["ts"] * expire, F.unix_micros("ts").alias("ts_us"), F.col("seq").cast("long").alias("seq"), "action"
    )
    return (
        given.groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=JobFold(hours, expire, refold),
            outputStructType=OUTPUT,
            outputMode="Append",
            timeMode="EventTime" if expire else "None",
        )
    )


def stream_keyed_jobs(
    events: DataFrame, path: str, hours: int = KEPT_HOURS, expire: bool = True, refold: bool = False
) -> DataStreamWriter:
    """A writer of the changes of ``keyed_job_changes`` to ``path/out``; set its trigger and start it."""
    return (
        keyed_job_changes(events, hours, expire, refold=refold)
        .writeStream.format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/progress")
        .outputMode("append")
    )


def latest_states(changes: DataFrame) -> DataFrame:
    """The last state of every job that has one, from the rows a keyed stream wrote.

    A job whose timer fired after its last change is gone."""
    last = changes.filter(F.col("kind").isin("state", "expired")).groupBy("job_id").agg(
        F.max_by(F.struct(*[c for c in _OUT_NAMES if c != "job_id"]), F.struct("seen_at", "revision", F.col("kind") == "expired")).alias("r")
    )
    return last.select("job_id", "r.*").filter(F.col("kind") == "state")
