"""Scan jobs: state from a log of actions, queue figures.

The log has the columns ``job_id, ts, seq, action`` with the actions enqueue, start,
complete, fail and cancel; ``ts, seq`` orders the rows of a job. Further columns such as
``url`` or ``error`` are carried along, the last value given wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.functions.records import JOB_STATES
from contactloom.operators.skew import ROWS_PER_TASK, Greatest, Last, Ordered, spread_join
from contactloom.options import ScanOptions

# Hours a job record is kept after its last accepted change.
KEPT_HOURS = 24

_ENDS = ("complete", "fail", "cancel")
# These write the record whether or not there still is one.
_WRITES = ("enqueue", "complete", "fail")
_STATE_OF = dict(zip(("enqueue", "start", "complete", "fail", "cancel"), JOB_STATES, strict=True))
_LOG = ("job_id", "ts", "seq", "action")

# Jobs in between two parts of the log; ``guard`` is the last action that was no cancel.
STATE_SCHEMA = (
    "job_id string, status string, created_at timestamp, started_at timestamp,"
    "completed_at timestamp, updated_at timestamp, active boolean, guard string,"
    "seen_at timestamp"
)


def _position() -> Column:
    return F.struct("ts", "seq")


def _kept_until(ts: Column, hours: int) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(hours))


def _judge(
    events: DataFrame, hours: int, rows: int, state: DataFrame | None = None
) -> Ordered:
    """The log with ``guarded`` (cancel of a running job) and ``expired`` (no record).

    ``state`` holds what earlier parts of the log came to.
    """
    action = F.col("action")
    if state is None:
        nothing = {"_old_guard": F.lit(None).cast("string")}
        nothing |= {"_old_ts": F.lit(None).cast("timestamp")}
        events = events.withColumns(nothing)
    else:
        old = state.select(
            "job_id",
            F.col("guard").alias("_old_guard"),
            F.col("updated_at").alias("_old_ts"),
            F.col("seen_at").alias("_seen"),
        )
        # Their place in the log is taken; ``late_actions`` names them.
        late = F.col("ts") < F.col("_seen")
        events = spread_join(events, old, ["job_id"], how="left", rows=rows)
        events = events.filter(~F.coalesce(late, F.lit(False))).drop("_seen")

    log = Ordered(events, ["job_id"], ["ts", "seq"], rows).running(
        {"_guard": Last(F.when(action != "cancel", action))}, before=True
    )
    running = F.coalesce("_guard", "_old_guard") == "start"
    log = log.with_df(
        log.df.withColumn(
            "guarded", F.coalesce((action == "cancel") & running, F.lit(False))
        ).drop("_guard")
    )
    # A refused cancel does not renew the record, so it is left out of the times.
    log = log.running({"_previous": Last(F.when(~F.col("guarded"), F.col("ts")))}, before=True)
    gap = (
        action.isin("start", "cancel")
        & (F.col("ts") >= _kept_until(F.coalesce("_previous", "_old_ts"), hours))
    )
    log = log.running(
        {
            "_written": Greatest(F.when(action.isin(*_WRITES), _position())),
            "_gap": Greatest(F.when(gap, _position())),
        }
    )
    lost = F.coalesce("_written.ts", "_old_ts").isNull() | F.coalesce(
        F.when(F.col("_written").isNull(), F.col("_gap").isNotNull()).otherwise(
            F.col("_gap") > F.col("_written")
        ),
        F.lit(False),
    )
    return log.with_df(
        log.df.withColumn("expired", action.isin("start", "cancel") & lost).drop(
            "_previous", "_written", "_gap", "_old_guard", "_old_ts"
        )
    )


def late_actions(state: DataFrame, events: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """Actions older than the newest one already folded into the state of their job."""
    seen = state.select("job_id", F.col("seen_at").alias("_seen"))
    joined = spread_join(events, seen, ["job_id"], rows=rows)
    return joined.filter(F.col("ts") < F.col("_seen")).drop("_seen")


def judged_actions(
    events: DataFrame, hours: int = KEPT_HOURS, rows: int = ROWS_PER_TASK
) -> DataFrame:
    """Every action of the log with ``error``: why it was refused, or NULL."""
    return (
        _judge(events, hours, rows)
        .result()
        .withColumn(
            "error",
            # Error texts.
            F.when(F.col("expired"), F.lit("job not found")).when(
                F.col("guarded"), F.lit("cannot cancel job that is currently processing")
            ),
        )
        .drop("expired", "guarded")
    )


def cancel_guard(
    events: DataFrame, hours: int = KEPT_HOURS, rows: int = ROWS_PER_TASK
) -> DataFrame:
    """Cancel actions and whether they are refused because the job is being processed.

    A job whose record has run out is looked up first and not found, so its cancel is no refusal.
    """
    refused = F.col("guarded") & ~F.col("expired")
    return (
        _judge(events, hours, rows)
        .result()
        .filter(F.col("action") == "cancel")
        .select("job_id", "ts", "seq", refused.alias("refused"))
    )


def job_expiry(
    events: DataFrame, hours: int = KEPT_HOURS, rows: int = ROWS_PER_TASK
) -> DataFrame:
    """Start and cancel actions that find no record any more."""
    return (
        _judge(events, hours, rows)
        .result()
        .filter("expired")
        .select(*_LOG)
    )


def _fold(
    events: DataFrame, hours: int, rows: int, state: DataFrame | None = None
) -> DataFrame:
    """What a log, or a further part of one, does to each of its jobs."""
    judged = _judge(events, hours, rows, state).result()
    accepted = ~F.col("guarded") & ~F.col("expired")
    action, ts = F.col("action"), F.col("ts")
    ended = accepted & action.isin(*_ENDS)
    names = F.create_map(*[F.lit(part) for pair in _STATE_OF.items() for part in pair])
    return judged.groupBy("job_id").agg(
        names[F.max_by("action", F.when(accepted, _position()))].alias("status"),
        F.min(F.when(action == "enqueue", ts)).alias("created_at"),
        F.max(F.when(accepted & (action == "start"), ts)).alias("started_at"),
        F.max(F.when(ended, ts)).alias("completed_at"),
        F.max(F.when(accepted, ts)).alias("updated_at"),
        (~F.bool_or(ended)).alias("active"),
        F.max_by("action", F.when(action != "cancel", _position())).alias("guard"),
        F.max(ts).alias("seen_at"),
        *[
            F.max_by(name, F.when(accepted & F.col(name).isNotNull(), _position())).alias(name)
            for name in _carried(events)
        ],
    )


def _carried(events: DataFrame) -> list[str]:
    return [name for name in events.columns if name not in _LOG]


def visible_at(jobs: DataFrame, as_of: Column, hours: int = KEPT_HOURS) -> DataFrame:
    """Add ``visible``: whether the job still has a record at ``as_of``."""
    return jobs.withColumn("visible", as_of < _kept_until(F.col("updated_at"), hours))


def fold_jobs(
    events: DataFrame, as_of: Column, hours: int = KEPT_HOURS, rows: int = ROWS_PER_TASK
) -> DataFrame:
    """State of every job after all accepted actions of the log.

    ``active`` jobs have not ended; running out of time does not end a job. ``visible``
    jobs still have a record at ``as_of``.
    """
    folded = _fold(events, hours, rows).filter(F.col("status").isNotNull())
    return visible_at(folded.drop("guard", "seen_at"), as_of, hours)


def advance_jobs(
    state: DataFrame, events: DataFrame, hours: int = KEPT_HOURS, rows: int = ROWS_PER_TASK
) -> DataFrame:
    """Changed jobs after a further part of the log, given the state so far.

    Rows older than the newest one seen of their job are late and dropped. Only jobs with
    rows in ``events`` come out. The state has the columns of STATE_SCHEMA.
    """
    new = _fold(events.select(*_LOG), hours, rows, state)
    old = state.select("job_id", F.struct(*state.columns).alias("old"))
    both = new.join(old, "job_id", "left")

    def newest(name: str) -> Column:
        return F.coalesce(F.col(name), F.col(f"old.{name}")).alias(name)

    return both.select(
        "job_id",
        newest("status"),
        F.coalesce("old.created_at", "created_at").alias("created_at"),
        *[newest(name) for name in ("started_at", "completed_at", "updated_at")],
        (F.col("active") & F.coalesce("old.active", F.lit(True))).alias("active"),
        newest("guard"),
        newest("seen_at"),
    ).filter(F.col("status").isNotNull())


def enqueue(requests: DataFrame, now: Column) -> DataFrame:
    """Log rows for new jobs, from checked requests (``request_id, target, …``).

    The id is made from the request, so a task that is run again makes the same one.
    """
    digest = F.md5(F.concat_ws("|", F.col("request_id").cast("string"), now.cast("string")))
    job_id = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return requests.select(
        job_id.alias("job_id"),
        now.alias("ts"),
        F.col("request_id").cast("long").alias("seq"),
        F.lit("enqueue").alias("action"),
        F.col("target").alias("url"),
        "webhook_url",
        F.when(F.col("callback_id") != "", F.col("callback_id")).alias("callback_id"),
    )


def start(ids: DataFrame, now: Column, seq: Column) -> DataFrame:
    """Log rows for jobs taken from the queue."""
    return _actions(ids, "start", now, seq)


def complete(outcomes: DataFrame, now: Column, seq: Column) -> DataFrame:
    """Log rows for finished scans, with their figures."""
    return _actions(outcomes, "complete", now, seq, "pages_visited", "n_emails", "crawl_seconds")


def fail(errors: DataFrame, now: Column, seq: Column) -> DataFrame:
    """Log rows for scans that failed, with their error."""
    return _actions(errors, "fail", now, seq, "error")


def cancel(jobs: DataFrame, ids: DataFrame, now: Column, seq: Column) -> tuple[DataFrame, DataFrame]:
    """Log rows for jobs that may be cancelled, and the refused ids with the reason.

    Every state but processing may be cancelled, finished jobs too.
    """
    asked = ids.select("job_id").join(jobs.select("job_id", "status", "visible"), "job_id", "left")
    error = F.when(
        ~F.coalesce("visible", F.lit(False)), F.lit("job not found")
    ).when(F.col("status") == "processing", F.lit("cannot cancel job that is currently processing"))
    judged = asked.withColumn("error", error)
    return (
        _actions(judged.filter(F.col("error").isNull()), "cancel", now, seq),
        judged.filter(F.col("error").isNotNull()).select("job_id", "error"),
    )


def _actions(ids: DataFrame, action: str, now: Column, seq: Column, *fields: str) -> DataFrame:
    return ids.select(
        "job_id",
        now.alias("ts"),
        seq.cast("long").alias("seq"),
        F.lit(action).alias("action"),
        *[field for field in fields if field in ids.columns],
    )


def latest_jobs(updates: DataFrame) -> DataFrame:
    """Last written record per job."""
    newest = updates.groupBy("job_id").agg(
        F.max_by(F.struct(*updates.columns), F.col("updated_at")).alias("job")
    )
    return newest.select("job.*")


def write_jobs(jobs: DataFrame, path: str) -> None:
    """Write the job table to a new folder."""
    jobs.write.parquet(path)


def job_status(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Jobs for the asked ids; ``error`` where there is no record (any more)."""
    visible = jobs.filter("visible")
    return (
        ids.select("job_id")
        .join(visible, "job_id", "left")
        .withColumn("error", F.when(F.col("status").isNull(), F.lit("Job not found")))
    )


def queue_next(jobs: DataFrame, n: int) -> DataFrame:
    """The next ``n`` queued jobs, oldest first."""
    return jobs.filter(F.col("status") == "queued").orderBy("created_at", "job_id").limit(n)


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Ids of jobs that have not ended; rows, since there may be any number of them."""
    return jobs.filter("active").select("job_id")


def remove_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose job is not among ``ids``."""
    return df.join(ids.select("job_id"), "job_id", "left_anti")


def queue_stats(jobs: DataFrame) -> DataFrame:
    """One row: jobs waiting and jobs not ended."""
    return jobs.agg(
        F.count_if(F.col("status") == "queued").alias("queue_size"),
        F.count_if(F.col("active")).alias("active_jobs"),
    )


def jobs_overview(jobs: DataFrame, options: ScanOptions) -> DataFrame:
    """Queue figures beside the settings of the workers."""
    return queue_stats(jobs).select(
        F.lit(options.async_enabled).alias("async_enabled"),
        "queue_size",
        "active_jobs",
        F.lit(options.async_workers).alias("workers"),
        F.lit(options.job_timeout_s).alias("job_timeout_s"),
    )
