"""Job state kept up to date from a stream of actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from contactloom.operators.jobs import KEPT_HOURS, STATE_SCHEMA, advance_jobs, late_actions
from contactloom.operators.skew import ROWS_PER_TASK
from contactloom.session import stored


def read_state(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The jobs as a batch left them; none before the first batch."""
    if batch_id < 0:
        return spark.createDataFrame([], STATE_SCHEMA)
    return spark.read.schema(STATE_SCHEMA).parquet(f"{path}/state/batch={batch_id}")


def expire_jobs(state: DataFrame, hours: int = KEPT_HOURS) -> DataFrame:
    """Without jobs that have ended and whose record has run out by the newest action.

    This bounds the state. An end that is reported again for such a job counts as its first.
    """
    newest = state.agg(F.max("seen_at")).first()[0]
    kept = F.col("updated_at") + F.make_dt_interval(hours=F.lit(hours))
    return state.filter(F.col("active") | (kept > F.lit(newest).cast("timestamp")))


def advance_batch(
    events: DataFrame, path: str, batch_id: int, hours: int, forget: bool, rows: int
) -> None:
    """Fold one batch into the state the batch before left, and write both to its folders.

    The jobs of a batch are folded like a whole log, with windows that a busy job spans
    over several tasks. The same batch run again writes the same folders again. Actions that come
    after a newer one of their job was folded are not: they are written to ``late``.
    """
    before = read_state(events.sparkSession, path, batch_id - 1)
    late = late_actions(before, events, rows)
    late.write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
    changed = stored(advance_jobs(before, events, hours, rows))
    changed.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")
    state = before.join(changed.select("job_id"), "job_id", "left_anti").unionByName(changed)
    if forget:
        state = expire_jobs(state, hours)
    state.write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")


def stream_job_state(
    events: DataFrame,
    path: str,
    hours: int = KEPT_HOURS,
    forget: bool = False,
    rows: int = ROWS_PER_TASK,
) -> DataStreamWriter:
    """A writer that keeps the state of all jobs; set its trigger and start it.

    Needs ``job_id, ts, seq, action``. Per batch it writes the jobs that changed and the
    state of all jobs. With ``forget`` ended jobs are given up once their record has run out.
    """

    def advance(batch: DataFrame, batch_id: int) -> None:
        advance_batch(batch, path, batch_id, hours, forget, rows)

    return (
        events.select("job_id", "ts", "seq", "action")
        .writeStream.foreachBatch(advance)
        .option("checkpointLocation", f"{path}/progress")
    )
