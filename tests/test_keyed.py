"""Job state in a keyed state store with event-time timers."""

import datetime as dt
import uuid

from contactloom.plans import queries as Q
from contactloom.session import shared_dir
from contactloom.streaming import keyed

T0 = dt.datetime(2024, 1, 1)
HOUR = 3_600_000_000


def _us(t):
    return int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def test_fold_job_guards_and_records():
    t = _us(T0)
    state, late = keyed.fold_job(None, [(t, 1, "enqueue"), (t + 1, 2, "start"), (t + 2, 3, "cancel")], 24)
    assert state["status"] == "processing" and state["active"] and late == []
    # The cancel was refused while the job ran; a later end is accepted.
    state, late = keyed.fold_job(state, [(t + 1, 9, "fail"), (t + 3, 4, "complete")], 24)
    assert late == [(t + 1, 9, "fail")]
    assert state["status"] == "completed" and not state["active"] and state["completed_at"] == t + 3
    # A start a day after the last change finds no record.
    again, _ = keyed.fold_job(state, [(t + 3 + 25 * HOUR, 5, "start")], 24)
    assert again["status"] == "completed" and again["updated_at"] == t + 3
    # Nothing before an enqueue counts.
    assert keyed.fold_job(None, [(t, 1, "start")], 24)[0] is None


def test_keyed_stream_equals_the_stream_that_rewrites_all(spark):
    sf = "/root/testdata/sf0.001"
    keyed_rows = sorted(map(tuple, Q.stream_job_keyed(spark, sf).collect()), key=str)
    whole_rows = sorted(map(tuple, Q.stream_job_state(spark, sf).collect()), key=str)
    assert keyed_rows == whole_rows and keyed_rows


def _run(spark, folder, parts, expire=True):
    schema = "job_id string, ts timestamp, seq long, action string"
    progress = []
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(schema).parquet(f"{folder}/in")
        query = keyed.stream_keyed_jobs(source, folder, hours=24, expire=expire).trigger(availableNow=True).start()
        query.awaitTermination()
        progress += [p for p in query.recentProgress if p["numInputRows"]]
    return spark.read.schema(keyed.OUTPUT).parquet(f"{folder}/out"), progress


def test_timers_forget_ended_jobs_and_writes_follow_the_batch(spark):
    folder = f"{shared_dir(spark)}/test-keyed/{uuid.uuid4().hex}"
    h = dt.timedelta(hours=1)
    first = [("a", T0, 1, "enqueue"), ("a", T0 + h, 2, "complete"), ("b", T0, 3, "enqueue"), ("b", T0 + h, 4, "start")]
    first += [(f"x{i}", T0, 10 + i, "enqueue") for i in range(20)]
    second = [("c", T0 + 30 * h, 5, "enqueue")]
    third = [("c", T0 + 31 * h, 6, "start")]
    changes, progress = _run(spark, folder, [first, second, third])
    expired = {r.job_id for r in changes.filter("kind = 'expired'").collect()}
    assert expired == {"a"}
    last = {r.job_id: r for r in keyed.latest_states(changes).collect()}
    assert "a" not in last and last["b"].status == "processing" and last["c"].status == "processing"
    # State rows written per batch: the jobs of that batch, not all jobs.
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in progress]
    assert updated[0] >= 22 and all(n <= 2 for n in updated[1:])


def test_a_changed_job_writes_one_row_of_state(spark):
    folder = f"{shared_dir(spark)}/test-keyed/{uuid.uuid4().hex}"
    first = [(f"x{i}", T0, i, "enqueue") for i in range(50)]
    changes, progress = _run(spark, folder, [first], expire=False)
    assert progress[0]["stateOperators"][0]["numRowsUpdated"] == 50
    assert {(r.job_id, r.revision) for r in changes.collect()} == {(f"x{i}", 1) for i in range(50)}


def test_processor_answers_a_bucket_at_once():
    import pandas as pd

    class Store(dict):
        def getValue(self, key):
            return self.get(key)

        def updateValue(self, key, value):
            self[key] = value

    fold = keyed.JobFold(expire=False)
    fold.jobs = Store()
    t = _us(T0)
    log = [(f"x{i}", t + k, k, a) for i in range(40) for k, a in ((2, "complete"), (0, "enqueue"))]
    frames = [pd.DataFrame(log[at : at + 30], columns=["job_id", "ts_us", "seq", "action"]) for at in (0, 30, 60)]
    out = list(fold.handleInputRows((7,), iter(frames), None))
    assert len(out) == 1 and out[0]["job_id"].nunique() == len(out[0]) == len(fold.jobs) == 40
    assert set(out[0]["status"]) == {"completed"}


def test_many_jobs_of_a_bucket_are_read_in_one_go():
    import pandas as pd

    class Store(dict):
        calls = 0

        def getValue(self, key):
            self.calls += 1
            return self.get(key)

        def updateValue(self, key, value):
            self[key] = value

        def values(self):
            return iter(list(super().values()))

    fold = keyed.JobFold(expire=False)
    fold.jobs = Store()
    t, n = _us(T0), 10 * keyed.MANY_JOBS

    def fed(jobs, k, action):
        rows = pd.DataFrame([(job, t + k, k, action) for job in jobs], columns=["job_id", "ts_us", "seq", "action"])
        (out,) = fold.handleInputRows((7,), iter([rows]), None)
        return {r.job_id: (r.status, r.created_at, r.revision) for r in out.itertuples()}

    names = [None, *(f"x{i}" for i in range(1, n))]
    assert fed(names, 0, "enqueue") == dict.fromkeys(names, ("queued", t, 1)) and len(fold.jobs) == n
    assert fed(names, 1, "start") == dict.fromkeys(names, ("processing", t, 2)) and fold.jobs.calls == 0
    # Few of the jobs: reading stops after READ_AHEAD stored jobs for each, the others are asked for.
    few = [*names[: 1], *names[-keyed.MANY_JOBS + 1 :]]
    assert fed(few, 2, "fail") == dict.fromkeys(few, ("failed", t, 3))
    assert 0 < fold.jobs.calls < len(few) and len(fold.jobs) == n


def test_refold_counts_actions_that_came_before_their_enqueue(spark):
    folder = f"{shared_dir(spark)}/test-keyed/{uuid.uuid4().hex}"
    schema = "job_id string, ts timestamp, seq long, action string"
    h = dt.timedelta(hours=1)
    for part in ([("a", T0 + h, 2, "start")], [("a", T0, 1, "enqueue"), (None, T0, 3, "enqueue")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(schema).parquet(f"{folder}/in")
        writer = keyed.stream_keyed_jobs(source, folder, expire=False, refold=True)
        writer.trigger(availableNow=True).start().awaitTermination()
    last = keyed.latest_states(spark.read.schema(keyed.OUTPUT).parquet(f"{folder}/out"))
    assert {r.job_id: r.status for r in last.collect()} == {"a": "processing", None: "queued"}
