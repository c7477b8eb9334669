"""Jobs with states: failures, countdowns, restarts, repeats."""

import os
import time

from tessera.sources import sink
from tessera.streaming import jobs


def _steps(folder, countdown=1.0):
    """Texts say how often they fail, and where; runs are counted in files, as workers share no memory."""

    def fails(step, text):
        name, times = text.split()[:2]
        path = f"{folder}/{step}-{text.replace(' ', '_')}"
        with open(path, "ab") as f:
            f.write(b".")
        return name == step and os.path.getsize(path) <= int(times)

    def extract(text):
        if fails("extract", text):
            raise ValueError(f"no reply to {text}")
        return text.upper()

    def store(text):
        if fails("store", text.lower()):
            raise ConnectionError
        return text + "!"

    return jobs.steps(extract, store, (countdown, countdown))


def _put(spark, path, rows):
    spark.createDataFrame(rows, jobs.REQUESTS).coalesce(1).write.mode("append").parquet(path)


def _runs(folder):
    return {f: os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder)}


def test_failures_are_run_again_and_jobs_end_once(spark, tmp_path):
    source, target, state, log = (f"{tmp_path}/{x}" for x in ("in", "out", "state", "log"))
    os.mkdir(log)
    _put(spark, source, [("a", "never 0 x"), ("b", "extract 2 x"), ("c", "extract 9 x"), ("d", "store 1 x"), ("e", ""), ("f", None), (None, "never 0 y"), ("a", "never 0 x")])
    q = jobs.start(spark, source, target, state, _steps(log), every="500 milliseconds")
    jobs.drain(q, lambda: jobs.ended(spark, target).count() >= 6, 150)
    # the same requests again, and one more, after a restart
    _put(spark, source, [("a", "never 0 z"), ("c", "extract 9 x"), ("g", "never 0 g")])
    q = jobs.start(spark, source, target, state, _steps(log), every="500 milliseconds")
    jobs.drain(q, lambda: jobs.ended(spark, target).filter("job_id = 'g'").count() == 1, 150)
    rows = jobs.ended(spark, target).collect()
    assert len(rows) == 7
    got = {r.job_id: (r.status, r.retries, r.error, r.result) for r in rows}
    assert got == {
        "a": ("completed", 0, None, "NEVER 0 X!"), "b": ("completed", 2, None, "EXTRACT 2 X!"), "c": ("failed", 3, "extract: no reply to extract 9 x", None),
        "d": ("completed", 1, None, "STORE 1 X!"), "e": ("failed", 0, "Empty content", None), "f": ("failed", 0, "Empty content", None), "g": ("completed", 0, None, "NEVER 0 G!")}
    runs = _runs(log)
    assert runs["extract-extract_9_x"] == 4 and runs["extract-store_1_x"] == 2 and "extract-never_0_z" not in runs
    assert jobs.waiting(spark, state).count() == 0


def test_a_job_waits_through_a_restart(spark, tmp_path):
    source, target, state, log = (f"{tmp_path}/{x}" for x in ("in", "out", "state", "log"))
    os.mkdir(log)
    _put(spark, source, [("slow", "extract 1 s"), ("quick", "never 0 q")])
    q = jobs.start(spark, source, target, state, _steps(log, countdown=12), every="500 milliseconds")
    began = time.monotonic()
    jobs.drain(q, lambda: jobs.ended(spark, target).count() == 1, 150)
    assert [tuple(r) for r in jobs.waiting(spark, state).collect()] == [("slow", "extract 1 s", 1)]
    assert _runs(log)["extract-extract_1_s"] == 1
    q = jobs.start(spark, source, target, state, _steps(log, countdown=12), every="500 milliseconds")
    jobs.drain(q, lambda: jobs.ended(spark, target).count() == 2, 150)
    assert time.monotonic() - began > 8  # the countdown was kept
    assert _runs(log)["extract-extract_1_s"] == 2
    assert {(r.job_id, r.status, r.retries) for r in jobs.ended(spark, target).collect()} == {("slow", "completed", 1), ("quick", "completed", 0)}


def test_what_has_ended_can_be_forgotten(spark, tmp_path):
    source, target, state, log = (f"{tmp_path}/{x}" for x in ("in", "out", "state", "log"))
    os.mkdir(log)
    for n in (1, 2):
        _put(spark, source, [("a", f"never 0 {n}")])
        q = jobs.start(spark, source, target, state, _steps(log), forget=0.5, every="500 milliseconds")
        jobs.drain(q, lambda: jobs.ended(spark, target).count() == n, 150)
        time.sleep(1)
    assert sorted(r.result for r in jobs.ended(spark, target).collect()) == ["NEVER 0 1!", "NEVER 0 2!"]


def test_a_batch_that_is_written_again_replaces_its_rows(spark, tmp_path):
    def put(number, rows):
        folder = f"{tmp_path}/data-{os.urandom(4).hex()}"
        spark.createDataFrame(rows, "k long").write.parquet(folder)
        sink.put_batch(spark, str(tmp_path), number, folder)

    assert sink.batch_files(spark, str(tmp_path)) == []
    for number, rows in ((1, [(1,), (2,)]), (2, []), (3, [(3,)]), (4, [(9,)]), (1, [(1,)]), (4, [])):
        put(number, rows)
    assert sorted(r.k for r in spark.read.parquet(*sink.batch_files(spark, str(tmp_path))).collect()) == [1, 3]
