"""Run windows with late data, and batch inference that goes on after a crash."""

import os

import pytest
from pyspark.sql import functions as F

from spanweave.operators import batching as B
from spanweave.operators import inference
from spanweave.session import children
from spanweave.streaming import jobs


def feed(spark, path, *stamps):
    rows = [("m", "success", s) for s in stamps]
    spark.createDataFrame(rows, jobs.RUN_LOG).write.mode("append").json(path)


def windows(df):
    return {(str(r.start)[:10], r.status): (r.runs, r.closed) for r in df.collect()}


def test_late_runs_are_dropped_and_counted(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    feed(spark, src, "20250101_120000", "20250103_120000", "not a stamp")
    jobs.stream_runs(spark, src, out, ck)
    assert windows(jobs.runs_per_window(spark, out, ck)) == {("2025-01-01", "success"): (1, True), ("2025-01-03", "success"): (1, False)}
    feed(spark, src, "20250101_130000", "20250102_235959")  # the first is late; the second's window is open until the 3rd, 12:00
    jobs.stream_runs(spark, src, out, ck)
    counted = jobs.runs_per_window(spark, out, ck)
    audit = {(str(r.start)[:10]): (r.runs, r.late) for r in jobs.late_runs(spark, src, counted).collect()}
    assert audit["2025-01-01"] == (1, 1) and audit["2025-01-03"] == (1, 0)
    assert sum(r + n for r, n in audit.values()) == 4  # every stamped run is counted or late
    jobs.stream_runs(spark, src, out, ck)  # nothing new: nothing changes
    assert windows(jobs.runs_per_window(spark, out, ck)) == windows(counted)


def test_state_holds_open_windows_only(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for first in (1, 11, 21):
        feed(spark, src, *[f"202501{d:02d}_120000" for d in range(first, first + 10)])
        jobs.stream_runs(spark, src, out, ck)
        assert jobs.open_windows(spark, ck).count() <= 2
    assert jobs.closed_windows(spark, out).count() + jobs.open_windows(spark, ck).count() == 30


def test_no_input_at_all(spark, tmp_path):
    assert jobs.runs_per_window(spark, str(tmp_path / "out"), str(tmp_path / "ck")).collect() == []


def test_old_states_are_removed(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "entities array<struct<type:string>>"
    for i in range(4):
        spark.createDataFrame([([("person",)],)], schema).write.mode("append").json(src)
        jobs.stream_distribution(spark, src, out, ck, schema=schema)
    assert jobs.latest(spark, out).first().n == 4 and len(children(spark, out)) == jobs.KEPT_STATES


class Provider(B.FolderBatchClient):
    """Counts its calls; ``fetches``: how many results calls work before it fails."""

    def __init__(self, folder, attempt=0, fetches=10**9):
        super().__init__(folder, attempt)
        self.fetches = fetches

    def count(self, what):
        return len([f for f in os.listdir(self.folder) if f.startswith(f"call-{what}-")])

    def note(self, what):
        import uuid
        open(f"{self.folder}/call-{what}-{uuid.uuid4().hex}", "w").close()

    def submit(self, key, requests):
        self.note("submit")
        return super().submit(key, requests)

    def results(self, batch_id):
        self.note("results")
        if self.count("results") > self.fetches:
            raise ConnectionError("provider gone")
        return super().results(batch_id)


def tasks(spark, n=57):
    return spark.range(n).select(F.col("id").alias("task_id"), F.format_string("\nText: Some Words of Number%d here\nAnswer:", "id").alias("prompt"))


def rows(df):
    return sorted(map(tuple, df.select("task_id", "attempt", "ok", "body", "input_tokens", "output_tokens").collect()))


def test_batch_mode_equals_direct_mode(spark, tmp_path):
    folder = str(tmp_path / "provider")
    got = B.run_batch_inference(tasks(spark), lambda r: Provider(folder, r), str(tmp_path / "run"))
    direct = inference.run_inference(tasks(spark), inference.StubExtractionClient, max_retries=3)
    assert rows(got) == rows(direct)
    assert any(r[1] == 1 for r in rows(got))  # some were sent again


def test_crash_between_submit_and_fetch_submits_nothing_again(spark, tmp_path):
    folder, path = str(tmp_path / "provider"), str(tmp_path / "run")
    t = tasks(spark)
    with pytest.raises(Exception, match="provider gone"):
        B.run_round(t, lambda: Provider(folder, 0, fetches=0), path)
    client = Provider(folder)
    submits, kept = client.count("submit"), len([f for f in os.listdir(folder) if f.endswith(".json")])
    assert submits == kept == 6
    got = B.run_round(t, lambda: Provider(folder), path)
    assert client.count("submit") == submits and got.count() == 57
    failed = got.where("not ok").collect()
    assert {r.error for r in failed} <= {"no result", "simulated rate limit"} and failed
    # all on record: nothing is asked again
    fetched = client.count("results")
    assert rows(B.run_round(t, lambda: Provider(folder), path)) == rows(got) and client.count("results") == fetched


def test_lost_record_makes_no_second_batch(spark, tmp_path):
    folder = str(tmp_path / "provider")
    requests = B.chunk_requests(tasks(spark))
    first = B.submit_chunks(requests, lambda: Provider(folder), str(tmp_path / "a")).collect()
    again = B.submit_chunks(requests, lambda: Provider(folder), str(tmp_path / "b")).collect()  # as after a crash before the record
    assert sorted(first) == sorted(again) and len([f for f in os.listdir(folder) if f.endswith(".json")]) == 6


def test_no_tasks(spark, tmp_path):
    assert B.run_batch_inference(tasks(spark, 0), lambda r: Provider(str(tmp_path / "p"), r), str(tmp_path / "run")).collect() == []
