"""Batch mode of model inference: B7 and F17 through a provider's batch interface.

Tasks are cut into chunks of requests with custom ids (F17).  Chunks are
submitted, polled and fetched by Spark jobs over tables under one folder:

* ``submitted/round=r``: chunk, batch id, number of requests;
* ``ended/round=r/poll=p``: chunks that ended at that poll;
* ``fetched/round=r/poll=p``: their results by custom id, in any order, as far
  as the provider has them.

Each step writes its table before the next one starts, and each begins with
what the tables don't hold yet.  So a run that stops anywhere goes on where it
was: chunks that are on record aren't submitted again, ended ones aren't polled,
fetched ones aren't fetched.  A chunk also has a key made of its requests; a
client gives back the batch it has for a key, so neither a repeated task nor a
crash between a call and its record makes a second batch.

Results that failed or never came are sent again in the next round.  Only
counts reach the driver.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.operators.inference import OUT_SCHEMA, StubExtractionClient, accumulate_rounds, failed_tasks
from spanweave.operators.planning import custom_id
from spanweave.session import children

CHUNK = 10
SUBMITTED = "chunk long, batch_id string, requests long"
FETCHED = "custom_id string, ok boolean, body string, input_tokens long, output_tokens long, error string"


class BatchClient(Protocol):
    """What a provider's batch interface has to offer."""

    def submit(self, key: str, requests: list[tuple[str, str]]) -> str:
        """Start a batch of (custom id, prompt) and return its id; the id of the
        batch that already has this key, where there is one."""

    def ended(self, batch_id: str) -> bool:
        """Whether the batch has ended."""

    def results(self, batch_id: str) -> Iterable[tuple[str, bool, str | None, int, int, str | None]]:
        """(custom id, ok, body, input tokens, output tokens, error) in any order;
        requests without a result may be missing."""


class FolderBatchClient:
    """A batch interface over a shared folder (tests, benchmarks, hand-over to
    other programs): a batch is one file of requests.

    It answers with ``StubExtractionClient``: a batch ends at the poll its id's
    hash says, results come in the order of their ids' hashes, failed requests
    come back as errors, and of those every second one not at all."""

    def __init__(self, folder: str, attempt: int = 0):
        from pyarrow import fs
        self.fs, self.folder = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.attempt, self.answer = attempt, StubExtractionClient()

    def _exists(self, path: str) -> bool:
        return self.fs.get_file_info(path).is_file

    def _write(self, path: str, text: str) -> None:
        """All of a file or nothing."""
        import uuid
        part = f"{path}.{uuid.uuid4().hex}.part"
        with self.fs.open_output_stream(part) as f:
            f.write(text.encode())
        self.fs.move(part, path)

    def _read(self, path: str):
        with self.fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def submit(self, key: str, requests: list[tuple[str, str]]) -> str:
        path = f"{self.folder}/{key}.json"
        if not self._exists(path):
            self._write(path, json.dumps({"attempt": self.attempt, "requests": requests}))
        return key

    def ended(self, batch_id: str) -> bool:
        needed = int(batch_id[:1], 16) % 3
        polled = sum(self._exists(f"{self.folder}/{batch_id}.polled{i}") for i in range(needed))
        if polled < needed:
            self._write(f"{self.folder}/{batch_id}.polled{polled}", "1")
        return polled >= needed

    def results(self, batch_id: str):
        batch = self._read(f"{self.folder}/{batch_id}.json")
        for name, prompt in sorted(batch["requests"], key=lambda r: hashlib.md5(r[0].encode()).hexdigest()):
            try:
                yield (name, True, *self.answer(prompt, batch["attempt"]), None)
            except RuntimeError as ex:
                if int(name[-1]) % 2:
                    yield name, False, None, 0, 0, str(ex)


def chunk_requests(tasks: DataFrame, chunk_size: int = CHUNK, prompt_col: str = "prompt") -> DataFrame:
    """``chunk, custom_id, prompt`` of the tasks."""
    return tasks.select(F.floor(F.col("task_id") / chunk_size).cast("bigint").alias("chunk"), custom_id(F.col("task_id")).alias("custom_id"),
                        F.col(prompt_col).alias("prompt"))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of committed parts (``path`` or its folders); empty where there is none."""
    names = children(spark, path)
    parts = [path] if "_SUCCESS" in names else [f"{path}/{c}" for c in names if "_SUCCESS" in children(spark, f"{path}/{c}")]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def submit_chunks(requests: DataFrame, client_factory: Callable[[], BatchClient], path: str) -> DataFrame:
    """Submit every chunk that isn't on record; returns the record."""
    spark = requests.sparkSession

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["custom_id"], pdf["prompt"]))
        key = hashlib.md5(json.dumps([int(pdf["chunk"].iloc[0]), rows]).encode()).hexdigest()
        return pd.DataFrame([(pdf["chunk"].iloc[0], client_factory().submit(key, rows), len(rows))], columns=["chunk", "batch_id", "requests"])

    known = _table(spark, path, SUBMITTED)
    fresh = requests.join(known.select("chunk"), "chunk", "left_anti")
    if not fresh.isEmpty():
        part = f"{path}/part={len(children(spark, path)):06d}"
        fresh.groupBy("chunk").applyInPandas(run, SUBMITTED).write.mode("errorifexists").parquet(part)
    return _table(spark, path, SUBMITTED)


def poll_chunks(pending: DataFrame, client_factory: Callable[[], BatchClient], path: str, poll: int) -> DataFrame:
    """Ask for every pending chunk once; those that ended are recorded and returned."""
    def run(batches):
        client = client_factory()
        for pdf in batches:
            yield pdf[[client.ended(b) for b in pdf["batch_id"]]]

    pending.mapInPandas(run, SUBMITTED).write.mode("overwrite").parquet(f"{path}/poll={poll:06d}")
    return pending.sparkSession.read.schema(SUBMITTED).parquet(f"{path}/poll={poll:06d}")


def fetch_chunks(ended: DataFrame, client_factory: Callable[[], BatchClient], path: str, poll: int) -> None:
    """Record the results of ended chunks by custom id."""
    def run(batches):
        client = client_factory()
        for pdf in batches:
            for b in pdf["batch_id"]:
                yield pd.DataFrame(list(client.results(b)), columns=["custom_id", "ok", "body", "input_tokens", "output_tokens", "error"])

    ended.mapInPandas(run, FETCHED).write.mode("overwrite").parquet(f"{path}/poll={poll:06d}")


def by_task(tasks: DataFrame, fetched: DataFrame, attempt: int) -> DataFrame:
    """One RESPONSE row per task from results by custom id; a task without a
    result failed.  Of repeated results of a task a successful one counts."""
    best = fetched.groupBy("custom_id").agg(F.max_by(F.struct(*[c for c in fetched.columns if c != "custom_id"]),
                                                     F.struct(F.col("ok").cast("int"), F.coalesce("body", F.lit("")))).alias("r"))
    j = tasks.select("task_id", custom_id(F.col("task_id")).alias("custom_id")).join(best, "custom_id", "left")
    ok = F.coalesce("r.ok", F.lit(False))
    return j.select("task_id", F.lit(attempt).alias("attempt"), ok.alias("ok"), F.when(ok, F.col("r.body")).alias("body"),
                    F.coalesce("r.input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("r.output_tokens", F.lit(0)).alias("output_tokens"),
                    F.when(~ok, F.coalesce("r.error", F.lit("no result"))).alias("error"))


def run_round(tasks: DataFrame, client_factory: Callable[[], BatchClient], path: str, attempt: int = 0, chunk_size: int = CHUNK,
              prompt_col: str = "prompt", poll_interval: float = 0.0, max_polls: int = 10_000) -> DataFrame:
    """Submit, poll and fetch until every chunk has ended (or ``max_polls``);
    results come back as their chunks end.  Goes on where an earlier run with
    the same ``path`` stopped."""
    spark, of = tasks.sparkSession, f"round={attempt}"
    ended_path, fetched_path = f"{path}/ended/{of}", f"{path}/fetched/{of}"
    submitted = submit_chunks(chunk_requests(tasks, chunk_size, prompt_col), client_factory, f"{path}/submitted/{of}")
    # polls on record whose results aren't: fetched first
    for name in children(spark, ended_path):
        done = "_SUCCESS" in children(spark, f"{ended_path}/{name}")
        if done and "_SUCCESS" not in children(spark, f"{fetched_path}/{name}"):
            fetch_chunks(spark.read.schema(SUBMITTED).parquet(f"{ended_path}/{name}"), client_factory, fetched_path, int(name[5:]))
    poll = len(children(spark, ended_path))
    for poll in range(poll, poll + max_polls):
        pending = submitted.join(_table(spark, ended_path, SUBMITTED).select("chunk"), "chunk", "left_anti")
        if pending.isEmpty():
            break
        fetch_chunks(poll_chunks(pending, client_factory, ended_path, poll), client_factory, fetched_path, poll)
        time.sleep(poll_interval)
    return by_task(tasks, _table(spark, fetched_path, FETCHED), attempt)


def run_batch_inference(tasks: DataFrame, client_factory: Callable[[int], BatchClient], path: str, rounds: int = 2, **options) -> DataFrame:
    """B7 in batch mode: one RESPONSE row per task, like ``run_inference``; tasks
    without a good result are sent again in up to ``rounds`` further rounds.
    ``client_factory`` gets the round's number."""
    spark, pending = tasks.sparkSession, tasks
    for r in range(rounds + 1):
        out = f"{path}/responses/round={r}"
        if "_SUCCESS" not in children(spark, out):
            run_round(pending, lambda r=r: client_factory(r), path, r, **options).write.mode("overwrite").parquet(out)
        pending = failed_tasks(pending, spark.read.schema(OUT_SCHEMA).parquet(out))
        if pending.isEmpty():
            break
    return accumulate_rounds(_table(spark, f"{path}/responses", OUT_SCHEMA))
