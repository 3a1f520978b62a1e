"""Model inference as Spark jobs: B7 run_inference, B8 retry_rounds, J3, J4,
U4, A15, A16.

B7 is the only operator that needs Python workers: each partition creates its
own client from a factory (no client is pickled from the driver) and calls it
row by row with retries, in Arrow batches via ``mapInPandas``.  Concurrency is
the number of partitions times the executor slots; throttle it with the
partition count.  Results are written after every round (the call is
expensive and not repeatable), which also cuts the lineage.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT_SCHEMA = ("task_id long, attempt int, ok boolean, body string, input_tokens long, "
              "output_tokens long, error string")


class StubExtractionClient:
    """Deterministic stand-in for a model API (tests and benchmarks).

    It answers extraction prompts with the capitalised words of the text (the
    same heuristic as the derived gold annotations), and fails the first call
    for prompts whose md5 starts with ``0`` so that retries are exercised.
    ``noisy`` answers miss names whose md5 starts with ``0`` or ``1`` and call
    those with ``2`` or ``3`` a person.
    """

    _word = re.compile(r"[^ ]+")

    def __init__(self, fail_first: bool = True, noisy: bool = False):
        self.fail_first, self.noisy = fail_first, noisy

    def __call__(self, prompt: str, attempt: int) -> tuple[str, int, int]:
        if self.fail_first and attempt == 0 and hashlib.md5(prompt.encode()).hexdigest()[0] == "0":
            raise RuntimeError("simulated rate limit")
        text = prompt.split("\nText: ", 1)[-1].rsplit("\nAnswer:", 1)[0]
        ents = []
        for m in self._word.finditer(text):
            name = m.group(0).rstrip(".,;:!?|")
            if len(name) >= 4 and "A" <= name[0] <= "Z":
                t = ("person", "location", "damage", "datetime", "work")[len(name) % 5]
                digit = hashlib.md5(name.encode()).hexdigest()[0] if self.noisy else ""
                if digit and digit in "01":      # missed
                    continue
                if digit and digit in "23":      # mislabelled
                    t = "person"
                ents.append({"type": t, "text": name, "span": [m.start(), m.start() + len(name)]})
        body = json.dumps(ents, ensure_ascii=False)
        return body, len(prompt) // 4, len(body) // 4


def run_inference(tasks: DataFrame, client_factory: Callable[[], Callable], prompt_col: str = "prompt",
                  id_col: str = "task_id", max_retries: int = 3, attempt_base: int = 0) -> DataFrame:
    """One RESPONSE row per task; ``ok = false`` and NULL body on failure."""
    def run(batches):
        client = client_factory()
        for pdf in batches:
            out = []
            for tid, prompt in zip(pdf[id_col], pdf[prompt_col]):
                row = None
                for k in range(max(max_retries, 1)):
                    attempt = attempt_base + k
                    try:
                        body, it, ot = client(prompt, attempt)
                        row = (tid, attempt, True, body, it, ot, None)
                        break
                    except Exception as ex:  # noqa: BLE001 - a failed call is data
                        row = (tid, attempt, False, None, 0, 0, str(ex))
                out.append(row)
            yield pd.DataFrame(out, columns=["task_id", "attempt", "ok", "body", "input_tokens",
                                             "output_tokens", "error"])
    return tasks.select(F.col(id_col).alias(id_col), prompt_col).mapInPandas(run, OUT_SCHEMA)


def failed_tasks(tasks: DataFrame, responses: DataFrame, id_col: str = "task_id") -> DataFrame:
    """Tasks without a successful response, for another round."""
    return tasks.join(responses.where("ok").select(id_col), id_col, "left_anti")


def retry_rounds(tasks: DataFrame, client_factory, out_path: str, rounds: int = 2,
                 prompt_col: str = "prompt", max_retries: int = 1) -> DataFrame:
    """B8 + U4: round 0 over all tasks, then up to ``rounds`` retry rounds over
    the failed ones; each round is written to ``out_path/round=<r>`` and the
    union of all rounds is returned."""
    spark = tasks.sparkSession
    pending = tasks
    for r in range(rounds + 1):
        res = run_inference(pending, client_factory, prompt_col, max_retries=max_retries,
                            attempt_base=r * max_retries)
        res.write.mode("overwrite").parquet(f"{out_path}/round={r}")
        written = spark.read.parquet(f"{out_path}/round={r}")
        pending = failed_tasks(pending, written)
        if not pending.select("task_id").take(1):
            break
    return accumulate_rounds(spark.read.parquet(out_path))


def accumulate_rounds(all_rounds: DataFrame) -> DataFrame:
    """U4: the successes of every round plus the last failure of tasks that
    never succeeded, one row per task."""
    k = F.struct(F.col("ok").cast("int").alias("o"), F.col("attempt").alias("a"))
    best = all_rounds.groupBy("task_id").agg(F.max_by(F.struct(*[c for c in all_rounds.columns if c != "round"]), k)
                                             .alias("r"))
    return best.select("r.*")


def attach_responses(tasks: DataFrame, responses: DataFrame, id_col: str = "task_id") -> DataFrame:
    """Requests joined to results by id; missing or failed -> NULL body."""
    r = responses.select(id_col, F.when(F.col("ok"), F.col("body")).alias("body"), "ok")
    return tasks.join(r, id_col, "left").orderBy(id_col)


def usage_totals(responses: DataFrame, model_col: str = "model") -> DataFrame:
    """Calls that returned and tokens per model."""
    return responses.groupBy(model_col).agg(
        F.count_if("ok").alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        (F.sum("input_tokens") + F.sum("output_tokens")).alias("total_tokens"))


def generation_summary(tasks: DataFrame, parsed: DataFrame) -> DataFrame:
    """Target, generated, failed and completion rate."""
    t = tasks.agg(F.count(F.lit(1)).alias("target"))
    g = parsed.agg(F.count(F.lit(1)).alias("generated"))
    return t.crossJoin(g).select(
        "target", "generated", (F.col("target") - F.col("generated")).alias("failed"),
        F.round(F.coalesce(F.try_divide(F.col("generated").cast("double"), F.col("target")), F.lit(0.0)), 6)
        .alias("completion_rate"))
