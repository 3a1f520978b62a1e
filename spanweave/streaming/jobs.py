"""Structured Streaming jobs: T1 stream_distribution, T2 stream_responses,
T3 stream_runs.

Each reads a folder of files with an explicit schema; tests and the
registered queries drive them with ``trigger(availableNow=True)`` so the
final state can be compared with the batch result.  Checkpoints go under the
cluster's shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.schema import GENERATED
from spanweave.session import children, remove


KEPT_STATES = 2  # complete states that stay: the last one and the one before


def _epochs(spark: SparkSession, out_table: str) -> list[str]:
    """Folders of committed states, oldest first."""
    return [c for c in children(spark, out_table) if c.startswith("epoch=") and "_SUCCESS" in children(spark, f"{out_table}/{c}")]


def latest(spark: SparkSession, out_table: str) -> DataFrame:
    """The last complete state of a table kept by ``keep_state``."""
    return spark.read.parquet(f"{out_table}/{_epochs(spark, out_table)[-1]}")


def keep_state(out_table: str):
    """Sink for complete states: every micro-batch commits a folder of its own,
    so a reader sees the old state or the new one, never a half-written one; a
    repeated batch overwrites only its own folder.  Older states are removed."""
    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_table}/epoch={epoch:09d}")
        for old in _epochs(batch.sparkSession, out_table)[:-KEPT_STATES]:
            remove(batch.sparkSession, f"{out_table}/{old}")
    return sink


def stream_distribution(spark: SparkSession, in_path: str, out_table: str, checkpoint: str,
                        schema=GENERATED, real: DataFrame | None = None) -> None:
    """Per-type entity counts of a folder of generated samples, their share,
    and the gap to the real distribution (``type, percentage``) when given,
    kept up to date in complete mode."""
    src = spark.readStream.schema(schema).json(in_path)
    counts = (src.select(F.explode("entities").alias("e"))
                 .groupBy(F.col("e.type").alias("type")).agg(F.count(F.lit(1)).alias("n")))
    write = keep_state(out_table)

    def sink(batch: DataFrame, epoch: int) -> None:
        total = batch.agg(F.sum("n").alias("total"))                       # one row
        out = batch.crossJoin(total).select("type", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percentage"))
        if real is not None:
            r = real.select("type", F.col("percentage").alias("real_percentage"))
            out = out.join(r, "type", "full_outer").select(
                "type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("percentage", F.lit(0.0)).alias("percentage"),
                F.round(F.coalesce("percentage", F.lit(0.0)) - F.coalesce("real_percentage", F.lit(0.0)), 4).alias("gap"))
        write(out, epoch)

    q = (counts.writeStream.outputMode("complete").foreachBatch(sink)
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def stream_responses(spark: SparkSession, in_path: str, out_path: str, checkpoint: str,
                     schema: str = "task_id long, body string, received timestamp") -> None:
    """Ingest replies, drop repeated task ids within the watermark, parse
    annotations (F2) and append the entities."""
    from spanweave.operators.parsing import extract_annotation, repaired_only
    src = spark.readStream.schema(schema).json(in_path)
    dedup = (src.withWatermark("received", "1 hour").dropDuplicatesWithinWatermark(["task_id"]))
    parsed = extract_annotation(dedup, "body")
    ents = parsed.where(F.col("entities").isNotNull()).select(
        "task_id", F.explode(repaired_only(F.col("entities"))).alias("e")).select("task_id", "e.*")
    q = (ents.writeStream.outputMode("append").format("parquet").option("path", out_path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


RUN_LOG = "model_key string, status string, timestamp string"


def _stamped(runs: DataFrame) -> DataFrame:
    return runs.select("status", F.try_to_timestamp("timestamp", F.lit("yyyyMMdd_HHmmss")).alias("ts"))


def stream_runs(spark: SparkSession, in_path: str, out_path: str, checkpoint: str, schema: str = RUN_LOG,
                window: str = "1 day", lateness: str = "1 day") -> None:
    """Finished runs per tumbling window of the run stamp and status.

    The watermark follows the latest stamp by ``lateness``.  A window behind it
    is appended to ``out_path`` once and leaves the state, so the state holds
    the windows of the last ``lateness`` only; a run that comes after its window
    was closed is dropped (``late_runs`` counts them).  What is still open when
    the input ends is read by ``open_windows``."""
    counts = (_stamped(spark.readStream.schema(schema).json(in_path)).withWatermark("ts", lateness)
              .groupBy(F.window("ts", window).alias("w"), "status").agg(F.count(F.lit(1)).alias("runs"))
              .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "status", "runs"))
    q = (counts.writeStream.outputMode("append").format("parquet").option("path", out_path)
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


WINDOWS = "start timestamp, end timestamp, status string, runs long"


def closed_windows(spark: SparkSession, out_path: str) -> DataFrame:
    """Windows that ``stream_runs`` has closed."""
    if not children(spark, out_path):
        return spark.createDataFrame([], WINDOWS)
    return spark.read.schema(WINDOWS).parquet(out_path)


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The final flush: windows still in the state of ``stream_runs``, from the
    last committed batch of its checkpoint."""
    if not children(spark, f"{checkpoint}/commits"):
        return spark.createDataFrame([], WINDOWS)
    state = spark.read.format("statestore").load(checkpoint)
    # the grouping keys by position: window, status
    start, end, status = "key.w.start", "key.w.end", "key.status"
    if "w" not in state.schema["key"].dataType.names:
        first, second = state.schema["key"].dataType.names
        start, end, status = f"key.`{first}`.start", f"key.`{first}`.end", f"key.`{second}`"
    count = state.schema["value"].dataType.names[0]
    return state.select(F.col(start).alias("start"), F.col(end).alias("end"), F.col(status).alias("status"), F.col(f"value.`{count}`").alias("runs"))


def runs_per_window(spark: SparkSession, out_path: str, checkpoint: str) -> DataFrame:
    """Every window of ``stream_runs``: ``start, end, status, runs, closed``."""
    done = closed_windows(spark, out_path).withColumn("closed", F.lit(True))
    return done.unionByName(open_windows(spark, checkpoint).withColumn("closed", F.lit(False)))


def late_runs(spark: SparkSession, in_path: str, counted: DataFrame, schema: str = RUN_LOG, window: str = "1 day") -> DataFrame:
    """The audit of ``stream_runs``: windows as in ``counted`` with ``late``, the
    runs of the input (all ingested) that aren't in its count; windows of late
    runs only are there with 0 runs."""
    seen = (_stamped(spark.read.schema(schema).json(in_path)).where(F.col("ts").isNotNull())
            .groupBy(F.window("ts", window).alias("w"), "status").agg(F.count(F.lit(1)).alias("seen"))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "status", "seen"))
    j = seen.join(counted, ["start", "end", "status"], "left")
    runs = F.coalesce("runs", F.lit(0))
    return j.select("start", "end", "status", runs.alias("runs"), (F.col("seen") - runs).alias("late"), F.coalesce("closed", F.lit(True)).alias("closed"))
