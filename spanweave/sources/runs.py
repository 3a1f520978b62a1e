"""Run results derived from the annotated documents.

Simulated model runs, named so that every name rule applies, are scored against the gold annotations of every
document.  Run k drops a gold span when ``md5('<key>:<doc>:<s>')`` starts
below its threshold and relabels it to ``person`` when the third hex digit is
``0``.  Each run yields one RESULT row with micro metrics and per-type metrics;
``bilstm_crf`` is recorded as a failed run.  Times, stamps, versions in the names
and sample counts follow the counted spans and documents.  The run fan-out
happens inside each document row (an array of the runs), then counts are aggregated per
(run, type) with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.operators.scoring import match_arrays, span_key
from spanweave.sources import fixtures as fx
from spanweave.sources.tables import table

# Fixed run table: key, model name, drop threshold (2 hex digits), run id, the CRF hyperparameter.
RUNS = (
    ("bert", "org/bert-base-model", "08", 0, False),
    ("bert_crf", "org/bert-base-model", "10", 1, True),
    ("bert_large", "org/bert-large-model", "18", 2, False),
    ("roberta", "org/roberta-base-model", "20", 3, False),
    ("luke", "org/luke-base-model", "28", 4, True),
    ("albert", "org/Albert-Large-model", "30", 5, True),
    ("deberta", "org/deberta-v2-base-model", "38", 6, False),
    ("bilstm", "bilstm", "40", 7, False),
    ("bilstm_crf", "bilstm", "48", 8, True),
    ("remote-llm-a", "remote-llm-a", "50", 9, False),
    ("seq", "org/char-BiLSTM", "0c", 10, False),
    ("xl-crf", "org/xlnet-base", "14", 11, True),
    ("big", "org/gpt-neox-large", "1c", 12, False),
    ("rinna", "org/rinna-3b", "24", 13, False),
    ("local", "org/ELYZA-7b-Llama", "2c", 14, False),
    ("chatgpt-5shot", "gpt-4-turbo", "34", 15, False),
    ("claude", "claude-sonnet", "3c", 16, False),
    ("small", "org/gpt2-medium", "44", 17, False),
    ("own", "org/sub/Some-Other-Encoder-With-A-Long-Name", "4c", 18, False),
)
FAILED = ("bilstm_crf",)


def runs_sql_values() -> str:
    return ", ".join(f"('{k}', '{n}', '{d}', {i}, {str(c).lower()})" for k, n, d, i, c in RUNS)


def run_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model_key, type, tp, n_pred, support`` for every run."""
    # a span's keys (own type, relabelled) are made once a document, before the runs fan out
    of_gold = lambda x, name: F.expr(f"transform(gold, x -> {x})").alias(name)
    a = fx.annotated(spark, sf_dir).select(F.expr("concat(':', CAST(doc_id AS STRING), ':')").alias("doc"), of_gold(span_key("x"), "gold"),
                                           of_gold(span_key("x", "'person'"), "person"), of_gold("CAST(x.s AS STRING)", "start"))
    runs = F.array(*[F.struct(F.lit(k).alias("model_key"), F.lit(d).alias("drop_below")) for k, _, d, *_ in RUNS])
    per = a.select("*", F.explode(runs).alias("r"))
    pred = F.expr("array_compact(transform(transform(start, s -> substr(md5(concat(r.model_key, doc, s)), 1, 3)), (h, i) -> "
                  "CASE WHEN substr(h, 1, 2) >= r.drop_below THEN if(substr(h, 3, 1) = '0', person[i], gold[i]) END))")
    per = per.select(F.col("r.model_key").alias("model_key"), "gold", pred.alias("pred"))
    m = match_arrays(per, sample_col="model_key", keyed=True)
    o = F.col("outcome")
    return m.groupBy("model_key", "type").agg(
        F.count_if(o == "tp").cast("bigint").alias("tp"),
        F.count_if(o.isin("tp", "fp")).cast("bigint").alias("n_pred"),
        F.count_if(o.isin("tp", "fn")).cast("bigint").alias("support"))


LOG_DAYS, LOG_WAVE = 8, 2   # the log spans eight days and arrives two days at a time


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of finished runs, one per document: ``model_key, status, timestamp,
    wave`` (when its file arrives).  Day and status come from the hash of the
    id, the time of day from the text's length; runs whose hash says so arrive
    two waves late."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    h = F.md5(F.concat(F.lit("run:"), F.col("doc_id").cast("string")))
    d = d.select("n", h.alias("h")).withColumn("day", F.conv(F.substring("h", 2, 2), 16, 10).cast("int") % LOG_DAYS)
    stamp = F.timestamp_seconds(F.unix_seconds(F.lit("2025-01-01 00:00:00").cast("timestamp")) + F.col("day") * 86400 + (F.col("n") * 37) % 86400)
    keys = F.array(*[F.lit(k) for k, *_ in RUNS])
    late = F.substring("h", 4, 1).isin("e", "f")
    return d.select(F.element_at(keys, F.conv(F.substring("h", 5, 2), 16, 10).cast("int") % len(RUNS) + 1).alias("model_key"),
                    F.when(F.substring("h", 1, 1) == "0", "failed").otherwise("success").alias("status"),
                    F.date_format(stamp, "yyyyMMdd_HHmmss").alias("timestamp"),
                    (F.floor(F.col("day") / LOG_WAVE) + F.when(late, 2).otherwise(0)).cast("int").alias("wave"))


NAME_MARKS = ("bert", "Roberta", "xlnet", "luke", "bilstm", "rinna", "gpt-neox", "elyza", "LLAMA", "gpt-4", "chatgpt", "claude", "gpt", "large",
              "deberta", "albert", "remote", "_crf", "-crf", "")


def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model key and name per document, made of its first word and of marks that
    the id's hash picks: ``doc_id, model_key, model_name, use_crf``."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "[^A-Za-z]", 2)[0].alias("word"))
    h = F.md5(F.concat(F.lit("name:"), F.col("doc_id").cast("string")))
    marks = F.array(*[F.lit(m) for m in NAME_MARKS])
    mark = lambda at: F.element_at(marks, F.conv(F.substring("h", at, 2), 16, 10).cast("int") % len(NAME_MARKS) + 1)
    d = d.select("doc_id", "word", h.alias("h"))
    return d.select("doc_id", F.concat("word", mark(1)).alias("model_key"), F.concat(F.lit("org/"), mark(3), F.lit("-"), "word", mark(5)).alias("model_name"),
                    (F.substring("h", 7, 1) < "8").alias("use_crf"))


def _ratio(n, d):
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RESULT-like rows, one per run (materialised once per application)."""
    return fx.materialized(spark, ("results", sf_dir), lambda: _build(spark, sf_dir))


def _build(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = run_type_counts(spark, sf_dir)
    tp, npred, sup = F.col("tp"), F.col("n_pred"), F.col("support")
    per_type = c.select("model_key", "type", F.struct(
        _ratio(tp, npred).alias("precision"), _ratio(tp, sup).alias("recall"),
        _ratio(2 * tp, npred + sup).alias("f1-score"), sup.alias("support")).alias("m"))
    agg = per_type.groupBy("model_key").agg(F.map_from_entries(F.collect_list(F.struct("type", "m"))).alias("metrics_per_type"))
    micro = c.groupBy("model_key").agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"),
                                       F.sum("support").alias("support"))
    meta = spark.createDataFrame([(k, n, i, c) for k, n, _, i, c in RUNS], "model_key string, model_name string, run_order int, crf boolean")
    docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("docs"))   # one row
    j = F.broadcast(meta).join(micro, "model_key").join(agg, "model_key").crossJoin(F.broadcast(docs))
    failed = F.col("model_key").isin(*FAILED)
    train, val = (F.floor(F.col("docs") * share).cast("long") for share in (0.8, 0.1))
    return j.select(
        F.concat("model_name", F.format_string("-v%d", F.col("tp") % 7)).alias("model_name"), "model_key",
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.format_string("2025010%d_120000", F.col("n_pred") % 9 + 1).alias("timestamp"),
        F.concat(F.lit("runs/"), F.col("model_key")).alias("output_dir"),
        F.to_json(F.struct(F.col("crf").alias("use_crf"), F.lit(16).alias("batch_size"))).alias("hyperparameters"),
        (F.col("n_pred") / F.lit(8.0) + (F.col("support") - F.col("tp")) % 1024).alias("training_time"),
        F.struct(train.alias("train"), val.alias("val"), (F.col("docs") - train - val).alias("test")).alias("num_samples"),
        F.struct(_ratio(F.col("tp"), F.col("n_pred")).alias("precision"),
                 _ratio(F.col("tp"), F.col("support")).alias("recall"),
                 _ratio(2 * F.col("tp"), F.col("n_pred") + F.col("support")).alias("f1"),
                 _ratio(F.col("tp"), F.col("n_pred") + F.col("support") - F.col("tp")).alias("accuracy")).alias("metrics"),
        F.when(~failed, F.col("metrics_per_type")).alias("metrics_per_type"),
        F.when(failed, F.lit("simulated failure")).alias("error"),
        "run_order")
