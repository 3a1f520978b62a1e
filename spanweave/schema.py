"""Declared schemas and fixed values.

Every reader passes one of these schemas explicitly; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the annotation project's conventions.
# ---------------------------------------------------------------------------
# Split names, and the alias accepted for the validation split.
SPLITS = ("train", "validation", "test")
SPLIT_ALIASES = {"val": "validation"}
# Characters that mark a garbled entity name or text.
BAD_CHARS = ("?", "☆", "〈", "〉")
BAD_CHAR_CLASS = "[?☆〈〉]"
# Characters that end a sentence for corpus chunking.
SENTENCE_ENDS = "。．.！!？?」』\n"
# Minimum entity count of a sample used as a few-shot example.
MIN_EXAMPLE_ENTITIES = 10
# Label used on positions that the loss ignores.
IGNORE_INDEX = -100
# Tags.
OUTSIDE = "O"
# Opening / closing marker of an annotation in a synthesis reply.
ANNOTATION_OPEN = "<start_annotation>"
ANNOTATION_CLOSE = "</end_annotation>"
# Marker in front of the answer array in an extraction reply.
ANSWER_MARKER = "回答:"
# Distribution check thresholds (mean absolute share difference).
MAD_GOOD = 0.02
MAD_FAIR = 0.05

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
ENTITY_STRUCT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("span", T.ArrayType(T.IntegerType())),
])

SAMPLE = T.StructType([
    T.StructField("sample_id", T.LongType()),
    T.StructField("split", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("entities", T.ArrayType(ENTITY_STRUCT)),
])

# Generated samples as written to JSON (no id, no split).
GENERATED = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("entities", T.ArrayType(ENTITY_STRUCT)),
])

ENTITY = T.StructType([
    T.StructField("sample_id", T.LongType()),
    T.StructField("ent_idx", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
])

TAG = T.StructType([
    T.StructField("sample_id", T.LongType()),
    T.StructField("i", T.IntegerType()),
    T.StructField("tag", T.StringType()),
])

SEGMENT = T.StructType([
    T.StructField("line_id", T.LongType()),
    T.StructField("seg_idx", T.IntegerType()),
    T.StructField("segment", T.StringType()),
])

PLAN = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("ratio", T.DoubleType()),
    T.StructField("unique_entities", T.LongType()),
    T.StructField("target_samples", T.LongType()),
    T.StructField("top_n", T.LongType()),
    T.StructField("samples_per_entity", T.LongType()),
    T.StructField("estimated_samples", T.LongType()),
])

TARGET_STRUCT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
])

TASK = T.StructType([
    T.StructField("task_id", T.LongType()),
    T.StructField("primary_type", T.StringType()),
    T.StructField("targets", T.ArrayType(TARGET_STRUCT)),
])

RESPONSE = T.StructType([
    T.StructField("task_id", T.LongType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("ok", T.BooleanType()),
    T.StructField("body", T.StringType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("error", T.StringType()),
])

TYPE_METRICS = T.StructType([
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1-score", T.DoubleType()),
    T.StructField("support", T.LongType()),
])

RESULT = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("model_key", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("output_dir", T.StringType()),
    T.StructField("hyperparameters", T.StringType()),
    T.StructField("training_time", T.DoubleType()),
    T.StructField("num_samples", T.StructType([
        T.StructField("train", T.LongType()),
        T.StructField("val", T.LongType()),
        T.StructField("test", T.LongType()),
    ])),
    T.StructField("metrics", T.StructType([
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("accuracy", T.DoubleType()),
    ])),
    T.StructField("metrics_per_type", T.MapType(T.StringType(), TYPE_METRICS)),
    T.StructField("classification_report", T.StringType()),
    T.StructField("best_model_path", T.StringType()),
    T.StructField("error", T.StringType()),
])
