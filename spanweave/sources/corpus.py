"""Raw text corpora: S4 read_corpus_lines and the line table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.functions.replies import py_strip
from spanweave.sources.tables import spread, table

LINE_ID_STRIDE = 1_000_000_000  # more lines than a text can have
SPREAD = 10_000  # equal lines that one row stands for on its way to another task


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document: ``line_id = doc_id * LINE_ID_STRIDE + line_no``."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    e = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    return e.select((F.col("doc_id") * LINE_ID_STRIDE + F.col("pos")).alias("line_id"), "text")


def read_corpus_lines(spark: SparkSession, path: str, key: str = "aug") -> DataFrame:
    """A text corpus given as JSON Lines with key ``key`` or as plain lines:
    ``line_id, text``.

    The corpus is JSON Lines if its first non-blank line is an object that holds
    the key (a one-row probe); a plain corpus may begin with a brace.  Blank
    lines (Python white space), and JSON lines that do not parse or lack the
    key, are skipped; values are stripped.  A line's id is the hash of its
    file's name, its text and how many equal lines of the file stand before it:
    it doesn't depend on how files are split into partitions.
    """
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    lines = raw.where(py_strip(F.col("value")) != "")
    val = F.expr(f"try_variant_get(try_parse_json(value), '$.{key}', 'string')")
    first = lines.select("value").limit(1).select(val.isNotNull().alias("json")).first()
    if first is not None and first["json"]:
        lines = lines.select("file", val.alias("value")).where(py_strip(F.col("value")) != "")
    lines = lines.select("file", py_strip(F.col("value")).alias("text"))
    # equal lines of a file are interchangeable: fold them and number them; a line
    # that is very common goes on as many rows, dealt over the tasks
    folded = lines.groupBy("file", "text").agg(F.count(F.lit(1)).alias("n"))
    parts = folded.select("file", "text", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SPREAD))).alias("part"))
    dealt = parts.repartition(F.xxhash64("file", "text", "part"))
    numbered = dealt.select("file", "text", F.explode(F.sequence(F.col("part") * SPREAD, F.least(F.col("n"), (F.col("part") + 1) * SPREAD) - 1)).alias("i"))
    return numbered.select(F.xxhash64("file", "text", "i").alias("line_id"), "text")
