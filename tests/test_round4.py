"""Tables of one row group: the work per document goes to all cores."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from spanweave.sources import fixtures as fx
from spanweave.sources import runs as RS


def _one_row_group(spark, folder, rows=400):
    """A documents file that has at least a split per core, but one row group."""
    word = "".join(chr(97 + i % 26) for i in range(40))
    text = [" ".join(f"{word[(i + j) % 26:]}{i * 31 + j}" if j % 3 else f"Name{i}x{j}," for j in range(40)) for i in range(rows)]
    t = pa.table({"doc_id": pa.array(range(rows), pa.int64()), "text": text, "lang": ["en"] * rows, "source": ["web"] * rows,
                  "n_chars": pa.array([len(x) for x in text], pa.int32())})
    pq.write_table(t, f"{folder}/documents.parquet", compression="none", use_dictionary=False)
    assert pq.ParquetFile(f"{folder}/documents.parquet").num_row_groups == 1
    return str(folder)


def test_documents_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    sf = _one_row_group(spark, tmp_path)
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        raw = fx.table(spark, sf, "documents")
        assert raw.rdd.getNumPartitions() >= cores
        assert raw.select(F.spark_partition_id()).distinct().count() == 1
        d = fx.docs(spark, sf)
        counts = [r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(counts) >= cores and sum(counts) == 400 and max(counts) * cores <= 2 * 400


def test_dealt_out_inputs_are_not_dealt_again(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(4000).repartition(2 * cores).write.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    try:
        df = spark.read.parquet(f"{tmp_path}/t")
        assert fx.spread(df) is df
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_annotation_and_runs_hash_a_span_once(spark, tmp_path):
    sf = _one_row_group(spark, tmp_path, rows=8)
    d = fx.with_annotations(spark.createDataFrame([(1, "en", "Alpha, betas Gamma gam")], "doc_id long, lang string, text string"))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
    row = d.first()
    assert [(c.s, c.e, c.name) for c in row["gold"]] == [(0, 5, "Alpha"), (13, 18, "Gamma")]
    runs = RS.run_type_counts(spark, sf)
    assert runs._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    assert runs.agg(F.count_distinct("model_key")).first()[0] == len(RS.RUNS)
