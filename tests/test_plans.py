"""Physical-plan guards for the scale properties of the headline queries."""

import __spark_entry__ as E

from spanweave.operators import sampling as S

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prf_by_type_shuffles_only_type_counts(spark):
    plan = _plan(E.queries()["prf_by_type"](spark, SF))
    # one exchange, of per-type partial counts; the scan reads only the two arrays
    assert plan.count("Exchange hashpartitioning") == 1
    assert "hashpartitioning(type" in plan
    assert "text" not in plan.split("FileScan")[1].split("ReadSchema")[1].split("\n")[0]


def test_exact_split_is_a_projection(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "sample_id")
    out = S.exact_split(df, "sample_id", 42)
    assert "Exchange" not in _plan(out)
    assert "Window" not in _plan(out)


def test_parse_runs_once_per_reply(spark):
    plan = _plan(E.queries()["parse_entities"](spark, SF))
    # no inferred size filter that would re-run the parse below the generator
    filters = [ln for ln in plan.split("\n") if "Filter" in ln.split("[")[0]]
    assert not any("parseJson" in ln for ln in filters)


def test_stream_distribution_equals_batch(spark):
    stream = {r["type"]: r["n"] for r in E.queries()["stream_distribution"](spark, SF).collect()}
    from spanweave.sources import fixtures as fx
    batch = {r["type"]: r["count"] for r in fx.gold_rows(spark, SF).groupBy("type").count().collect()}
    assert stream == batch and sum(batch.values()) > 0
