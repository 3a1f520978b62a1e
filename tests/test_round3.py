"""Cost and exactness of what round 3 changed: sampling passes, overlaps,
reply arrays, line ids, running scores, cover, metrics, reports."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from spanweave.functions import models
from spanweave.functions import replies as R
from spanweave.operators import fewshot, runs, sampling, scoring, tagging
from spanweave.operators import parsing as P
from spanweave.plans.report import _entry
from spanweave.sources import corpus


def jobs_of(spark, action):
    """Spark jobs that an action starts."""
    import uuid
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "count")
    try:
        out = action()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def order(ids, seed):
    return sorted(((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i) for i in ids))


@pytest.mark.parametrize("n,rows", [(5000, None), (200_000, None), (1, None), (40, None), (0, [7] * 3000 + list(range(100))), (0, [3] * 9000)])
def test_cut_keys_in_two_passes(spark, monkeypatch, n, rows):
    ids = list(range(n)) if rows is None else rows
    df = spark.createDataFrame([(i,) for i in ids], "i long") if rows is not None else spark.range(n).withColumnRenamed("id", "i")
    df = df.coalesce(2)
    want = order(ids, 42)
    ranks = sorted({1, max(len(ids) // 2, 1), max(int(len(ids) * 0.8), 1), len(ids)})
    for leaf in (4096, 50):
        monkeypatch.setattr(sampling, "_LEAF", leaf)
        got = sampling.kth_keys(df, "i", 42, ranks, len(ids))
        assert got == {r: want[r - 1] for r in ranks}
    with pytest.raises(ValueError):
        sampling.kth_keys(df, "i", 42, [len(ids) + 1], len(ids))


def test_split_starts_few_jobs(spark):
    df = spark.range(20_000).withColumnRenamed("id", "sample_id").withColumn("sample_id", F.col("sample_id") * 3)
    out, jobs = jobs_of(spark, lambda: sampling.exact_split(df))
    assert jobs <= 4  # the count and one aggregate (each may run its shuffle as a job of its own)
    sizes = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert sizes == {"train": 16_000, "validation": 2000, "test": 2000}


def overlapping(n):
    return F.expr(f"transform(sequence(0, {n} - 1), i -> named_struct('type', 'a', 'start', i * 10, 'end', i * 10 + 25))")


def test_overlapping_spans_cost_in_proportion(spark):
    took = {}
    for n in (1000, 8000):
        df = spark.range(1).select(overlapping(n).alias("ents"), F.lit(n * 10 + 25).alias("n"))
        for _ in range(2):
            t = time.perf_counter()
            df.select(tagging.bio_tags_expr("ents", "n")).write.format("noop").mode("overwrite").save()
            took[n] = time.perf_counter() - t
    assert took[8000] < 10 * max(took[1000], 0.15)


def test_overlapping_spans_equal_painting(spark):
    r = random.Random(1)
    rows = [([(r.choice("abc"), r.randint(-5, 42), r.randint(-5, 45)) for _ in range(r.randint(0, 9))], r.randint(0, 40)) for _ in range(300)]
    df = spark.createDataFrame(rows, "ents array<struct<type:string,start:int,end:int>>, n int")
    for (ents, n), (got,) in zip(rows, df.select(tagging.bio_tags_expr("ents", "n")).collect()):
        want = ["O"] * n
        for t, s, e in ents:
            for i in range(max(s, 0), min(e, n)):
                want[i] = ("B-" if i == s else "I-") + t
        assert got == want


def test_arrays_of_replies(spark):
    deep = "[" * 20 + "1" + "]" * 20
    named = '[{"type":"person","text":"a ] b [","span":[0,7]}]'
    replies = [deep, named, f"see [1] and {named}", f'unbalanced [ then {named}', f'回答: {deep} {named}', '["no end]', 'x "quoted [" text [2]',
               '["a\\"]"] [3]', "[" * 64 + "]" * 64, "[" * 65 + "]" * 65, "", "[\n[1],\n\"]\"\n]"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(replies)], "i int, r string")
    first = [x for (x,) in df.orderBy("i").select(R.first_array(F.col("r"))).collect()]
    assert first[:9] == [deep, named, "[1]", named, deep, None, '[2]', '["a\\"]"]', replies[8]]
    assert first[10] is None and first[11] == replies[11]
    last = [x for (x,) in df.orderBy("i").select(R.answer_array(F.col("r"))).collect()]
    assert last[2] == named and last[4] == deep and last[7] == "[3]"
    got = P.parse_entities(df.where("i in (1, 2, 3)").withColumn("t", F.lit("a ] b [ c")), "r", "t", ["person"]).collect()
    assert [[(e.text, e.start, e.end) for e in x.entities] for x in got] == [[("a ] b [", 0, 7)]] * 3


def typed(spark, n, types):
    """Samples with sparse ids; every one has the type 'all'."""
    few = F.transform(F.array(*[F.lit(t) for t in types]), lambda t: F.when(F.pmod(F.xxhash64("id", t), F.lit(3)) == 0, t))
    ents = F.transform(F.concat(F.array(F.lit("all")), F.filter(few, lambda t: t.isNotNull())), lambda t: F.struct(t.alias("type")))
    return spark.range(n).select((F.col("id") * F.col("id")).alias("sample_id"), ents.alias("entities"))


def test_running_score_windows_are_bounded(spark):
    df = typed(spark, 20_000, "ab")
    per = fewshot.type_occurrences(df, rows_per_task=1000)
    sizes = [r["count"] for r in per.groupBy("b", "type").count().collect()]
    assert max(sizes) <= 1500 and len({r.b for r in per.select("b").distinct().collect()}) >= 20
    got = {r.sample_id: r.score for r in fewshot.running_type_score(df, rows_per_task=1000).collect()}
    seen, want = {}, {}
    for r in sorted(df.collect()):
        for e in r.entities:
            seen[e.type] = seen.get(e.type, 0) + 1
        want[r.sample_id] = sum(seen[e.type] for e in r.entities)
    assert got == want


def test_cover_over_many_type_sets(spark):
    df = typed(spark, 3000, "abcdefghij").cache()
    assert df.select(F.array_sort(F.transform("entities", lambda e: e["type"])).alias("t")).distinct().count() > 500
    rows = sorted(df.collect())
    score = {r.sample_id: r.score for r in fewshot.running_type_score(df).collect()}
    freq = {}
    for r in rows:
        for e in r.entities:
            freq[e.type] = freq.get(e.type, 0) + 1
    covered, want = set(), []
    for t in sorted(freq, key=lambda t: (-freq[t], t)):
        if t not in covered and len(want) < 6:
            pick = min((r for r in rows if t in {e.type for e in r.entities}), key=lambda r: (-score[r.sample_id], r.sample_id))
            want.append(pick.sample_id)
            covered |= {e.type for e in pick.entities}
    got = fewshot.few_shot_stratified(df, 6).collect()
    assert sorted(r.sample_id for r in got if r.phase == "cover") == sorted(want) and len(got) == 6


def test_a_very_common_line_is_dealt_over_tasks(spark, tmp_path):
    (tmp_path / "c.txt").write_text("same line\n" * 1_000_000 + "other\n")
    lines = corpus.read_corpus_lines(spark, str(tmp_path / "c.txt"))
    assert lines.select("line_id").distinct().count() == 1_000_001
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = [r["count"] for r in lines.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 4 and max(tasks) < 500_000


def test_line_ids_of_long_documents_differ(spark):
    assert corpus.LINE_ID_STRIDE > 2**29


SPANS = "doc_id long, type string, s int, e int"


def test_metrics_equal_the_two_reports(spark):
    gold = [(1, "a", 0, 2), (1, "b", 3, 4), (1, "b", 3, 4), (2, "a", 0, 1), (None, "c", 0, 1)]
    pred = [(1, "a", 0, 2), (1, "b", 3, 5), (2, "a", 0, 1), (2, "d", 7, 9)]
    for g, p in ((gold, pred), (gold, []), ([], []), ([], pred)):
        g, p = spark.createDataFrame(g, SPANS), spark.createDataFrame(p, SPANS)
        rows = scoring.metrics(g, p).collect()
        m = scoring.span_match(g.where("doc_id is not null"), p) if g.where("doc_id is null").isEmpty() else None
        if m is not None:
            per = {(r.type, r.precision, r.recall, r.f1, r.support) for r in scoring.prf_by_type(m).collect()}
            assert {tuple(r)[1:] for r in rows if r.level == "type"} == per
            assert [tuple(r)[1:] for r in rows if r.level == "average"] == [tuple(r) for r in scoring.prf_overall(m).collect()]
    plan = scoring.metrics(g, p)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(doc_id") == 1  # the spans move once


def test_a_swapped_rank_changes_the_digest(spark):
    rows = [(1, "x", 0.9), (2, "y", 0.8), (3, "z", 0.7)]
    digest = lambda rows: _entry("t", spark.createDataFrame(rows, "rank int, model_key string, f1 double"), ["rank"]).first().content
    assert digest(rows) == digest(rows[::-1])
    assert digest(rows) != digest([(1, "y", 0.8), (2, "x", 0.9), (3, "z", 0.7)])
    assert digest(rows) != digest([(1, "x", 0.9), (2, "y", 0.81), (3, "z", 0.7)])


RESULTS = "model_key string, run_order int, training_time double, metrics struct<precision:double,recall:double,f1:double>"


def test_repeated_run_keys_fail(spark):
    rows = [("a", 0, 1.0, (0.5, 0.5, 0.5)), ("b", 1, 2.0, (0.4, 0.4, 0.4)), ("b", 2, 2.0, (0.4, 0.4, 0.4))]
    df = spark.createDataFrame(rows, RESULTS)
    with pytest.raises(Exception, match="several runs have the key b"):
        runs.compare_runs(df, "a", "b").collect()
    assert len(runs.compare_runs(df.where("run_order < 2"), "a", "b").collect()) == 4
    assert runs.compare_runs(df, "a", "none").collect() == []


@pytest.mark.parametrize("key,name,crf,shown", [
    ("m", "org/bert-large", False, "m-large"), ("m", "org/bert", True, "m-crf"), ("m-crf", "org/bert", True, "m-crf"), ("m_CRF", "x", False, "m_CRF"),
    ("m", "char-BiLSTM", False, "m [BiLSTM]"), ("neo", "org/gpt-neox", False, "neo [LLM]"), ("rinna", "x", False, "rinna"),
    ("claude", "c", False, "claude [API]"), ("remote-1", "c", False, "remote-1"), ("m", "large-llama", True, "m-large-crf [LLM]"), (None, None, None, "")])
def test_display_names(spark, key, name, crf, shown):
    df = spark.createDataFrame([(key, name, crf)], "k string, n string, c boolean")
    assert df.select(models.run_flags(F.col("k"), F.col("n"), F.col("c")).alias("f")).first().f.display_name == shown
