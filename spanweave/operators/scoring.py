"""Span-level scoring: J1, J2, A6, A7, A8, A21, U2.

Two physical shapes are offered for span matching:

* ``span_match`` joins two entity *tables* (gold and predicted rows from
  different sources).  Both sides are de-duplicated on the join key first, so
  the aggregate's hash partitioning is reused by the full outer join (one
  exchange per side).
* ``match_arrays`` scores gold and predicted *arrays held in the same row*
  (the usual layout of a prediction table).  Set intersection and difference
  run inside each row, so there is no shuffle of entities at all; only the
  tiny per-type counts are exchanged by the aggregate that follows.

Scores use sets of ``(type, start, end)`` chunks, divisions that are 0 on an
empty denominator, and f1 = 2 tp / (predicted + support).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("type", "s", "e")


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def span_match(gold: DataFrame, pred: DataFrame, sample_col: str = "doc_id") -> DataFrame:
    """Full outer equi-join of gold and predicted spans.

    Returns ``sample_col, type, s, e, outcome`` with outcome tp / fn / fp.
    """
    keys = [sample_col, *KEY]
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(True))
    p = pred.select(*keys).distinct().withColumn("_p", F.lit(True))
    j = g.join(p, keys, "full_outer")
    outcome = (F.when(F.col("_g") & F.col("_p"), "tp")
                .when(F.col("_g"), "fn").otherwise("fp"))
    return j.select(*keys, outcome.alias("outcome"))


def span_key(x: str, of_type: str | None = None) -> str:
    """SQL for a span as a string: array set functions hash those, structs they
    would compare pair by pair.  ``of_type``: a type (SQL) instead of the span's own."""
    kind = of_type or f"coalesce({x}.type, '\\0')"
    return f"concat(CAST({x}.s AS STRING), ':', CAST({x}.e AS STRING), ':', {kind})"


def match_arrays(df: DataFrame, gold_col: str = "gold", pred_col: str = "pred",
                 sample_col: str = "doc_id", keyed: bool = False) -> DataFrame:
    """J1 without a join: per row, tp = gold ∩ pred, fn = gold − pred, fp = pred − gold.

    ``keyed``: both columns hold keys made by ``span_key``, for callers that score
    the same gold many times (offsets come out as BIGINT)."""
    from spanweave.sources.tables import explode_rows
    s_type = e_type = "bigint"
    if not keyed:
        s_type, e_type = (dict(df.select(F.inline(gold_col)).dtypes)[c] for c in ("s", "e"))
    gold, pred = (F.col(c) if keyed else F.expr(f"transform({c}, x -> {span_key('x')})") for c in (gold_col, pred_col))
    sets = df.select(sample_col, gold.alias("_g"), pred.alias("_p"))
    sets = explode_rows(sets, F.expr("array(struct(array_intersect(_g, _p) AS k, 'tp' AS outcome), struct(array_except(_g, _p) AS k, 'fn' AS outcome), "
                                     "struct(array_except(_p, _g) AS k, 'fp' AS outcome))"), [sample_col])
    rows = explode_rows(sets, F.col("k"), [sample_col, "outcome"], name="k")
    # cut by plain string functions: a split makes three strings where often only the type is asked for
    s, after = F.substring_index("k", ":", 1), F.expr("substr(k, locate(':', k) + 1)")
    kind = F.expr("substr(k, locate(':', k, locate(':', k) + 1) + 1)")
    return rows.select(sample_col, F.nullif(kind, F.lit("\0")).alias("type"), s.cast(s_type).alias("s"),
                       F.substring_index(after, ":", 1).cast(e_type).alias("e"), "outcome")


def type_counts(matches: DataFrame) -> DataFrame:
    """tp, predicted and support per type from match rows."""
    o = F.col("outcome")
    return matches.groupBy("type").agg(
        F.count_if(o == "tp").cast("bigint").alias("tp"),
        F.count_if(o.isin("tp", "fp")).cast("bigint").alias("n_pred"),
        F.count_if(o.isin("tp", "fn")).cast("bigint").alias("support"))


def _prf(tp: Column, n_pred: Column, support: Column) -> list[Column]:
    return [_ratio(tp, n_pred).alias("precision"),
            _ratio(tp, support).alias("recall"),
            _ratio(2 * tp, n_pred + support).alias("f1")]


def prf_by_type(matches: DataFrame, digits: int | None = 6) -> DataFrame:
    """Precision, recall, F1, support per type (types of either side)."""
    c = type_counts(matches)
    out = c.select("type", "tp", "n_pred", "support",
                   *_prf(F.col("tp"), F.col("n_pred"), F.col("support")))
    return _round(out, digits)


def _round(df: DataFrame, digits: int | None, cols=("precision", "recall", "f1")) -> DataFrame:
    if digits is None:
        return df
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def prf_overall(matches: DataFrame, digits: int | None = 6) -> DataFrame:
    """Micro, macro and weighted averages (report rows).

    The per-type rows are tiny (one per type), so the averages are one more
    aggregate over them.  With no entity on either side the result is three
    rows of zeros.
    """
    per = prf_by_type(matches, digits=None)
    tot = per.agg(
        F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("support").alias("support"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    sup = F.coalesce(F.col("support"), F.lit(0)).cast("bigint")
    micro = tot.select(F.lit("micro avg").alias("avg_type"),
                       *_prf(F.coalesce(F.col("tp"), F.lit(0)), F.coalesce(F.col("n_pred"), F.lit(0)), sup),
                       sup.alias("support"))
    macro = tot.select(F.lit("macro avg").alias("avg_type"), z(F.col("mp")).alias("precision"),
                       z(F.col("mr")).alias("recall"), z(F.col("mf")).alias("f1"), sup.alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("avg_type"),
                          _ratio(F.col("wp"), sup).alias("precision"),
                          _ratio(F.col("wr"), sup).alias("recall"),
                          _ratio(F.col("wf"), sup).alias("f1"), sup.alias("support"))
    return _round(micro.unionByName(macro).unionByName(weighted), digits)


METRIC_ROWS = "level string, name string, precision double, recall double, f1 double, support bigint"


def metrics(gold: DataFrame, pred: DataFrame, sample_col: str = "doc_id", digits: int | None = 6) -> DataFrame:
    """The whole report of predicted spans in one call: a row per type (level
    ``type``) and the micro, macro and weighted averages (level ``average``).

    Spans are matched by one grouping of both tables, and the types' and the
    overall counts come from it together (grouping sets); the averages are made
    of those few rows.  Spans are a set per sample; without any the averages
    are 0."""
    keys = [sample_col, *KEY]
    sides = gold.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("p")).union(pred.select(*keys, F.lit(0), F.lit(1)))
    spans = sides.groupBy(*keys).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    counts = spans.groupingSets([[F.col("type")], []], "type").agg(
        F.grouping("type").alias("all"), F.coalesce(F.sum(F.col("g") * F.col("p")), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("n_pred"), F.coalesce(F.sum("g"), F.lit(0)).alias("support"))
    scored = counts.select("all", "type", *_prf(F.col("tp"), F.col("n_pred"), F.col("support")), "support")
    row = F.struct("type", "precision", "recall", "f1", F.col("support").cast("double").alias("support"))
    few = scored.agg(F.collect_list(F.when(F.col("all") == 0, row)).alias("types"), F.max(F.when(F.col("all") == 1, row)).alias("micro"))
    total = lambda f: F.aggregate("types", F.lit(0.0), lambda acc, x: acc + f(x))
    over = lambda num, den: F.coalesce(F.try_divide(num, den), F.lit(0.0))
    support, n = total(lambda x: x["support"]), F.size("types").cast("double")

    def as_row(level: str, name, values: list, support) -> Column:
        named = [v.alias(m) for v, m in zip(values, ("precision", "recall", "f1"))]
        return F.struct(F.lit(level).alias("level"), name.alias("name"), *named, support.cast("bigint").alias("support"))

    three = ("precision", "recall", "f1")
    averages = F.array(
        as_row("average", F.lit("micro avg"), [F.coalesce(F.col("micro")[m], F.lit(0.0)) for m in three], support),
        as_row("average", F.lit("macro avg"), [over(total(lambda x, m=m: x[m]), n) for m in three], support),
        as_row("average", F.lit("weighted avg"), [over(total(lambda x, m=m: x[m] * x["support"]), support) for m in three], support))
    types = F.transform("types", lambda x: as_row("type", x["type"], [x[m] for m in three], x["support"]))
    return _round(few.select(F.inline(F.concat(types, averages))), digits)


def surface_sets(gold: DataFrame, pred: DataFrame, sample_col: str = "doc_id",
                 gold_surface: str = "name", pred_surface: str = "name") -> DataFrame:
    """``true & pred``, ``pred - true``, ``true - pred`` of distinct
    ``(type, surface)`` per sample, as rows labelled tp / fp / fn."""
    g = gold.select(sample_col, "type", F.col(gold_surface).alias("surface")).distinct()
    p = pred.select(sample_col, "type", F.col(pred_surface).alias("surface")).distinct()
    keys = [sample_col, "type", "surface"]
    j = (g.withColumn("_g", F.lit(True))
          .join(p.withColumn("_p", F.lit(True)), keys, "full_outer"))
    outcome = (F.when(F.col("_g") & F.col("_p"), "tp")
                .when(F.col("_g"), "fn").otherwise("fp"))
    return j.select(*keys, outcome.alias("outcome"))


def surface_prf(sets: DataFrame, digits: int | None = 6) -> DataFrame:
    """Global P/R/F1 with TP/FP/FN over the surface sets."""
    o = F.col("outcome")
    c = sets.agg(F.count_if(o == "tp").cast("bigint").alias("tp"),
                 F.count_if(o == "fp").cast("bigint").alias("fp"),
                 F.count_if(o == "fn").cast("bigint").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = c.select(*_prf(tp, tp + fp, tp + fn), "tp", "fp", "fn")
    return _round(out, digits)


def type_confusion(gold: DataFrame, pred: DataFrame, sample_col: str = "doc_id") -> DataFrame:
    """Gold type x predicted type on equal ``(start, end)``; ``NONE`` for
    missed (no prediction on that span) and spurious (no gold on that span)."""
    keys = [sample_col, "s", "e"]
    both = gold.select(*keys, F.col("type").alias("g"), F.lit(None).cast("string").alias("p")).union(
        pred.select(*keys, F.lit(None).cast("string"), "type"))
    # one exchange, of bare rows: a span has a row or two, so sets made before it save
    # nothing and would sort all rows once more
    spans = both.repartition(*keys).groupBy(*keys).agg(F.collect_set("g").alias("g"), F.collect_set("p").alias("p"))
    none = F.array(F.lit("NONE"))
    side = lambda c: F.when(F.size(c) == 0, none).otherwise(F.col(c))
    pairs = spans.select(F.explode(side("g")).alias("gold_type"), "p").select("gold_type", F.explode(side("p")).alias("pred_type"))
    return pairs.groupBy("gold_type", "pred_type").agg(F.count(F.lit(1)).alias("n"))
