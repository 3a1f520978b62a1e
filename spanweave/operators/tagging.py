"""Tag-level path: S9, P5, P6, P9, P10, F5, W3, W9, A5, F15, B9.

Tag arrays are built and decoded inside each row with higher-order functions:
no character explode, no shuffle.

* ``bio_tags`` (card C3) sorts the spans of a row by start and emits gap, span,
  gap as ``array_repeat`` pieces in one sweep.  Only rows whose spans overlap
  resolve the overlaps (later entity wins, W9): a span is the union of two
  windows whose length is a power of two; the last entity of every window is
  handed down to its two halves, from the longest windows to single characters.
  That is linear in the text for each power of two up to the longest span, and
  sorts the spans once, however they overlap.
* ``bio_to_spans`` (card C4, lenient chunk rules) pairs the k-th chunk start
  with the k-th chunk end, both found by one pass over the tag array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.schema import IGNORE_INDEX, OUTSIDE


def label_vocab(types: DataFrame, type_col: str = "type") -> DataFrame:
    """``O`` = 0, then ``B-t`` = 2k+1 and ``I-t`` = 2k+2 for the k-th type
    in sorted order.  Returns ``label_id, label, type``; small, broadcast it."""
    t = types.select(F.col(type_col).alias("type")).distinct()
    ordered = t.select(F.array_sort(F.collect_list("type")).alias("ts"))
    rows = ordered.select(F.posexplode("ts").alias("k", "type"))
    bi = rows.select(F.explode(F.array(
        F.struct((2 * F.col("k") + 1).alias("label_id"), F.concat(F.lit("B-"), "type").alias("label"), "type"),
        F.struct((2 * F.col("k") + 2).alias("label_id"), F.concat(F.lit("I-"), "type").alias("label"), "type"),
    )).alias("x")).select("x.*")
    o = types.sparkSession.createDataFrame([(0, OUTSIDE, None)], "label_id int, label string, type string")
    return o.unionByName(bi.select(F.col("label_id").cast("int"), "label", "type"))


def known_types(entities: DataFrame, vocab: DataFrame) -> DataFrame:
    """Keep entities whose type is in the vocabulary (left-semi join on
    the broadcast vocabulary, which has one row per label)."""
    types = vocab.where(F.col("type").isNotNull()).select("type").distinct()
    return entities.join(F.broadcast(types), "type", "left_semi")


def _clean_spans(ents: str, n: str) -> str:
    """Entities with ``start < end`` clipped to ``[0, n)``, as struct<t, s, e, k>
    where ``k`` is the list position (later wins)."""
    return (f"filter(transform({ents}, (x, k) -> named_struct('t', x.type, "
            f"'s', greatest(x.start, 0), 'e', least(x.end, {n}), 'b', x.start >= 0, 'k', k)), "
            f"x -> x.s < x.e AND x.t IS NOT NULL)")


def bio_tags_expr(entities: str = "ents", length: str = "length(text)") -> Column:
    """one tag per character from ``array<struct<type, start, end>>``.

    Later entities overwrite earlier ones (W9).  Spans are clipped to the
    text; a negative start writes no ``B-``; empty spans write nothing.
    The length, the cleaned spans and the boundaries are bound once through
    lambda variables so nothing is recomputed per element.
    """
    sp = _clean_spans(entities, "n")
    # the last entity that owns each character
    windows = ("flatten(transform(sp, (x, j) -> transform(array(length(bin(x.e - x.s)) - 1), p -> array("
               "named_struct('p', p, 'i', x.s, 'j', j), named_struct('p', p, 'i', x.e - shiftleft(1, p), 'j', j)))[0]))")
    last = "filter(sw, (x, q) -> q = size(sw) - 1 OR sw[q + 1].p <> x.p OR sw[q + 1].i <> x.i)"
    own = ("concat(flatten(transform(lv, (x, q) -> concat(array_repeat(-1, x.i - CASE WHEN q = 0 THEN 0 ELSE lv[q - 1].i + 1 END), array(x.j)))), "
           "array_repeat(-1, n - CASE WHEN size(lv) = 0 THEN 0 ELSE lv[size(lv) - 1].i + 1 END))")
    down = (f"transform(array(filter(lw, x -> x.p = p)), lv -> transform({own}, (v, i) -> "
            "greatest(v, acc[i], CASE WHEN i >= shiftleft(1, p) THEN acc[i - shiftleft(1, p)] ELSE -1 END)))[0]")
    owners = (f"transform(array(sort_array({windows})), sw -> transform(array({last}), lw -> "
              f"aggregate(sequence(lw[size(lw) - 1].p, 0, -1), array_repeat(-1, n), (acc, p) -> {down}))[0])[0]")
    overlapping = (f"transform({owners}, (k, i) -> CASE WHEN k < 0 THEN 'O' WHEN sp[k].b AND sp[k].s = i THEN concat('B-', sp[k].t) "
                   "ELSE concat('I-', sp[k].t) END)")
    # spans in order of their start: the gap before each, the span, the gap at the end
    gap = "array_repeat('O', x.s - CASE WHEN i = 0 THEN 0 ELSE so[i - 1].e END)"
    own = ("CASE WHEN x.b THEN concat(array(concat('B-', x.t)), array_repeat(concat('I-', x.t), x.e - x.s - 1)) "
           "ELSE array_repeat(concat('I-', x.t), x.e - x.s) END")
    apart = (f"concat(flatten(transform(so, (x, i) -> concat({gap}, {own}))), "
             "array_repeat('O', n - CASE WHEN size(so) = 0 THEN 0 ELSE so[size(so) - 1].e END))")
    overlap = "exists(slice(sequence(0, size(so)), 2, greatest(size(so) - 1, 0)), i -> so[i].s < so[i - 1].e)"
    by_start = "array_sort(sp, (p, q) -> CASE WHEN p.s <> q.s THEN p.s - q.s ELSE p.k - q.k END)"
    body = (f"transform(array({length}), n -> CASE WHEN n <= 0 THEN CAST(array() AS ARRAY<STRING>) ELSE "
            f"transform(array({sp}), sp -> transform(array({by_start}), so -> "
            f"CASE WHEN {overlap} THEN {overlapping} ELSE {apart} END)[0])[0] END)[0]")
    return F.expr(body)


def spans_to_entities(arr: str, s: str = "s", e: str = "e") -> str:
    """array<struct<type, s, e, ...>> -> array<struct<type, start, end>>."""
    return f"transform({arr}, x -> named_struct('type', x.type, 'start', CAST(x.{s} AS INT), 'end', CAST(x.{e} AS INT)))"


def bio_to_spans_expr(tags: str = "tags") -> Column:
    """Lenient chunks of a tag array as array<struct<type, s, e>>.

    A chunk starts at ``B-x``, or at ``I-x`` after ``O``, the sequence start or
    another type; it ends before ``B-``, ``O`` or a type change.
    """
    typ = "substr({t}, 3)"
    start = (f"(substr(tg[i], 1, 2) = 'B-' OR (substr(tg[i], 1, 2) = 'I-' AND "
             f"(i = 0 OR tg[i - 1] = 'O' OR substr(tg[i - 1], 3) <> substr(tg[i], 3))))")
    nxt_continues = ("(i + 1 < size(tg) AND substr(tg[i + 1], 1, 2) = 'I-' AND "
                     "substr(tg[i + 1], 3) = substr(tg[i], 3))")
    end = f"(tg[i] <> 'O' AND NOT {nxt_continues})"
    body = (f"transform(array({tags}), tg -> transform(array(named_struct("
            f"'st', filter(slice(sequence(0, size(tg)), 1, size(tg)), i -> tg[i] <> 'O' AND {start}), "
            f"'en', filter(slice(sequence(0, size(tg)), 1, size(tg)), i -> {end}))), "
            f"b -> transform(b.st, (x, k) -> named_struct('type', {typ.format(t='tg[x]')}, "
            "'s', x, 'e', b.en[k] + 1)))[0])[0]")
    return F.expr(body)


def token_accuracy(df: DataFrame, gold_col: str = "gold_tags", pred_col: str = "pred_tags") -> DataFrame:
    """A5: equal tags / all tags over all sequences (each pair cut to the
    shorter length); ``O`` counts."""
    eq = F.expr(f"size(filter(zip_with(slice({gold_col}, 1, least(size({gold_col}), size({pred_col}))), "
                f"{pred_col}, (a, b) -> a = b), x -> x))")
    n = F.least(F.size(gold_col), F.size(pred_col))
    t = df.agg(F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("n_tags"),
               F.coalesce(F.sum(eq), F.lit(0)).cast("bigint").alias("n_equal"))
    return t.select(F.round(F.coalesce(F.try_divide(F.col("n_equal").cast("double"), F.col("n_tags")),
                                       F.lit(0.0)), 6).alias("accuracy"), "n_tags", "n_equal")


def transition_audit(df: DataFrame, tags_col: str = "tags") -> DataFrame:
    """counts of tag bigrams (``<s>`` before the first tag) with their
    legality under the transition mask: start -> B-*/O; any -> B-*/O;
    B-x -> I-x; I-x -> I-x.  Exploded bigrams are aggregated in the same
    stage (map-side partial counts), so only distinct bigrams are shuffled."""
    pairs = F.expr(f"transform(array({tags_col}), tg -> transform(slice(sequence(0, size(tg)), 1, size(tg)), "
                   "i -> named_struct('prev_tag', CASE WHEN i = 0 THEN '<s>' ELSE tg[i - 1] END, "
                   "'tag', tg[i])))[0]")
    from spanweave.sources.tables import explode_rows
    rows = explode_rows(df, pairs, [])
    c = rows.groupBy("prev_tag", "tag").agg(F.count(F.lit(1)).alias("n"))
    legal = (F.col("tag").startswith("B-") | (F.col("tag") == OUTSIDE)
             | (F.col("prev_tag").substr(1, 2).isin("B-", "I-")
                & F.col("tag").startswith("I-")
                & (F.expr("substr(prev_tag, 3)") == F.expr("substr(tag, 3)"))))
    return c.withColumn("legal", legal)


def explode_chars(df: DataFrame, text_col: str = "text", tags_col: str = "tags") -> DataFrame:
    """P5: character tokens and their tags; rows that already carry ``tokens``
    and ``ner_tags`` pass through unchanged."""
    if "tokens" in df.columns and "ner_tags" in df.columns:
        return df
    return df.withColumn("tokens", F.split(text_col, "")).withColumnRenamed(tags_col, "ner_tags")


def mask_ignored(df: DataFrame, labels_col: str = "labels", preds_col: str = "preds") -> DataFrame:
    """Drop positions labelled ``-100`` in both sequences; drop sequences
    left empty."""
    z = F.filter(F.arrays_zip(F.col(labels_col), F.col(preds_col)),
                 lambda x: x[labels_col] != IGNORE_INDEX)
    out = (df.withColumn("_z", z)
             .withColumn(labels_col, F.transform("_z", lambda x: x[labels_col]))
             .withColumn(preds_col, F.transform("_z", lambda x: x[preds_col])).drop("_z"))
    from spanweave.sources.tables import keep_if
    return keep_if(out, F.size(labels_col) > 0)


def ids_to_labels(df: DataFrame, vocab: DataFrame, ids_col: str, out_col: str = "labels") -> DataFrame:
    """P10: id -> label; unknown ids become ``UNK-<id>``.  The vocabulary (two
    labels per type of a model's tag set) is one row with a map, joined to all."""
    names = vocab.agg(F.map_from_entries(F.collect_list(F.struct(F.col("label_id").cast("long"), "label"))).alias("_vocab"))
    label = F.transform(ids_col, lambda i: F.coalesce(F.try_element_at("_vocab", i.cast("long")), F.concat(F.lit("UNK-"), i.cast("string"))))
    return df.crossJoin(F.broadcast(names)).withColumn(out_col, label).drop("_vocab")
