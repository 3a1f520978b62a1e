"""Token alignment and training rows: W5, J8, B1, B9 (with P9/P10 in tagging).

Character spans are mapped to tokens through a per-row array ``char -> token``
(linear in the text), so no range join over exploded tokens is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.schema import IGNORE_INDEX
from spanweave.sources.fixtures import tokens_expr


def token_offsets(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id, pos, tok, start, end`` of every ``' '``-separated token."""
    t = df.select(id_col, F.expr(tokens_expr(text_col)).alias("tk"))
    z = t.select(id_col, F.posexplode(F.arrays_zip(F.col("tk.toks").alias("tok"), F.col("tk.offs").alias("start")))
                 .alias("pos", "z"))
    return z.select(id_col, F.col("pos").cast("bigint").alias("pos"), F.col("z.tok").alias("tok"),
                    F.col("z.start").cast("bigint").alias("start"),
                    (F.col("z.start") + F.length("z.tok")).cast("bigint").alias("end"))


def char_token_map(text_col: str = "text") -> str:
    """SQL: array of the token index of every character, -1 on separators."""
    return (f"transform(array({tokens_expr(text_col)}), b -> slice(flatten(transform(b.toks, (t, i) -> "
            f"concat(array_repeat(i, length(t)), array(-1)))), 1, length({text_col})))[0]")


def span_to_tokens(df: DataFrame, spans_col: str, text_col: str = "text") -> Column:
    """``array<struct<type, s, e, first_tok, last_tok>>``; spans past the
    end or starting / ending on a separator are skipped."""
    return F.expr(
        f"transform(array({char_token_map(text_col)}), cm -> filter(transform({spans_col}, x -> named_struct("
        "'type', x.type, 's', x.s, 'e', x.e, "
        "'first_tok', CASE WHEN x.s >= 0 AND x.s < size(cm) THEN cm[x.s] ELSE -1 END, "
        "'last_tok', CASE WHEN x.e >= 1 AND x.e <= size(cm) THEN cm[x.e - 1] ELSE -1 END)), "
        "y -> y.first_tok >= 0 AND y.last_tok >= 0))[0]")


def token_label_rows(df: DataFrame, spans_col: str, type_ids: dict[str, int], text_col: str = "text",
                     max_length: int = 512, truncate: bool = False) -> DataFrame:
    """B1: whitespace tokens with label ids (``O`` = 0, ``B-t`` = 2k+1,
    ``I-t`` = 2k+2 for the type's index k), as windows (``window_idx``) of
    ``max_length`` positions, ``-100`` on the two special positions of each; no
    token is dropped unless ``truncate`` asks for the first window only.
    Entities are sorted by start and mapped to token ranges (J8); token tags
    come from the linear F5 builder over token units."""
    from spanweave.operators.tagging import bio_tags_expr
    label_ids = {"O": 0}
    for t, k in type_ids.items():
        label_ids[f"B-{t}"] = 2 * k + 1
        label_ids[f"I-{t}"] = 2 * k + 2
    lmap = "map(" + ", ".join(f"'{lab}', {i}" for lab, i in sorted(label_ids.items())) + ")"
    srt = f"array_sort({spans_col}, (a, b) -> CASE WHEN a.s < b.s THEN -1 WHEN a.s > b.s THEN 1 ELSE 0 END)"
    out = (df.withColumn("_al", span_to_tokens(df, srt, text_col))
             .withColumn("_toks", F.split(F.col(text_col), " ", -1)))
    tok_ents = "transform(_al, a -> named_struct('type', a.type, 'start', a.first_tok, 'end', a.last_tok + 1))"
    n = max_length - 2
    out = out.withColumn("_tags", bio_tags_expr(tok_ents, "size(_toks)"))
    starts = "array(1)" if truncate else f"sequence(1, greatest(size(_toks), 1), {n})"
    windows = F.expr(f"transform({starts}, (at, w) -> named_struct('window_idx', w, 'toks', slice(_toks, at, {n}), "
                     f"'tags', slice(_tags, at, {n})))")
    out = out.select(*df.columns, F.posexplode_outer(windows).alias("window_idx", "_w"))
    labels = F.expr(f"transform(_w.tags, g -> coalesce({lmap}[g], 0))")
    return (out.withColumn("labels", F.concat(F.array(F.lit(IGNORE_INDEX)), labels, F.array(F.lit(IGNORE_INDEX))))
               .withColumn("tokens", F.concat(F.array(F.lit("[CLS]")), F.col("_w.toks"), F.array(F.lit("[SEP]"))))
               .drop("_w"))


def argmax_labels(scores: Column) -> Column:
    """Per position the index of the largest score (first on ties)."""
    return F.transform(scores, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))
