"""Text corpus jobs: F6 chunk_text (card C1), A19 chunk_summary, B3 mlm_rows.

Where a cut falls depends on the cut before it, so chunking is a scan with a
growing result.  As ``aggregate()`` that copies the result at every step
(quadratic in the segments of a line) and boxes every character; an
Arrow-batched function is linear and about ten times faster.  There is no
explode before the segments exist and no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.schema import SENTENCE_ENDS

MASK_TOKEN = "[MASK]"


_ENDS = re.compile("[" + re.escape("".join(SENTENCE_ENDS)) + "]")


def cut_points(text: str, max_length: int) -> list[int]:
    """Ends of the segments of a text longer than ``max_length``: as far as a
    sentence end allows, else ``max_length`` characters on."""
    ends = [m.end() for m in _ENDS.finditer(text)]
    n, at, i, cuts = len(text), 0, 0, []
    while n - at > max_length:
        i = bisect_right(ends, at + max_length, i)
        at = ends[i - 1] if i and ends[i - 1] > at else at + max_length
        cuts.append(at)
    return [*cuts, n]


def chunk_expr(text: str, max_length: int) -> Column:
    """segments of a text as ``array<string>``.

    ``len <= max`` -> the text unchanged (not stripped).  Otherwise the greedy
    cut at sentence ends with forced cuts of ``max`` characters when one
    sentence is too long; pieces are stripped (Python whitespace) and empty
    ones dropped.
    """
    m = int(max_length)

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None or len(t) <= m:
                return None if t is None else [t]
            cuts = cut_points(t, m)
            pieces = (t[a:b].strip() for a, b in zip([0, *cuts], cuts))
            return [p for p in pieces if p]
        return texts.map(one)

    return chunks(F.col(text))


def chunk_text(lines: DataFrame, max_length: int = 128, id_col: str = "line_id",
               text_col: str = "text") -> DataFrame:
    """F6 as rows: ``line_id, seg_idx, segment`` (SEGMENT)."""
    from spanweave.sources.tables import explode_rows
    rows = explode_rows(lines, chunk_expr(text_col, max_length), [id_col], pos_name="seg_idx", name="segment")
    return rows.select(id_col, F.col("seg_idx").cast("int"), "segment")


def chunk_summary(lines: DataFrame, max_length: int = 128, text_col: str = "text") -> DataFrame:
    """Lines in, segments out, and extra segments (``segments - 1`` added
    for every line longer than ``max_length``)."""
    k = F.size(chunk_expr(text_col, max_length))
    long_line = F.length(text_col) > max_length
    per = lines.select(k.alias("k"), long_line.alias("long"))
    return per.agg(F.count(F.lit(1)).alias("lines_in"),
                   F.coalesce(F.sum("k"), F.lit(0)).cast("bigint").alias("segments_out"),
                   F.coalesce(F.sum(F.when(F.col("long"), F.col("k") - 1).otherwise(0)), F.lit(0))
                    .cast("bigint").alias("extra_segments"))


def mask_tokens(tokens: str, key: str, prob: float = 0.15, seed: int | str = 42) -> Column:
    """Replace a token by ``[MASK]`` when the seeded hash of (key, position)
    falls below ``prob``; returns struct<input array, labels array> where labels
    hold the original token at masked positions and NULL elsewhere."""
    thr = format(int(prob * 65536), "04x")
    h = f"substr(md5(concat('{seed}:', {key}, ':', CAST(i AS STRING))), 1, 4) < '{thr}'"
    return F.expr(
        f"transform(array({tokens}), tk -> named_struct("
        f"'input', transform(tk, (t, i) -> CASE WHEN {h} THEN '{MASK_TOKEN}' ELSE t END), "
        f"'labels', transform(tk, (t, i) -> CASE WHEN {h} THEN t END)))[0]")


def mlm_rows(segments: DataFrame, prob: float = 0.15, seed: int | str = 42,
             test_size: float = 0.1) -> DataFrame:
    """Whitespace tokens of each segment, masked, with a seeded holdout
    split (card C7, ``test = ceil(0.1 n)``)."""
    from spanweave.operators.sampling import holdout_split
    seg = segments.withColumn("seg_key", F.concat_ws(":", F.col("line_id").cast("string"),
                                                     F.col("seg_idx").cast("string")))
    tok = seg.withColumn("tokens", F.split("segment", " ", -1))
    m = tok.withColumn("m", mask_tokens("tokens", "seg_key", prob, seed))
    out = m.select("line_id", "seg_idx", "seg_key", F.col("m.input").alias("input_tokens"),
                   F.col("m.labels").alias("labels"))
    return holdout_split(out, "seg_key", seed, test_size)
