"""Registered queries, grouped by area.  Importing this package fills
``spanweave.catalog.QUERIES`` and ``ORACLE``."""

from spanweave.queries import (  # noqa: F401
    alignment_q, corpus_q, corpus_text_q, fewshot_q, inference_q, parsing_q, planning_q, runs_q, scoring_q,
    results_q, streaming_q, tagging_q)
