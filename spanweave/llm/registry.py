"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("repair_ids", "line_templates", "dart_minhash", "line_crf",
           "simhash_windows", "pii_anchors", "itq_embeddings", "nnls_packing", "noisy_toxicity",
           "trie_counts", "source_divergence", "token_alignment", "url_markov")


def load() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        m = import_module(f"spanweave.llm.{name}")
        queries |= m.QUERIES
        sql |= getattr(m, "ORACLE", {})
    return queries, sql
