"""Prompt builders as column expressions: F7 synthesis, F8 extraction, B2 SFT rows.

The constant part of a prompt (type list, glosses, examples) is built once on
the driver from small aggregates and enters the plan as one literal; only the
per-row part is a column expression.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Glosses of the derived entity types (fixed values).
GLOSSES = {
    "damage": "harm or loss described in the text",
    "datetime": "a date, time or period",
    "location": "a place, region or facility",
    "person": "a person or group of people",
    "work": "a named work, title or product",
}
ANSWER_FORMAT = ('Answer with a JSON array of objects {"type": ..., "text": ..., "span": [start, end]} '
                 "using 0-based character offsets, end exclusive.")
SYNTH_FORMAT = ("Write one sample between <start_annotation> and </end_annotation> as "
                '{"text": ..., "entities": [{"type": ..., "name": ..., "start": ..., "end": ...}]}.')


def type_block(types: list[str], top_names: dict[str, list[str]] | None = None) -> str:
    lines = []
    for t in sorted(types):
        line = f"- {t}: {GLOSSES.get(t, t)}"
        if top_names and top_names.get(t):
            line += " (e.g. " + ", ".join(top_names[t][:5]) + ")"
        lines.append(line)
    return "\n".join(lines)


def examples_block(examples: list[tuple[str, list[dict]]]) -> str:
    out = []
    for i, (text, ents) in enumerate(examples, 1):
        out.append(f"Example {i}:\nText: {text}\n{json.dumps(ents, ensure_ascii=False)}")
    return "\n\n".join(out)


def extraction_prompt(text: Column, types: list[str], examples: list[tuple[str, list[dict]]] | None = None) -> Column:
    """F8: glosses, the answer format, k examples, then the text."""
    prefix = "Extract named entities of these types:\n" + type_block(types) + "\n" + ANSWER_FORMAT + "\n"
    if examples:
        prefix += "\n" + examples_block(examples) + "\n"
    return F.concat(F.lit(prefix + "\nText: "), text, F.lit("\nAnswer:"))


def synthesis_prompt(targets: Column, types: list[str], top_names: dict[str, list[str]],
                     examples: list[tuple[str, list[dict]]]) -> Column:
    """type list with glosses and top-5 names, 3 examples, a task line
    naming the targets, and the output format."""
    prefix = ("Generate a realistic annotated text.\nEntity types:\n" + type_block(types, top_names) + "\n\n"
              + examples_block(examples[:3]) + "\n\n")
    task = F.concat(F.lit("Task: write a text that mentions "),
                    F.array_join(F.transform(targets, lambda x: F.concat(x["name"], F.lit(" ("), x["type"], F.lit(")"))), ", "),
                    F.lit(".\n"))
    return F.concat(F.lit(prefix), task, F.lit(SYNTH_FORMAT))


def sft_windows(prompt: Column, answer_json: Column, max_chars: int = 4096) -> Column:
    """B2: prompt and answer as ``array<struct<window_idx, input, n_ignore>>``:
    windows of ``max_chars`` that lose nothing.  Loss only on the answer, so the
    first ``n_ignore`` positions of a window (what the prompt fills) are ignored."""
    full = F.concat(prompt, answer_json)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(full) - 1), F.lit(max_chars))
    bound = F.array(F.struct(full.alias("t"), F.length(prompt).alias("p")))
    return F.element_at(F.transform(bound, lambda b: F.transform(starts, lambda at: F.struct(
        (at / max_chars).cast("int").alias("window_idx"), F.substring(b["t"], at + 1, F.lit(max_chars)).alias("input"),
        F.least(F.greatest(b["p"] - at, F.lit(0)), F.least(F.length(b["t"]) - at, F.lit(max_chars))).alias("n_ignore")))), 1)
