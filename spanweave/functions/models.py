"""Model name rules as column expressions: F9 model_family, F10 run_flags.

One expression per rule, shared by every report.  Substring rules are fixed
values, in order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered substring rules: (any of these substrings, family).  Fixed values.
FAMILY_RULES = (
    (("xlnet",), "xlnet"),
    (("luke",), "luke"),
    (("bilstm",), "bilstm"),
    (("rinna", "gpt-neox"), "rinna"),
    (("elyza", "llama"), "llama"),
    (("gpt-4", "chatgpt"), "chatgpt"),
    (("claude",), "claude"),
    (("gpt",), "gpt"),
)
BERT_VARIANTS = ("deberta", "roberta", "albert")
# Traits of a run: the marks that show it, and the columns they are looked for in.  Fixed values.
TRAITS = {
    "bilstm": (("bilstm",), ("key", "name")),
    "remote": (("chatgpt", "claude", "remote"), ("key",)),
    "llama": (("llama", "rinna", "gpt-neox", "elyza"), ("key", "name")),
    "large": (("large",), ("key", "name")),
    "crf": (("_crf",), ("key",)),
}
# Model type: the first of these traits that holds, else "bert".
TYPE_OF_TRAIT = (("bilstm", "bilstm"), ("remote", "remote_llm"), ("llama", "llama"))
# Display suffixes: trait, suffix, and the marks in the key that already say it.
SUFFIXES = (("large", "-large", ("large",)), ("crf_set", "-crf", ("_crf", "-crf")))
# At most one bracketed flag: the first whose trait holds and whose key doesn't say it.
FLAGS = (("bilstm", " [BiLSTM]", ("bilstm",)), ("llama", " [LLM]", ("llama", "rinna")), ("remote", " [API]", ("remote",)))


def _any(c: Column, subs) -> Column:
    out = F.lit(False)
    for s in subs:
        out = out | c.contains(s)
    return out


def model_family(name: Column) -> Column:
    """short key of a model name."""
    low = F.lower(name)
    bert = F.lit("bert")
    for v in reversed(BERT_VARIANTS):
        bert = F.when(low.contains(v), F.lit(v)).otherwise(bert)
    last = F.substring(F.replace(F.element_at(F.split(name, "/"), -1), F.lit("-"), F.lit("_")), 1, 20)
    out = last
    for subs, fam in reversed(FAMILY_RULES):
        out = F.when(_any(low, subs), F.lit(fam)).otherwise(out)
    return F.when(low.contains("bert"), bert).otherwise(out)


def run_flags(model_key: Column, model_name: Column, use_crf_hp: Column) -> Column:
    """struct<use_crf, is_large, model_type, display_name>, read off the
    trait tables above."""
    shown = F.coalesce(model_key, F.lit(""))
    where = {"key": F.lower(shown), "name": F.lower(F.coalesce(model_name, F.lit("")))}
    holds = {}
    for trait, (marks, columns) in TRAITS.items():
        found = F.lit(False)
        for c in columns:
            found = found | _any(where[c], marks)
        holds[trait] = found
    holds["crf_set"] = F.coalesce(use_crf_hp, F.lit(False))
    unsaid = lambda trait, marks: holds[trait] & ~_any(where["key"], marks)
    model_type = F.coalesce(*[F.when(holds[t], F.lit(v)) for t, v in TYPE_OF_TRAIT], F.lit("bert"))
    suffixes = [F.when(unsaid(t, said), F.lit(text)).otherwise("") for t, text, said in SUFFIXES]
    flag = F.coalesce(*[F.when(unsaid(t, said), F.lit(text)) for t, text, said in FLAGS], F.lit(""))
    return F.struct((holds["crf_set"] | holds["crf"]).alias("use_crf"), holds["large"].alias("is_large"),
                    model_type.alias("model_type"), F.concat(shown, *suffixes, flag).alias("display_name"))
