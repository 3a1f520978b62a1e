"""Column expressions that parse model replies (cards C2, F2, F4).

All parsing stays in the JVM: regular expressions with possessive
quantifiers (no catastrophic backtracking on long replies) and the VARIANT
functions (``try_parse_json``, ``try_variant_get``, ``schema_of_variant``).
A JSON array with a bad element still parses: elements are read one by one
as ``array<variant>`` and validated individually.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanweave.schema import ANNOTATION_CLOSE, ANNOTATION_OPEN, ANSWER_MARKER

# Whitespace removed by Python's str.strip(): Java's \s plus the information
# separators, NEL, NBSP and the Unicode spaces (fixed values).
PY_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Nesting depth of arrays that the reply patterns follow (an entity array needs three or four).
ARRAY_DEPTH = 64
FENCE_MARK, FENCE_TAG = "```", "json"


def array_pattern(depth: int = ARRAY_DEPTH, possessive: bool = True) -> str:
    """Pattern of a bracketed array with at most ``depth`` levels: each level
    wraps the one below.  A bracket inside a JSON string is a character like any
    other; an array with a string that doesn't end is none.  Possessive
    quantifiers never backtrack."""
    p = "+" if possessive else ""
    string = rf'"(?:[^"\\]+{p}|\\.)*{p}"'
    level = rf'\[(?:[^\[\]"]+{p}|{string})*{p}\]'
    for _ in range(depth - 1):
        level = rf'\[(?:[^\[\]"]+{p}|{string}|{level})*{p}\]'
    return f"(?s:{level})"


BALANCED = array_pattern()
ANSWER = ANSWER_MARKER + r"\s*(" + BALANCED + ")"
OBJECT = r"(?s)\{.*\}"


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: leading and trailing Unicode whitespace."""
    return F.regexp_replace(c, f"^{PY_SPACE}+|{PY_SPACE}+$", "")


def strip_fence(r: Column) -> Column:
    """Body of the first code fence (without its language tag), when the reply
    has an opening and a closing mark."""
    parts = F.split(r, FENCE_MARK, 3)
    body = F.regexp_replace(parts[1], "^" + FENCE_TAG, "")
    return F.when(F.size(parts) == 3, py_strip(body)).otherwise(r)


def answer_array(r: Column) -> Column:
    """The array string a reply answers with (card C2 step 3): the balanced
    array after the marker, else the last balanced array, else ``[]``."""
    last = F.try_element_at(F.regexp_extract_all(r, F.lit(BALANCED), F.lit(0)), F.lit(-1))
    return F.when(r.rlike(ANSWER), F.regexp_extract(r, ANSWER, 1)).otherwise(F.coalesce(last, F.lit("[]")))


def elements(arr_json: Column) -> Column:
    """``array<variant>`` of a JSON array string; NULL when it does not parse
    or is not an array."""
    v = F.try_parse_json(arr_json)
    return F.try_variant_get(v, "$", "array<variant>")


def line_fallback(r: Column) -> Column:
    """Card C2 step 6: the bottom-most line that starts with ``[`` and parses
    as a JSON array, as ``array<variant>``."""
    lines = F.transform(F.reverse(F.split(r, "\n", -1)), py_strip)
    parsed = F.transform(F.filter(lines, lambda ln: ln.startswith("[")), elements)
    return F.try_element_at(F.filter(parsed, lambda x: x.isNotNull()), F.lit(1))


def is_int(v: Column) -> Column:
    """A JSON integer (``1.0``, booleans and strings are not)."""
    return F.coalesce(F.schema_of_variant(v) == F.lit("BIGINT"), F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def get_str(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def get_int(v: Column, path: str) -> Column:
    """Integer at ``path`` or NULL when absent or not an integer."""
    m = F.try_variant_get(v, path, "variant")
    return F.when(is_int(m), F.try_variant_get(m, "$", "bigint"))


def annotation_body(r: Column) -> Column:
    """text between the annotation tags when both are there, then the first
    ``{`` to the last ``}``."""
    after = F.try_element_at(F.split(r, ANNOTATION_OPEN, 2), F.lit(2))
    inner = F.when(after.contains(ANNOTATION_CLOSE), F.split(after, ANNOTATION_CLOSE, 2)[0])
    return F.regexp_extract(F.coalesce(inner, r), OBJECT, 0)


def first_array(r: Column) -> Column:
    """the first balanced array in a reply."""
    return F.when(r.rlike(BALANCED), F.regexp_extract(r, BALANCED, 0))


__all__ = ["py_strip", "strip_fence", "answer_array", "line_fallback", "is_int", "is_object",
           "get_str", "get_int", "annotation_body", "first_array", "elements", "BALANCED",
           "PY_SPACE"]
