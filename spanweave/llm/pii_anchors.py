"""Personal data by anchor expansion (operator 6).

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, scheme
marks, identifier cues) in one pass over a text; deterministic local parsers
expand each anchor to its span and validate it.  No pattern is searched from
every position of the text.

Base kinds, leftmost non-overlapping per kind, failing matches dropped without
retries: ``email``, ``ip``, ``card`` (12-19 digits, Luhn), ``phone`` (9-15
digits).  Added kinds: ``url`` (scheme and host), ``account`` (an identifier
with a digit that follows a cue), ``handle`` (``@name`` without local part).

Defined results: a null or empty text has no spans; offsets are code points,
ends exclusive; a null ``doc_id`` and repeated rows are kept as they are, one
result row per input row; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanweave.llm.common import column, table, text_slices

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url", "account", "handle")
RANK = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DIGITS = frozenset("0123456789")
CUES = ("account", "acct", "iban", "ssn", "passport", "user id", "userid", "username", "customer id",
        "password", "api_key", "api key", "apikey", "token", "secret")

# Local parsers, always anchored at a position the automaton reported.
_IP_AT = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD_AT = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE_AT = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_REST = re.compile(r"[^\s<>\"'{}|\\^`\[\]]+")
_HOST = re.compile(r"(?:[^/?#@]*@)?(?:[\w-]+(?:\.[\w-]+)+|localhost)(?::[0-9]+)?(?:[/?#]|$)")
_IDENT = re.compile(r"[ \t]*(?:no\.?|number|nr\.?|id)?[ \t]*[:=#]?[ \t]*[\"']?([A-Za-z0-9][A-Za-z0-9_-]{5,})")
_HANDLE = re.compile(r"@[A-Za-z0-9_]{3,}")

SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
          "spans string, n_added long")


def automaton():
    """The anchors; ids tell the parser: digit, at-sign, plus, scheme, cue."""
    import ahocorasick
    a = ahocorasick.Automaton()
    for d in DIGITS:
        a.add_word(d, (0, 1))
    a.add_word("@", (1, 1))
    a.add_word("+", (2, 1))
    a.add_word("://", (3, 3))
    for cue in CUES:
        for form in {cue, cue.title(), cue.upper(), cue.capitalize()}:
            a.add_word(form, (4, len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _email_at(t: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and t[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    n, end, labels = len(t), at + 1, 0
    while True:
        p = end
        while p < n and t[p] in LABEL:
            p += 1
        if p == end:
            break
        labels, last = labels + 1, p
        if p < n and t[p] == ".":
            end = p + 1
            continue
        break
    return (start, last) if labels > 1 else None


def find_spans(t: str, anchors) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base and added spans of one text."""
    base, added = [], []
    email_end = ip_end = card_end = phone_end = url_end = account_end = 0
    for last, (what, size) in anchors.iter(t):
        p = last - size + 1
        if what == 0:
            if p >= ip_end and not (p and t[p - 1] in DIGITS):
                m = _IP_AT.match(t, p)
                if m:
                    ip_end = m.end()
                    parts = [x.lstrip("0") for x in m.group().split(".")]
                    if all(len(x) <= 3 and int(x or 0) <= 255 for x in parts):
                        base.append(("ip", p, ip_end))
            if p >= card_end:
                m = _CARD_AT.match(t, p)
                if m:
                    card_end = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        base.append(("card", p, card_end))
        elif what == 1:
            hit = _email_at(t, p, email_end)
            if hit:
                email_end = hit[1]
                base.append(("email", *hit))
            elif not (p and (t[p - 1].isalnum() or t[p - 1] in LOCAL)):
                m = _HANDLE.match(t, p)
                if m:
                    added.append(("handle", p, m.end()))
        elif what == 2:
            if p >= phone_end:
                m = _PHONE_AT.match(t, p)
                if m:
                    phone_end = m.end()
                    if 9 <= sum(c in DIGITS for c in m.group()) <= 15:
                        base.append(("phone", p, phone_end))
        elif what == 3:
            start = p
            while start > url_end and t[start - 1] in SCHEME:
                start -= 1
            while start < p and not (t[start].isascii() and t[start].isalpha()):
                start += 1
            m = _URL_REST.match(t, p + 3)
            if start < p and m:
                rest = m.group().rstrip(".,;:!?)")
                if _HOST.match(rest):
                    url_end = p + 3 + len(rest)
                    added.append(("url", start, url_end))
        elif not (p and (t[p - 1].isalnum() or t[p - 1] == "_")):
            m = _IDENT.match(t, last + 1)
            if m and m.start(1) > last + 1 and m.start(1) >= account_end and any(c in DIGITS for c in m.group(1)):
                account_end = m.end(1)
                added.append(("account", m.start(1), account_end))
    return base, added


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], RANK[x[0]])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for batch, texts in text_slices(batches):
        out = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
        for t in texts.to_pylist():
            base, added = find_spans(t, anchors) if t else ([], [])
            for k in BASE_KINDS:
                out[f"n_{k}"].append(sum(1 for x in base if x[0] == k))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(base + added))
            out["n_added"].append(len(added))
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id").cast(pa.int64()), *(pa.array(out[f"n_{k}"], pa.int64()) for k in BASE_KINDS),
             pa.array(out["base_sha256"], pa.string()), pa.array(out["spans"], pa.string()),
             pa.array(out["n_added"], pa.int64())],
            ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data of every text: one narrow pass, no shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)


def op6_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


QUERIES = {"op6_pii_anchors": op6_pii_anchors}
