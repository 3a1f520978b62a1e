import hashlib
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from spanweave.llm import pii_anchors as P

A = P.automaton()
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(t):
    """The base kinds straight from their patterns."""
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub(r"[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                  "card": lambda: 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0,
                  "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], P.RANK[x[0]]))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a.b@-+0123459 ()x\n%é１", max_size=40))
def test_parsers_equal_patterns(t):
    assert sorted(P.find_spans(t, A)[0], key=lambda x: (x[1], P.RANK[x[0]])) == plain(t)


def test_known_texts():
    t = "mail a.b@c.de, ip 10.0.0.256 10.0.0.25 card 4111 1111 1111 1111 tel +1 (499) 555-6503 http://x.org/a. token = \"1eb9c6\" @anna"
    base, added = P.find_spans(t, A)
    assert [(k, t[s:e]) for k, s, e in sorted(base, key=lambda x: x[1])] == [
        ("email", "a.b@c.de"), ("ip", "10.0.0.25"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (499) 555-6503")]
    assert [(k, t[s:e]) for k, s, e in added] == [("url", "http://x.org/a"), ("account", "1eb9c6"), ("handle", "@anna")]


def test_table_against_patterns(spark):
    rows = {r.doc_id: r for r in P.op6_pii_anchors(spark, "/root/testdata/sf0.01").collect()}
    docs = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    assert len(rows) == len(docs)
    for i, t in docs:
        want = plain(t or "")
        assert rows[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert rows[i].n_email == sum(k == "email" for k, _, _ in want)
        assert set(x for x in rows[i].spans.split(",") if x) >= {f"{k}:{s}:{e}" for k, s, e in want}


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "", None), (2, "a@b.c " * 50_000, "y"), (2, "q", "y"), (2, "q", "y")],
                               "doc_id long, text string, spans string")
    rows = sorted((r.doc_id or 0, r.n_email) for r in P.personal_data(df).collect())
    assert rows == [(0, 0), (1, 0), (2, 0), (2, 0), (2, 50_000)]
    assert P.personal_data(df.limit(0)).count() == 0
