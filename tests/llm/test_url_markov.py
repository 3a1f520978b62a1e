import math
import re

import numpy as np
import pyarrow as pa

from spanweave.llm import url_markov as U
from tests.conftest import SF

SCHEMA = "page_id long, url string, host string, score double"


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(urls)], SCHEMA)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.match("[^?#]*", rest[len(host):]).group()


def rule_of(url):
    host, path = parts(url)
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


ODD = [None, "", "no scheme", "http://", "http://ORG", "http://ORG/", "http://a.Example.org/es/x", "http://example.org/es", "http://example.org/en/12?x#y",
       "http://org.com/fr/?q", "http://com/de/#f", "http://badcom/de/", "https://x.com?u=http://a.org/", "a://b://c.org/", "http://É.org/ä", "http://a.com/FR/",
       "http://a.org#://b.com/de/", "http://x.net/" + "a/" * 9000]


def test_hosts_paths_and_rules(spark):
    for r in U.decided(frame(spark, ODD)).collect():
        assert (r.host, r.path) == parts(ODD[r.page_id])
        assert (r.rule, r.decision) == rule_of(ODD[r.page_id])


def test_every_page_has_a_verdict(spark):
    urls = ODD * 3
    got = U.filtered(frame(spark, urls)).collect()
    assert sorted(r.page_id for r in got) == list(range(len(urls)))
    assert all(r.verdict in ("allow", "block") and (rule_of(urls[r.page_id])[1] or r.verdict) == r.verdict for r in got)
    assert U.filtered(spark.createDataFrame([], SCHEMA)).collect() == []
    # one kind of examples only: nothing is known, everything else is allowed
    one = U.filtered(frame(spark, ["http://a.org/"] * 9 + ["http://x.net/"])).collect()
    assert {r.verdict for r in one} == {"allow"} and {r.score for r in one} == {0.0}


def slow_log_prob(counts, classes):
    """Witten-Bell over all contexts of one URL, by the definition."""
    total = 0.0
    for i in range(U.ORDER, len(classes)):
        p = 1 / U.CLASSES
        for k in range(U.ORDER + 1):
            context = tuple(classes[i - k:i])
            after = {c: n for c, n in counts.get(context, {}).items()}
            kinds, seen = max(len(after), 1), sum(after.values())
            p = (after.get(classes[i], 0) + kinds * p) / (seen + kinds)
        total += math.log(p)
    return total


def test_models_equal_the_definition():
    urls = ["http://a.org/x", "", "HTTP://A.org/x1", "http://é/%20"] * 2 + ["http://b.org/"]
    as_classes = [[0] * U.ORDER + U._CLASS[np.frombuffer(u.encode(), np.uint8)].tolist() + [0] for u in urls]
    counts = {}
    for c in as_classes:
        for i in range(U.ORDER, len(c)):
            for k in range(U.ORDER + 1):
                after = counts.setdefault(tuple(c[i - k:i]), {})
                after[c[i]] = after.get(c[i], 0) + 1
    code, n = U.context_codes(pa.array(urls, pa.large_string()))
    table = U.log_model(np.bincount(code, minlength=U.CLASSES ** (U.ORDER + 1)))
    got = U.Ratio(table, 0.0).scores(pa.array(urls, pa.large_string())) * n
    assert np.allclose(got, [slow_log_prob(counts, c) for c in as_classes])
    assert n.tolist() == [len(u.encode()) + 1 for u in urls]
    assert np.allclose(np.exp(table.reshape(-1, U.CLASSES)).sum(1), 1)


def test_cut_separates():
    a, b = np.zeros(U.BINS, int), np.zeros(U.BINS, int)
    a[3000:3010], b[1000:1010] = 5, 5
    bin_of = (U.cut(a, b) + U.RANGE) / (2 * U.RANGE) * U.BINS
    assert 1010 <= bin_of <= 3000
    assert U.cut(a, a * 0) == 0.0


def test_held_out_urls_are_told_apart(spark):
    """Rules' URLs that the models were not counted over."""
    pages = U.decided(spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.1')}/pages.parquet")).where("rule is not null")
    ratio = U.train(pages)
    rows = U.score(pages.where(U._left_out()), ratio).collect()
    right = np.mean([(r.score >= ratio.threshold) == (r.decision == "allow") for r in rows])
    assert len(rows) > 100 and right > 0.9
