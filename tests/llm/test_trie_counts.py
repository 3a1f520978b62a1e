from hypothesis import given, settings
from hypothesis import strategies as st

from spanweave.llm import trie_counts as T

SCORES, BYTE = T.read_pieces(T.default_model())


def best(word):
    """Best path of one pre-token on its own."""
    x, memo = T.MARK + word, {0: (0, 0)}
    for i in range(1, len(x) + 1):
        options = [(memo[j][0] - SCORES[x[j:i]], memo[j][1] + 1) for j in range(i) if x[j:i] in SCORES]
        if x[i - 1] not in SCORES:
            k = len(x[i - 1].encode())
            options.append((memo[i - 1][0] - k * BYTE, memo[i - 1][1] + k))
        memo[i] = min(options)
    return memo[len(x)][1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcthe inóñ漢😀", min_size=1, max_size=14).map(lambda s: s.replace(" ", "x")), max_size=20))
def test_equals_single_words(words):
    words = list(dict.fromkeys(words))
    assert T.TrieCounter(SCORES, BYTE).counts(words).tolist() == [best(w) for w in words]


def test_prefix_computed_once():
    c = T.TrieCounter(SCORES, BYTE)
    c.counts(["abc", "abcd", "abce", "abc"])
    assert c.prefixes == 1 + 3 + 1 + 1


def test_cache_does_not_change_counts():
    words = [f"w{i}the" for i in range(50)]
    small = T.TrieCounter(SCORES, BYTE, cache=10)
    assert [int(small.counts([w])[0]) for w in words] == T.TrieCounter(SCORES, BYTE).counts(words).tolist()


def test_rows(spark):
    df = spark.createDataFrame([(1, "the cat  sat\non 漢"), (2, None), (3, ""), (None, " \n"), (3, "the " * 100_000)], "doc_id long, text string")
    rows = sorted(((r.doc_id or 0), r.n_words, r.n_tokens) for r in T.token_counts(df).collect())
    assert rows == [(0, 0, 0), (1, 5, sum(map(best, ["the", "cat", "sat", "on", "漢"]))), (2, 0, 0), (3, 0, 0), (3, 100_000, 100_000 * best("the"))]
    assert T.token_counts(df.limit(0)).count() == 0
