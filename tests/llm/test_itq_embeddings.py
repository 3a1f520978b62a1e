import duckdb
import numpy as np

from spanweave.llm import itq_embeddings as Q
from spanweave.llm.components import components


def brute(rows, cosine=0.93):
    ids, labels, x = [r[0] for r in rows], np.array([r[2] for r in rows]), np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = (x @ x.T >= cosine) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(close, False)
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root, np.where(close, root[None, :], len(ids)).min(1))
        if (low == root).all():
            break
        root = low
    return {ids[i]: (int(close[i].sum()), min(ids[j] for j in range(len(ids)) if root[j] == root[i])) for i in range(len(ids))}


def test_recall_against_brute_force(spark):
    rows = duckdb.sql("select vec_id, embedding, label from '/root/testdata/sf0.1/embeddings.parquet' order by vec_id").fetchall()
    rng = np.random.default_rng(5)
    rows += [(10_000 + i, (np.array(rows[i % 700][1]) + rng.normal(size=64) * s * np.std(rows[i % 700][1])).tolist(), rows[i % 700][2])
             for i, s in enumerate(rng.uniform(0.02, 0.4, 1400))]
    want = brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in Q.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    links = sum(n for n, _ in want.values())
    found = sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert links > 2000 and found >= 0.97 * links, (found, links)
    assert np.mean([got[i].component_id == c for i, (_, c) in want.items()]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_tiles_do_not_change_links(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(3, 16))
    rows = [(i, (centre[i % 3] + 0.05 * rng.normal(size=16)).tolist(), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows)
    for tile in (1000, 7):
        got = {r.vec_id: (r.n_links, r.component_id) for r in Q.near_duplicates(df, tile=tile).collect()}
        assert got == want


def test_odd_rows(spark):
    v = [1.0, 2.0]
    rows = [(1, v, 0, "x"), (2, v, 0, "x"), (2, v, 0, "x"), (3, v, None, "x"), (4, None, 0, "x"), (5, [0.0, 0.0], 0, "x"), (6, [float("nan"), 1.0], 0, "x"),
            (7, [1.0, None], 0, "x"), (8, [1.0, 2.0, 0.0], 0, "x"), (9, [2.0, 4.0], 0, "x"), (10, v, 1, "x"), (None, v, 1, "x"), (11, [], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in Q.near_duplicates(df).collect())
    assert got == [(0, 1, 10, False), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True),
                   (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 3, 1, False), (10, 1, 10, True), (11, 0, 11, True)]
    assert Q.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (41, 40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 42)}, 101: 100, 102: 100}


def test_extreme_lengths_link(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1e200, 1e200], 0), (3, [1e-200, 0.0], 0), (4, [1e-200, 0.0], 0), (5, [5e-324, 5e-324], 0), (6, [1.0, 1.0], 0),
            (7, [1e308, -1e308], 0), (8, [-1.0, 0.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in Q.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (1, 3), 4: (1, 3), 5: (3, 1), 6: (3, 1), 7: (0, 7), 8: (0, 8)}


def test_compared_pairs_grow_little_faster_than_the_vectors(spark):
    rng = np.random.default_rng(3)
    pairs = {}
    for n in (4000, 32_000):
        rows = [(f"{i:08d}".encode(), "0", 64, rng.normal(size=64).tobytes(), i) for i in range(n)]
        usable = spark.createDataFrame(rows, "key binary, label string, dim int, vec binary, vec_id long")
        entries, bucket = Q.table_members(Q.encoded_classes(usable, sample=2000))
        pairs[n] = sum(r["count"] ** 2 for r in entries.groupBy(*bucket).count().collect())
    assert pairs[32_000] / pairs[4000] <= 8 ** 1.25


def test_tables_bring_pairs_at_the_threshold_together():
    for n in (10, 5000, 10**6, 10**9):
        width, count = Q.tables(n)
        meet = (1 - np.arccos(Q.COSINE) / np.pi) ** width
        assert (1 - meet) ** count <= Q.MISSED and width * count < 4000
