"""Deterministic, exact hash-order sampling (card C7): W6, W7, L5, L6, U1.

Every row gets an order key ``md5('<seed>:<id>')`` (ties broken by the id).
"The first k rows of a seeded shuffle" is then "all rows whose (key, id) is at
most the k-th smallest (key, id)".  Keys of distinct ids are uniform, so the
row count says where the k-th smallest lies, give or take a few times
``sqrt(n)`` rows: one aggregate counts what is below that bracket and, in it,
the single keys (in a large table ``_PARTS`` parts of it, one of which the next
job looks at).  That is two or three passes with the count.  A cut outside its
bracket (an id that fills the table) is found by histogram refinement on key
prefixes instead.  Either way rows are never shuffled and the driver sees a few
thousand groups; the split itself is a projection that compares each row's key
with the cut keys.  A global ``row_number`` would run in one task instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.functions.replies import py_strip
from spanweave.schema import SPLITS

_DIGITS = 3          # hex digits added per refinement round -> 4,096 buckets
_LEAF = 4096         # collect a bucket once it is this small
_PARTS = 4096        # parts of a bracket with more keys
_SIGMAS = 6          # half the width of a bracket
_BITS = 60           # of the key that brackets are made of
_KEY, _ID = "_hkey", "_hid"


def hash_key(id_col: str | Column, seed: int | str) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def kth_keys(df: DataFrame, id_col: str, seed: int | str, ranks: list[int], n: int | None = None) -> dict[int, tuple]:
    """Return ``{rank: (key, id)}`` of the rank-th smallest pair (1-based); ``n``:
    the row count, where it is known."""
    n = df.count() if n is None else n
    wanted = sorted(r for r in set(ranks) if r > 0)
    if wanted and wanted[-1] > n:
        raise ValueError(f"rank {wanted[-1]} exceeds the row count")
    keyed = df.select(hash_key(id_col, seed).alias(_KEY), F.col(id_col).alias(_ID))
    out = _in_brackets(keyed, wanted, n)
    return out | _by_prefixes(keyed, [r for r in wanted if r not in out])


def _brackets(ranks: list[int], n: int) -> list[list[int]]:
    """Key ranges ``[low, high)`` that hold the ranks, overlapping ones as one."""
    out: list[list[int]] = []
    for r in ranks:
        spread = _SIGMAS * math.sqrt(r * (n - r) / n) + 32
        low, high = (min(max(int((r + x) / n * 2 ** _BITS), 0), 2 ** _BITS) for x in (-spread, spread))
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return out


def _walk(groups: list[tuple], rank: int):
    """The group that holds the rank, and the rank inside it."""
    for *group, count in groups:
        if rank <= count:
            return (*group, rank)
        rank -= count
    return None


def _in_brackets(keyed: DataFrame, ranks: list[int], n: int) -> dict[int, tuple]:
    """Cut keys of the ranks that lie in their brackets."""
    if not ranks:
        return {}
    place = F.conv(F.substring(_KEY, 1, _BITS // 4), 16, 10).cast("bigint")
    brackets = _brackets(ranks, n)
    fine = sum(high - low for low, high in brackets) / 2 ** _BITS * n <= _LEAF
    # segment 2 i + 1 is bracket i, segment 2 i what lies before it
    segment, part = F.lit(2 * len(brackets)), F.lit(None).cast("bigint")
    for i, (low, high) in reversed(list(enumerate(brackets))):
        segment = F.when(F.col("place") < low, 2 * i).when(F.col("place") < high, 2 * i + 1).otherwise(segment)
        part = F.when((F.col("place") >= low) & (F.col("place") < high), F.floor((F.col("place") - low) / max((high - low) / _PARTS, 1))).otherwise(part)
    rows = keyed.select("*", place.alias("place")).select(_KEY, _ID, segment.alias("segment"), part.alias("part"))
    inside = F.col("segment") % 2 == 1
    if fine:
        found = rows.groupBy("segment", F.when(inside, F.col(_KEY)).alias(_KEY), F.when(inside, F.col(_ID)).alias(_ID))
        groups = sorted(((r.segment, (r[_KEY], r[_ID]), r["count"]) for r in found.count().collect()), key=lambda g: (g[0], g[1] if g[0] % 2 else ()))
        held = {r: _walk(groups, r) for r in ranks}
        return {r: g[1] for r, g in held.items() if g and g[0] % 2}
    groups = sorted((r.segment, -1 if r.part is None else r.part, r["count"]) for r in rows.groupBy("segment", "part").count().collect())
    held = {r: g for r in ranks if (g := _walk(groups, r)) and g[0] % 2}
    if not held:
        return {}
    some = sorted({g[:2] for g in held.values()})
    chosen = rows.where(F.array_contains(F.array(*[F.lit(f"{s}:{p}") for s, p in some]), F.concat_ws(":", "segment", "part")))
    leaf: dict[tuple, list] = {}
    for r in chosen.groupBy("segment", "part", _KEY, _ID).count().collect():
        leaf.setdefault((r.segment, r.part), []).append((r[_KEY], r[_ID], r["count"]))
    return {r: _walk(sorted(leaf[g[:2]]), g[2])[:2] for r, g in held.items()}


def _by_prefixes(keyed: DataFrame, ranks: list[int]) -> dict[int, tuple]:
    """Cut keys by histogram refinement, whatever the keys' distribution."""
    out: dict[int, tuple] = {}
    pending = {r: ("", r) for r in sorted(set(ranks)) if r > 0}
    level = 0
    while pending:
        level += 1
        plen = _DIGITS * level
        prefixes = sorted({p for p, _ in pending.values()})
        sub = keyed
        if prefixes != [""]:
            sub = keyed.where(F.substring(_KEY, 1, plen - _DIGITS).isin(prefixes))
        hist = (sub.groupBy(F.substring(_KEY, 1, plen).alias("b"))
                   .agg(F.count(F.lit(1)).alias("n")).collect())
        buckets: dict[str, list] = {}
        for row in hist:
            buckets.setdefault(row["b"][: plen - _DIGITS], []).append((row["b"], row["n"]))
        nxt, leaves = {}, {}
        for rank, (prefix, residual) in pending.items():
            cum = 0
            for b, n in sorted(buckets.get(prefix, [])):
                if cum + n >= residual:
                    if n <= _LEAF or plen >= 32:
                        leaves[rank] = (b, residual - cum)
                    else:
                        nxt[rank] = (b, residual - cum)
                    break
                cum += n
            else:
                raise ValueError(f"rank {rank} exceeds the row count")
        if leaves:
            wanted = sorted({b for b, _ in leaves.values()})
            # distinct pairs with their counts: repeated ids don't enlarge a leaf
            rows = (keyed.where(F.substring(_KEY, 1, plen).isin(wanted))
                         .groupBy(_KEY, _ID).agg(F.count(F.lit(1)).alias("n")).collect())
            by_bucket: dict[str, list] = {}
            for row in rows:
                by_bucket.setdefault(row[_KEY][:plen], []).append((row[_KEY], row[_ID], row["n"]))
            for rank, (b, residual) in leaves.items():
                for key, i, n in sorted(by_bucket[b]):
                    residual -= n
                    if residual <= 0:
                        out[rank] = (key, i)
                        break
        pending = nxt
    return out


def _le(key: Column, idc: Column, cut: tuple | None) -> Column:
    if cut is None:
        return F.lit(False)
    k, i = cut
    return (key < F.lit(k)) | ((key == F.lit(k)) & (idc <= F.lit(i)))


def split_by_counts(df: DataFrame, id_col: str, seed: int | str,
                    counts: list[int], labels: list[str], col: str = "split", n: int | None = None) -> DataFrame:
    """Label the first counts[0] rows of the seeded order labels[0], the next
    counts[1] labels[1], ..., the rest labels[-1]."""
    cum, ranks = 0, []
    for c in counts:
        cum += c
        ranks.append(cum)
    cuts = kth_keys(df, id_col, seed, ranks, n)
    key = hash_key(id_col, seed)
    expr = None
    for r, label in zip(ranks, labels):
        cond = _le(key, F.col(id_col), cuts.get(r))
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    expr = F.lit(labels[-1]) if expr is None else expr.otherwise(labels[-1])
    return df.withColumn(col, expr)


def exact_split(df: DataFrame, id_col: str = "sample_id", seed: int | str = 42,
                train: float = 0.8, val: float = 0.1, col: str = "split") -> DataFrame:
    """Seeded shuffle, first int(n*train) train, next int(n*val) validation,
    rest test.  Exact sizes, no single-partition sort."""
    n = df.count()
    n_train = int(n * train)
    n_val = int(n * val)
    return split_by_counts(df, id_col, seed, [n_train, n_val], list(SPLITS), col, n)


def holdout_split(df: DataFrame, id_col: str, seed: int | str = 42,
                  test_size: float = 0.1, col: str = "split") -> DataFrame:
    """Seeded 90/10 split, ``test = ceil(test_size * n)``."""
    n = df.count()
    n_test = int(math.ceil(test_size * n)) if n else 0
    return split_by_counts(df, id_col, seed, [n - n_test], ["train", "test"], col, n)


def first_k(df: DataFrame, id_col: str, seed: int | str, k: int) -> DataFrame:
    """Exactly min(k, n) rows, uniformly chosen by the seeded order.

    One cut key, whatever k: rows are compared with it where they are.
    """
    if k <= 0:
        return df.limit(0)
    n = df.count()
    if k >= n:
        return df
    cut = kth_keys(df, id_col, seed, [k], n)[k]
    return df.where(_le(hash_key(id_col, seed), F.col(id_col), cut))


def sample_lines(lines: DataFrame, k: int, seed: int | str = 42,
                 id_col: str = "line_id", text_col: str = "text") -> DataFrame:
    """Choose exactly k line ids uniformly *before* blank lines are dropped,
    then drop the blank ones (so fewer than k may remain)."""
    chosen = first_k(lines, id_col, seed, k)
    return chosen.where(py_strip(F.col(text_col)) != "")


def few_shot_random(pool: DataFrame, k: int, seed: int | str = 42,
                    id_col: str = "sample_id") -> DataFrame:
    """min(k, n) uniform samples of the pool."""
    return first_k(pool, id_col, seed, k)


def few_shot_pool(samples: DataFrame) -> DataFrame:
    """Train followed by validation (the order is the ``split`` column)."""
    return samples.where(F.col("split").isin("train", "validation"))
