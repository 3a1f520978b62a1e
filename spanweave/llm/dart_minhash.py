"""Near-duplicate documents by DartMinHash (operator 3).

1. A document is the weighted set of its five-word shingles (weight: how often
   it holds the shingle).  Documents with the same words are one class.
2. Darts are thrown into the region of every weighted element: a Poisson
   process of unit rate per unit of weight along the rank axis, reproducible
   from the element alone.  A dart has a coordinate and a rank; the earliest
   dart of each coordinate is the signature.  Only ranks up to
   ``(K ln K + 2 K) / total weight`` are looked at, twice as far where a
   coordinate is still empty, so the work is a few darts per coordinate and one
   hash per element, however heavy the document.
3. ``BANDS`` bands of ``ROWS`` coordinates meet in a join.  Every class of a band
   entry is compared with the entry's hub; a large entry is split further by the
   following bands, with a hub in each part.  What those links leave in different
   components is then looked at exactly: all pairs of small entries, and the
   classes of a large entry outside its main component with all of the entry
   that they can still be similar to, given the weight that each holds alone;
   nothing is capped.
4. Pairs are verified exactly: weighted Jaccard similarity of at least
   ``SIMILARITY``; then components by alternating stars.

With 24 bands of 5 rows a pair of similarity 0.8 is missed with probability
7e-5, one of 0.85 with 2e-6.

Defined results: a text with one to four words is one shingle of all its words;
texts without words (null, empty) link with nothing and stay; rows equal in id
and text are one document and share their result; of a component the document
with the smallest id stays (null ids last, then by content); an empty table
stays empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.common import column, maybe_member, row_key, stored, table, text_slices
from spanweave.llm.components import components
from spanweave.llm.wording import mix, unit, weighted_cells, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
SMALL = 40   # band entries up to this size yield all their pairs that aren't linked yet
HUBS = 1
SLICE = 1_000_000  # bytes of text hashed at once in a task; bounds the workers' memory

_DART, _PLACE = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def dart_signatures(cells: np.ndarray, offsets: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """``(documents, k)`` identities of the earliest darts.  ``cells`` are unit
    regions of weight; a document without cells gets zeros."""
    n = len(offsets) - 1
    weight = np.diff(offsets)
    out = np.zeros((n, k), np.uint64)
    todo = np.flatnonzero(weight)
    reach = (k * math.log(k) + 2 * k) / np.maximum(weight, 1)
    while len(todo):
        size = weight[todo]
        row = np.repeat(np.arange(len(todo)), size)
        at = np.arange(len(row)) + np.repeat(offsets[todo] - (np.cumsum(size) - size), size)
        cell, limit = cells[at], reach[todo][row]
        rank = np.zeros(len(cell))
        slots, ranks, darts = [], [], []
        m = 0
        while len(cell):
            m += 1
            dart = mix(cell + np.uint64(m) * _DART)
            rank = rank - np.log(unit(dart))
            alive = rank <= limit
            cell, rank, limit, row, dart = cell[alive], rank[alive], limit[alive], row[alive], dart[alive]
            place = (mix(dart ^ _PLACE) % np.uint64(k)).astype(np.int64)
            slots.append(row * k + place)
            ranks.append(rank)
            darts.append(dart)
        slot, ranked, dart = np.concatenate(slots), np.concatenate(ranks), np.concatenate(darts)
        first = np.full(len(todo) * k, np.inf)
        np.minimum.at(first, slot, ranked)
        best = ranked == first[slot]
        ids = np.zeros(len(todo) * k, np.uint64)
        np.maximum.at(ids, slot[best], dart[best])
        full = np.isfinite(first).reshape(-1, k).all(1)
        out[todo[full]] = ids.reshape(-1, k)[full]
        todo = todo[~full]
        reach[todo] *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    s = signatures.reshape(len(signatures), bands, rows)
    key = np.zeros((len(signatures), bands), np.uint64)
    for j in range(rows):
        key = mix(key * np.uint64(31) + s[:, :, j])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_slices(batches, limit=SLICE):
        strings = texts.to_pylist()
        w, at = words(strings)
        cells, offsets = weighted_cells(strings, SHINGLE)
        keys = band_keys(dart_signatures(cells, offsets))
        klass = [hashlib.md5(w[a:b].tobytes()).digest() if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [column(batch, "k").cast(pa.binary()), column(batch, "doc_id").cast(pa.int64()), pa.array(klass, pa.binary()),
             pa.array(np.diff(offsets), pa.int64()),
             pa.ListArray.from_arrays(pa.array(np.arange(len(strings) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))],
            ["k", "doc_id", "ck", "n", "bands"])


def signatures(docs: DataFrame) -> DataFrame:
    """``k`` (row key), ``doc_id``, ``ck`` (class of equal words; null without
    words), ``n`` (total weight), ``bands``; written once."""
    out = docs.select(row_key().alias("k"), "doc_id", "text").mapInArrow(_sign, "k binary, doc_id long, ck binary, n long, bands array<long>")
    return stored(out, "dart-signatures")


def _all_pairs(members: DataFrame, key: list[str], found: DataFrame) -> DataFrame:
    """All pairs of entries of at most ``SMALL`` classes that lie in different
    components (``found``: node, root)."""
    rows = members.join(found.withColumnRenamed("node", "ck"), "ck", "left").select(*key, "ck", "n", F.coalesce("root", "ck").alias("root"))
    lists = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("ck", "n", "root"))).alias("l"), F.min("root").alias("low"), F.max("root").alias("high"))
    pairs = F.expr("filter(flatten(transform(sequence(1, size(l) - 1), i -> transform(slice(l, i + 1, size(l)), "
                   "y -> struct(l[i - 1] AS x, y AS y)))), p -> p.x.root <> p.y.root)")
    return lists.where("low <> high").select(F.explode(pairs).alias("p")).select(
        F.col("p.x.ck").alias("a"), F.col("p.y.ck").alias("b"), F.col("p.x.n").alias("na"), F.col("p.y.n").alias("nb"))


def _hub_pairs(members: DataFrame) -> DataFrame:
    """Every class with the hubs of its entry."""
    hubs = members.select("ck", "n", F.explode("hubs").alias("h"))
    return hubs.select(F.col("ck").alias("a"), F.col("h.ck").alias("b"), F.col("n").alias("na"), F.col("h.n").alias("nb")).where("a <> b")


def _entries(members: DataFrame, key: list[str]) -> DataFrame:
    """Entry sizes and hubs, from map-side partial aggregates."""
    hub = [F.min(F.struct(F.xxhash64(F.lit(i), "ck").alias("o"), "ck", "n")) for i in range(HUBS)]
    sizes = members.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.array(*hub).alias("hubs")).where("size > 1")
    return members.drop("size", "hubs").join(sizes, key)


def candidate_entries(classes: DataFrame) -> list[tuple[DataFrame, list[str]]]:
    """Members of the entries with several classes, and the entries' columns: by
    one band, and for large entries by two and three bands that follow each other."""
    bands = F.array(*[F.struct(F.lit(i).alias("band"), *[F.col("bands")[(i + j) % BANDS].alias(f"v{j}") for j in range(3)])
                      for i in range(BANDS)])
    members = classes.select("ck", "n", F.inline(bands))
    out, key = [], ["band", "v0"]
    for depth in range(3):
        out.append((stored(_entries(members, key), "dart-entries"), key))
        members, key = out[-1][0].where(F.col("size") > SMALL), [*key, f"v{depth + 1}"]
    return out


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs whose total weights allow the similarity."""
    possible = F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb")
    return pairs.where(possible).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = column(batch, "a").to_pylist(), column(batch, "b").to_pylist()
        ta, tb = column(batch, "text_a"), column(batch, "text_b")
        start = 0
        while start < len(a):
            texts: dict[bytes, str] = {}
            used, stop = 0, start
            while stop < len(a) and (stop == start or used < SLICE):
                for key, column_ in ((a[stop], ta), (b[stop], tb)):
                    if key not in texts:
                        texts[key] = column_[stop].as_py()
                        used += len(texts[key])
                stop += 1
            cells, offsets = weighted_cells(list(texts.values()), SHINGLE)
            place = {key: i for i, key in enumerate(texts)}
            parts = [np.sort(cells[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            keep = []
            for i in range(start, stop):
                x, y = parts[place[a[i]]], parts[place[b[i]]]
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if common >= SIMILARITY * (len(x) + len(y) - common):
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.binary()), pa.array([b[i] for i in keep], pa.binary())], ["a", "b"])
            start = stop


def class_texts(wanted: DataFrame, docs: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """``ck, text``: the whole text of one document of each wanted class."""
    reps = stored(classes.select("ck", F.col("rep.k").alias("k")).join(wanted, "ck"), f"{name}-wanted")
    rows = docs.select(row_key().alias("k"), F.col("text").cast("string").alias("text"))
    return stored(maybe_member(rows, reps, "k").join(reps, "k").select("ck", "text"), f"{name}-texts")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """Pairs that reach the similarity."""
    pairs = stored(pairs, f"{name}-pairs")
    texts = class_texts(pairs.select(F.col("a").alias("ck")).union(pairs.select("b")).distinct(), docs, classes, name)
    both = (pairs.join(texts.select(F.col("ck").alias("a"), F.col("text").alias("text_a")), "a")
                 .join(texts.select(F.col("ck").alias("b"), F.col("text").alias("text_b")), "b"))
    return stored(both.select("a", "b", "text_a", "text_b").mapInArrow(_similar, "a binary, b binary").distinct(), f"{name}-links")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct cells of a slice's classes, how many hold each, and one of those:
    what near copies share goes on once a slice."""
    for batch, texts in text_slices(batches, limit=SLICE):
        cells, offsets = weighted_cells(texts.to_pylist(), SHINGLE)
        cell, first, count = np.unique(cells, return_index=True, return_counts=True)
        owner = np.searchsorted(offsets, first, "right") - 1
        yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(count.astype(np.int64)),
                                          column(batch, "ck").cast(pa.binary()).take(pa.array(owner))], ["cell", "c", "ck"])


def _alone(texts: DataFrame) -> DataFrame:
    """``ck, u``: weight that no other of these classes shares."""
    cells = texts.mapInArrow(_cells, "cell long, c long, ck binary")
    once = cells.groupBy("cell").agg(F.sum("c").alias("c"), F.min("ck").alias("ck")).where("c = 1")
    return once.groupBy("ck").agg(F.count(F.lit(1)).alias("u"))


def _outside_main(large: DataFrame, found: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes of large entries outside the entry's main component, with the
    classes of the entry in other components, as far as the similarity is still
    possible: two classes share at most what neither holds alone."""
    u = _alone(class_texts(large.select("ck").distinct(), docs, classes, "dart-large"))
    m = large.join(found.withColumnRenamed("node", "ck"), "ck", "left").join(u, "ck", "left")
    m = m.select("band", "v0", "ck", "n", F.coalesce("root", "ck").alias("root"), F.coalesce("u", F.lit(0)).alias("u"))
    m = stored(m, "dart-large")
    main = m.groupBy("band", "v0", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("band", "v0") \
        .agg(F.max(F.struct("c", "root")).alias("main"))
    # a partner has at least n - u in weight, so the similarity is at most (n - u) / n
    able = m.where(F.col("n") - F.col("u") >= SIMILARITY * F.col("n"))
    rest = able.join(main, ["band", "v0"]).where(F.col("root") != F.col("main.root"))
    side = lambda df, x: df.select("band", "v0", *[F.col(c).alias(f"{c}{x}") for c in ("ck", "n", "root", "u")])
    shared = F.least(F.col("na") - F.col("ua"), F.col("nb") - F.col("ub"))
    possible = (F.col("roota") != F.col("rootb")) & (shared >= SIMILARITY * (F.col("na") + F.col("nb") - shared))
    a, b = side(rest, "a"), side(able, "b").withColumnsRenamed({"band": "band_b", "v0": "v0_b"})
    pairs = a.join(b, (F.col("band") == F.col("band_b")) & (F.col("v0") == F.col("v0_b")) & possible)
    return pairs.select(F.col("cka").alias("a"), F.col("ckb").alias("b"), "na", "nb")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``_k`` (row key), ``doc_id, component_id, kept,
    n_shingles, copies`` (rows equal in id and text)."""
    signed = signatures(docs)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("k"))
    classes = signed.where(F.col("ck").isNotNull()).groupBy("ck").agg(F.min(order).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes, "dart-classes")
    entries = candidate_entries(classes)
    links = verified(_ordered(reduce(DataFrame.union, [_hub_pairs(e) for e, _ in entries])), docs, classes, "dart-first")
    found = components(links, "dart-components")
    small = [_all_pairs(e.where((F.col("size") > 2) & (F.col("size") <= SMALL)), key, found) for e, key in entries]
    links = links.union(verified(_ordered(reduce(DataFrame.union, small)), docs, classes, "dart-small"))
    large = entries[0][0].where(F.col("size") > SMALL).select("band", "v0", "ck", "n")
    if not large.isEmpty():
        outside = _outside_main(large, components(links, "dart-components"), docs, classes)
        links = links.union(verified(_ordered(outside), docs, classes, "dart-rest"))
    found = components(links, "dart-components")
    whole = classes.select("ck", "rep").join(found.withColumnRenamed("node", "ck"), "ck", "left") \
        .select("ck", "rep", F.coalesce("root", "ck").alias("root"))
    winners = whole.groupBy("root").agg(F.min("rep").alias("winner"))
    whole = whole.join(winners, "root").select("ck", "winner")
    rows = signed.select("k", "doc_id", "ck", "n").groupBy("k").agg(F.first("doc_id").alias("doc_id"), F.first("ck").alias("ck"), F.first("n").alias("n"),
                                                                    F.count(F.lit(1)).alias("copies"))
    out = rows.join(whole, "ck", "left")
    return out.select(F.col("k").alias("_k"), "doc_id", F.when(F.col("ck").isNull(), F.col("doc_id")).otherwise(F.col("winner.doc_id")).alias("component_id"),
                      F.coalesce(F.col("k") == F.col("winner.k"), F.lit(True)).alias("kept"), F.col("n").alias("n_shingles"), "copies")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, with the input's columns."""
    result = near_duplicates(docs).where("kept").select(F.col("_k").alias("_sw_k"), F.col("copies").alias("_sw_copies"))
    result = stored(result, "dart-kept")
    rows = docs.withColumn("_sw_k", row_key()).join(result, "_sw_k")
    if not result.where("_sw_copies > 1").limit(1).count():
        return rows.select(*docs.columns)
    once = rows.where("_sw_copies = 1").select(*docs.columns)
    return once.union(rows.where("_sw_copies > 1").dropDuplicates(["_sw_k"]).select(*docs.columns))


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    # one row per input row: rows equal in id and text share their result
    return out.select("doc_id", "component_id", "kept", "n_shingles", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))


QUERIES = {"op3_dart_minhash": op3_dart_minhash}
