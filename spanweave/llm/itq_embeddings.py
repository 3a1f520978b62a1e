"""Near-duplicate vectors through iterative quantisation (operator 7).

1. Exact copies (same label, same components) become one class.
2. Iterative quantisation learns rotations of the centred vectors on a bounded
   sample (the ``SAMPLE`` smallest content hashes), so that the signs of the
   rotated components are balanced binary codes; every class is encoded.
3. Multi-index Hamming tables: the code is cut into blocks, and two classes of
   one label meet in every table where a block agrees.  A block is as long as
   the label is large (about ``MEMBERS`` classes share its value by chance), and
   there are as many tables as a pair at the threshold needs to meet in one of
   them but for ``MISSED`` of the pairs.  Longer blocks need more tables, but the
   pairs that are compared grow little faster than the vectors (as the power
   1.2, not 2).
4. A table entry with many members is cut into chunks by content hash; each
   pair of chunks is a tile of bounded size, so no task holds a whole hot
   entry.  A tile reranks with the original vectors (cosine in double
   precision), counts links, and passes on one link per member (its tile's
   components) instead of all pairs.  A pair counts only in the first table
   where its blocks agree.
5. Components by alternating stars.

Defined results: vectors that are null, zero or hold null or non-finite
components, and vectors without a label, link with nothing (0 links, their own
component).  Vectors of different lengths never link.  Repeated rows are copies
of one vector and link with each other.  A null ``vec_id`` counts as the
largest; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.common import column, stored, table
from spanweave.llm.components import components

COSINE = 0.93
SAMPLE = 10_000
ITERATIONS = 50
BITS = 64        # of one rotation
MEMBERS = 16     # classes that share a block's value by chance, about
SHORTEST = 8     # bits of a block
MISSED = 0.015   # pairs at the threshold that no table brings together
TILE = 1500  # members of a chunk of a table entry


def tables(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """Bits of a block and number of blocks for a label of ``n`` classes."""
    width = min(max(SHORTEST, math.ceil(math.log2(max(n, 1) / MEMBERS))), 32)
    meet = (1 - math.acos(min(max(cosine, -1.0), 1.0)) / math.pi) ** width
    return width, max(1, math.ceil(math.log(MISSED) / math.log(1 - meet))) if meet < 1 else 1


def fit_rotation(x: np.ndarray, bits: int = BITS, iterations: int = ITERATIONS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimension x bits) of iterative quantisation."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    mean = x.mean(0)
    rng = np.random.default_rng(seed)
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    axes = axes[:, ::-1][:, :bits]
    if axes.shape[1] < bits:  # short vectors: further random directions
        extra = rng.normal(size=(x.shape[1], bits - axes.shape[1]))
        axes = np.concatenate([axes, extra / np.linalg.norm(extra, axis=0)], 1)
    v = (x - mean) @ axes
    r = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(iterations):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return mean, axes @ r


def codes(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    mean, projection = model
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return (x - mean) @ projection >= 0


class Rotations:
    """As many rotations of a vector length as codes need, fitted on demand."""

    def __init__(self, dim: int, sample: np.ndarray | None):
        self.dim, self.sample, self.fitted = dim, sample, []

    def blocks(self, x: np.ndarray, width: int, count: int) -> np.ndarray:
        """Values of the blocks, one row per vector."""
        while len(self.fitted) * BITS < width * count:
            seed = 7 + len(self.fitted)
            if self.sample is None:  # a length the sample hasn't seen
                self.fitted.append((np.zeros(self.dim), np.random.default_rng(seed * 1000 + self.dim).normal(size=(self.dim, BITS))))
            else:
                self.fitted.append(fit_rotation(self.sample, seed=seed))
        need = math.ceil(width * count / BITS)
        bits = np.concatenate([codes(x, m) for m in self.fitted[:need]], 1)[:, :width * count].reshape(len(x), count, width)
        return (bits @ (1 << np.arange(width, dtype=np.int64))).astype(np.uint32)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Content key and double components of linkable vectors; nulls otherwise."""
    for batch in batches:
        keys, vecs, dims = [], [], []
        for label, e in zip(column(batch, "label").to_pylist(), column(batch, "embedding").to_pylist()):
            key = vec = dim = None
            if label is not None and e and None not in e:
                v = np.array(e, np.float64) + 0.0
                if np.isfinite(v).all() and v.any():
                    key = hashlib.md5(f"{label}:".encode() + v.tobytes()).digest()
                    v = v / np.abs(v).max()  # no square leaves the range of doubles
                    vec, dim = (v / np.abs(v).max()).tobytes(), len(e)
            keys.append(key)
            vecs.append(vec)
            dims.append(dim)
        yield pa.RecordBatch.from_arrays(
            [column(batch, "vec_id").cast(pa.int64()), column(batch, "label").cast(pa.string()), pa.array(keys, pa.binary()),
             pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], ["vec_id", "label", "key", "dim", "vec"])


def _matrix(vecs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), np.float64).reshape(-1, dim)


def link_tile(key: list, x: np.ndarray, code: np.ndarray, n: np.ndarray, chunk: np.ndarray, a: int, b: int,
              block: int, cosine: float) -> list[tuple[bytes, bytes, int]]:
    """(key, root of its component in the tile, linked vectors) of the members
    with a link that first agrees in this block."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= cosine
    if a != b:
        close &= chunk[:, None] != chunk[None, :]
    np.fill_diagonal(close, False)
    for earlier in range(block):
        close &= code[:, earlier][:, None] != code[:, earlier][None, :]
    some = np.flatnonzero(close.any(1))
    if not len(some):
        return []
    close, keys = close[np.ix_(some, some)], [key[i] for i in some.tolist()]
    root = np.arange(len(some))
    while True:
        low = np.minimum(root, np.where(close, root[None, :], len(some)).min(1))
        if (low == root).all():
            break
        root = low
    links = close @ n[some]
    return [(keys[i], keys[r], c) for i, (r, c) in enumerate(zip(root.tolist(), links.tolist()))]


def _tiles(cosine: float):
    names = ("label", "dim", "block", "value", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def links(t: pa.Table) -> list:
            head = {k: t.column(k)[0].as_py() for k in ("dim", "block", "a", "b")}
            x = _matrix(t.column("vec").to_pylist(), head["dim"])
            code = np.frombuffer(b"".join(t.column("code").to_pylist()), "<u4").reshape(len(x), -1)
            return link_tile(t.column("key").to_pylist(), x, code, np.asarray(t.column("n")), np.asarray(t.column("chunk")),
                             head["a"], head["b"], head["block"], cosine)

        def done(t: pa.Table, final: bool):
            """Complete tiles of a table sorted by tile, and what may go on."""
            cols = [t.column(k).combine_chunks() for k in names]
            same = np.ones(max(len(t) - 1, 0), bool)
            for c in cols:
                v = c.to_numpy(zero_copy_only=False)
                same &= v[1:] == v[:-1]
            cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(t)]
            last = len(cuts) - 1 if final else len(cuts) - 2
            out = []
            for i, j in zip(cuts[:last], cuts[1:last + 1]):
                if j - i > 1:
                    out += links(t.slice(i, j - i))
            return out, None if final else t.slice(cuts[last])

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()),
                                               pa.array([r[2] for r in rows], pa.int64())], ["key", "root", "links"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            if len(t):
                out, rest = done(t, False)
                if out:
                    yield batch_of(out)
        if rest is not None and len(rest):
            out, _ = done(rest, True)
            if out:
                yield batch_of(out)

    return run


def encoded_classes(usable: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """Classes of equal vectors with their code (block values, unsigned 32-bit):
    ``key, label, dim, vec, n, least_id, code, blocks``; written once."""
    by_dim: dict[int, list] = {}
    for r in usable.select("key", "dim", "vec").orderBy("key").limit(sample).collect():  # at most ``sample`` rows
        by_dim.setdefault(r.dim, []).append(r.vec)
    samples = {dim: _matrix(rows, dim) for dim, rows in by_dim.items()}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations: dict[int, Rotations] = {}
        for batch in batches:
            out: list = [None] * batch.num_rows
            dims, size, vec = np.asarray(column(batch, "dim")), np.asarray(column(batch, "size")), column(batch, "vec").to_pylist()
            shapes = [tables(int(n), cosine) for n in size]
            for dim, shape in set(zip(dims.tolist(), shapes)):
                at = [i for i in range(len(shapes)) if dims[i] == dim and shapes[i] == shape]
                rotation = rotations.setdefault(dim, Rotations(dim, samples.get(dim)))
                for i, values in zip(at, rotation.blocks(_matrix([vec[i] for i in at], dim), *shape)):
                    out[i] = values
            kept = [c for c in batch.schema.names if c != "size"]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in kept), pa.array([v.astype("<u4").tobytes() for v in out], pa.binary()),
                                              pa.array([v.tolist() for v in out], pa.list_(pa.int64()))], [*kept, "code", "blocks"])

    classes = usable.groupBy("key").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"),
                                        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least_id"))
    classes = stored(classes, "vector-keys")
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size"))
    rows = classes.join(sizes, ["label", "dim"]).select("key", "label", "dim", "vec", "n", "least_id", "size")
    return stored(rows.mapInArrow(encode, "key binary, label string, dim int, vec binary, n long, least_id long, code binary, blocks array<long>"),
                  "vector-classes")


def table_members(classes: DataFrame, tile: int = TILE) -> tuple[DataFrame, list[str]]:
    """Classes in the table entries that have others too, with the entry's
    ``members`` and ``chunks``; and the entry's columns."""
    blocks = F.posexplode("blocks").alias("block", "value")
    bucket = ["label", "dim", "block", "value"]
    sizes = classes.select("label", "dim", blocks).groupBy(*bucket).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = classes.select("key", "label", "dim", "vec", "n", "code", blocks)
    return members.join(sizes.select(*bucket, "members", F.ceil(F.col("members") / tile).cast("int").alias("chunks")), bucket), bucket


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, tile: int = TILE) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    vecs = stored(vectors.select("vec_id", "label", "embedding")
                  .mapInArrow(_read, "vec_id long, label string, key binary, dim int, vec binary"), "vectors")
    usable = vecs.where(F.col("key").isNotNull())
    classes = encoded_classes(usable, cosine, sample)
    members, bucket = table_members(classes, tile)
    members = members.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    spread = members.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    spread = spread.select(*bucket, F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"),
                           "chunk", "key", "n", "code", "vec")
    tiles = [*bucket, "a", "b"]
    linked = spread.repartition(*tiles).sortWithinPartitions(*tiles).mapInArrow(_tiles(cosine), "key binary, root binary, links long")
    linked = stored(linked, "vector-links")

    found = components(linked.select(F.col("key").alias("a"), F.col("root").alias("b")), "vector-components")
    counts = linked.groupBy("key").agg(F.sum("links").alias("links"))
    whole = (classes.select("key", "n", "least_id").join(found.withColumnRenamed("node", "key"), "key", "left")
             .join(counts, "key", "left")
             .select("key", "n", "least_id", F.coalesce("root", "key").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    names = whole.groupBy("root").agg(F.min("least_id").alias("component"))
    whole = whole.join(names, "root").select("key", (F.col("links") + F.col("n") - 1).alias("links"), "component")
    out = vecs.select("vec_id", "key").join(whole, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op7_itq_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_itq_embeddings": op7_itq_embeddings}
