"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import itertools
import os
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.session import remove, scratch_path

_SERIAL = itertools.count()

# Texts of one slice handled at once inside a task (characters, not rows): the
# working memory of the Python stages is a small multiple of this, plus the
# longest single text.
SLICE_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


_MADE: list[list[str]] = []  # tables of the open scopes


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables written inside, at the end (a result that
    outlives the scope is written with ``keep``)."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            remove(spark, path)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table under the shared checkpoint folder and read it back.

    Cuts lineage: a lost executor re-reads committed files instead of
    re-running what came before."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{os.getpid()}-{next(_SERIAL)}")
    if _MADE and not keep:
        _MADE[-1].append(path)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: str = "text") -> Column:
    """16-byte identity of a text (null counts as empty)."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def row_key(id_col: str = "doc_id", text: str = "text") -> Column:
    """16-byte identity of a document: rows equal in id and text are the same
    document; a null id is an id of its own."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("\u0001"),
                                  F.coalesce(F.col(text).cast("string"), F.lit("")))))


def give_back() -> None:
    """Return memory that a task has freed to the system: a worker lives on, and
    so do the workers next to it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
        if trim is not None:
            trim(0)


def text_slices(batches, text: str = "text", limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut Arrow batches into runs of rows holding at most ``limit`` bytes of
    text (a longer single text is a run of its own); null texts become empty."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()), "")
        size = np.asarray(pc.binary_length(col), dtype=np.int64)
        start = used = 0
        for i, n in enumerate(size):
            if i > start and used + n > limit:
                yield batch.slice(start, i - start), col.slice(start, i - start)
                start, used = i, 0
            used += n
        yield batch.slice(start), col.slice(start)
    give_back()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def binary_parts(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array in a row, and the bounds of its values."""
    a = a.cast(pa.large_string())
    offsets = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1 + a.offset)[a.offset:]
    data = a.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def ragged_take(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[s:s+n]`` for all (s, n)."""
    total = int(lens.sum())
    if total == 0:
        return flat[:0]
    ends = np.cumsum(lens)
    at = np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)
    return flat[at]


def plain_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the columns an operator needs, so that clashing extra columns of the
    input can't reach it."""
    return df.select(*names)


MAP_BITS = 1 << 15            # bits of one of Spark's bitmaps
FILTER_BITS = MAP_BITS << 10  # 4 MB of bitmaps at most


def member_flag(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows with ``_sw_maybe``: whether their key may be among ``keys``, without
    a shuffle of the rows.  A bitmap of ``FILTER_BITS`` bits, whatever the number
    of keys, is broadcast.  It never misses a member; where a false hit would
    matter, an exact join has to follow."""
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    part, place = F.floor(bit / MAP_BITS).cast("int").alias("_sw_part"), (bit % MAP_BITS).cast("long").alias("_sw_place")
    maps = keys.select(part, place).groupBy("_sw_part").agg(F.bitmap_construct_agg("_sw_place").alias("_sw_map"))
    hit = rows.select("*", part, place).join(F.broadcast(maps), "_sw_part", "left")
    octet = F.conv(F.hex(F.substring("_sw_map", (F.col("_sw_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(octet, (F.col("_sw_place") % 8).cast("int")) == 1, F.lit(False))
    return hit.select(*rows.columns, found.alias("_sw_maybe"))


def maybe_member(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be among ``keys`` (see ``member_flag``)."""
    return member_flag(rows, keys, key).where("_sw_maybe").drop("_sw_maybe")
