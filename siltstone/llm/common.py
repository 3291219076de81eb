"""Shared pieces of the training-data operators.

Conventions that hold for every operator of this subpackage:

* A row whose ``doc_id`` (or ``vec_id``) is null names no document; it is left out.
* A null text counts as the empty text.
* Repeated rows are rows: each one gets its own result row, unless an operator says otherwise.
* Only the columns an operator asks for are read; other columns may have any name and type.
"""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: they bound what a Python worker holds of a partition.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20
#: Bits of a KeyFilter, and bytes of the blocks in which tasks send their part of it.
FILTER_BITS, FILTER_BLOCK = 1 << 26, 1 << 16


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@functools.cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="siltstone-")


def workspace(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder. A session on this machine alone may do without that
    setting; on a cluster its absence is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or _local_folder()).rstrip('/')}/siltstone-{uuid.uuid4().hex}"


def materialize(df: DataFrame, folder: str) -> DataFrame:
    """Writes df as Parquet and reads it again: cuts the lineage in a way that outlives executors."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(spark: SparkSession, *folders: str) -> None:
    """Deletes tables that were written and have been used up, by way of the folder's own file system."""
    for f in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes % np.uint64(bits)).astype(np.int64)


def _bits_at(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def two_hashes(keys: np.ndarray) -> np.ndarray:
    """Two hashes of each 64-bit key, as a 2 x n array."""
    a = mix64(keys.astype(np.int64, copy=False).view(np.uint64) if keys.dtype != np.uint64 else keys)
    return np.stack([a, mix64(a + np.uint64(0x9E3779B97F4A7C15))])


class BloomFilter:
    """A Bloom filter of fixed size: what is broadcast does not grow with the keys. A full one lets every key through,
    so whatever it prunes must be settled exactly afterwards."""

    def __init__(self, bitmap: np.ndarray):
        self.bitmap = bitmap

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """For 2 x n hashes."""
        return _bits_at(self.bitmap, _positions(hashes[0], len(self.bitmap) * 8)) & _bits_at(self.bitmap, _positions(hashes[1], len(self.bitmap) * 8))


def bloom_filters(rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], bits: int = FILTER_BITS, twice: bool = False) -> BloomFilter:
    """A filter of the keys of rows, or with twice of those that occur twice; hashes_of gives a batch's 2 x n hashes.

    Each task fills bitmaps of its own for keys seen once and twice. They merge block by block with
    (a1|b1, a2|b2|(a1&b1)), which is associative: a key of two tasks always reaches the twice-seen map.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in batches:
            for at in _positions(hashes_of(b), bits):
                if twice:
                    at, n = np.unique(at, return_counts=True)
                    met = _bits_at(once, at) | (n > 1)
                    np.bitwise_or.at(again, at[met] >> 3, (1 << (at[met] & 7)).astype(np.uint8))
                np.bitwise_or.at(once, at >> 3, (1 << (at & 7)).astype(np.uint8))
        blocks = [[zlib.compress(x[k : k + FILTER_BLOCK].tobytes(), 1) for x in (once, again)] + [k] for k in range(0, len(once), FILTER_BLOCK) if once[k : k + FILTER_BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in blocks], t) for i, t in ((2, pa.int64()), (0, pa.binary()), (1, pa.binary()))], names=["start", "once", "again"])

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(min(FILTER_BLOCK, bits // 8), np.uint8), np.zeros(min(FILTER_BLOCK, bits // 8), np.uint8)
        for t in batches:
            for x, y in zip(t.column("once"), t.column("again")):
                x, y = (np.frombuffer(zlib.decompress(v.as_py()), np.uint8) for v in (x, y))
                again |= y | (once & x)
                once |= x
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([(again if twice else once).tobytes()], pa.binary())], names=["start", "bits"])

    whole = np.zeros(bits // 8, np.uint8)
    for r in rows.mapInArrow(fill, "start long, once binary, again binary").groupBy("start").applyInArrow(merged, "start long, bits binary").toLocalIterator():
        whole[r.start : r.start + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return BloomFilter(whole)


def split_by_ids(docs: DataFrame, ids: DataFrame, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """docs in two parts: rows whose doc_id may be in ids (one column), and rows whose doc_id is surely not, null ones
    among them. Each row asks a filter of fixed size where it is read, so that only rows of the first part, which hold a few
    others by chance, need to meet ids in a join; a filter that is full sends all rows there."""
    spark = docs.sparkSession
    some = spark.sparkContext.broadcast(bloom_filters(ids.toDF("id").where("id IS NOT NULL").select(F.col("id").cast("long")), lambda b: two_hashes(b.column(0).to_numpy()), bits))

    @F.pandas_udf("boolean")
    def listed(doc_id: pd.Series) -> pd.Series:
        return pd.Series(some.value.has(two_hashes(doc_id.to_numpy(np.int64))))

    hit = listed(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    return docs.where(F.col("doc_id").isNotNull() & hit), docs.where(F.col("doc_id").isNull() | ~hit)


def doc_texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list[int], list[str]], dict]], schema: str) -> DataFrame:
    """Applies make()(doc_ids, texts) -> columns to each batch of (doc_id, text); make runs once in each task."""
    target = docs.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for b in batches:
            if b.num_rows:
                out = each(b.column(0).to_pylist(), b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return doc_texts(docs).mapInArrow(run, target)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    a = np.empty(len(words), dtype=object)
    a[:] = words
    return pd.util.hash_array(a, categorize=False) if len(words) else np.empty(0, np.uint64)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of `width` consecutive word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = h[:n].copy()
    for k in range(1, width):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return mix64(g)
