"""Line deduplication with two Bloom filters (operator 3).

Pass 1 puts the 64-bit hash of every long line key of every document into a pair of bitmaps: seen once, seen twice.
Each task fills its own pair; pairs merge block by block with (a1|b1, a2|b2|(a1&b1)), which is associative, so a
key in two documents always reaches the twice-seen map. Pass 2 shuffles only keys that the twice-seen map suspects,
as (128-bit key digest, doc_id), and counts their documents exactly. Pass 3 rewrites the documents that lose lines; the
texts of all others stay where they are read.

The bitmaps have a fixed size (FILTER_BITS): that bounds what is broadcast. When they fill up, more unique lines are
suspected and shuffled, as 24 bytes each, and nothing else changes.

Cases: a null or empty text is one empty line; several equal lines of a document count it once, and all of them go or
stay together; rows that repeat a doc_id are one document for the count and each is rewritten; a very long text or line
is one value in one task, whole; of equal keys the largest doc_id decides, so there are no ties; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BloomFilter, bloom_filters, doc_texts, map_texts, materialize, split_by_ids, workspace

STRIP = " \t\n\r\x0b\x0c"
MIN_POINTS, MIN_DOCS = 40, 5
FILTER_BITS = 1 << 27
_ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def long_keys(lines: list[str], min_points: int) -> dict[str, bytes]:
    """line -> 16-byte digest of its key, for the lines whose key is long enough."""
    out = {}
    for line in lines:
        if len(line) >= min_points and line not in out:
            key = line.strip(STRIP)
            if len(key) >= min_points:
                out[line] = hashlib.blake2b(key.encode("utf-8", "surrogatepass").translate(_ASCII_LOWER), digest_size=16).digest()
    return out


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2).T


def seen_twice(docs: DataFrame, min_points: int, bits: int) -> BloomFilter:
    """The twice-seen filter of the documents' long line keys."""

    def hashes_of(batch: pa.RecordBatch) -> np.ndarray:
        return _hashes([k for text in batch.column(1).to_pylist() for k in set(long_keys(text.split("\n"), min_points).values())])

    return bloom_filters(doc_texts(docs), hashes_of, bits, twice=True)


def repeated_lines(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, key): the line keys, as digests, that a document loses. Hot keys meet their counts in a join that Spark can split."""
    spark = docs.sparkSession
    folder = workspace(spark)
    twice = spark.sparkContext.broadcast(seen_twice(docs, min_points, bits))

    def make():
        def each(ids, texts):
            out_ids, out_keys = [], []
            for i, text in zip(ids, texts):
                keys = list(dict.fromkeys(long_keys(text.split("\n"), min_points).values()))
                hit = twice.value.has(_hashes(keys))
                found = [k for k, h in zip(keys, hit) if h]
                out_ids += [i] * len(found)
                out_keys += found
            return {"doc_id": out_ids, "key": out_keys}

        return each

    suspected = materialize(map_texts(docs, make, "doc_id long, key binary"), folder + "/suspects")
    counted = suspected.distinct().groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    counted = materialize(counted.select("key", "keeper"), folder + "/common")
    return suspected.join(counted, "key").where(F.col("doc_id") < F.col("keeper")).select("doc_id", "key")


def with_lost(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """docs with lost, the array of line keys that a row loses (null: none). Only texts that may lose lines are shuffled."""
    lost = materialize(lost, workspace(docs.sparkSession) + "/lost")
    touched, others = split_by_ids(docs, lost.select("doc_id"))
    per_doc = lost.groupBy("doc_id").agg(F.collect_set("key").alias("lost"))
    return touched.join(per_doc.hint("merge"), "doc_id", "left").select(*[F.col(f"`{c}`") for c in docs.columns], "lost").unionByName(others.withColumn("lost", F.lit(None).cast("array<binary>")))


def dedup_lines(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, kept_text, n_lines (before), n_dropped, for every row of docs."""
    texts = doc_texts(docs)
    return with_lost(texts, repeated_lines(docs, min_points, min_docs, bits)).mapInArrow(_rewriter(min_points), "doc_id long, kept_text string, n_lines long, n_dropped long")


def kept_of(lines: list[str], lost, min_points: int) -> list[str]:
    gone, digests = set(lost), long_keys(lines, min_points)
    return [x for x in lines if digests.get(x) not in gone]


def kept_lines(text: str, lost, min_points: int = MIN_POINTS) -> str:
    """The text without the lines whose key digest is in lost."""
    return "\n".join(kept_of(text.split("\n"), lost, min_points))


def _rewriter(min_points: int):
    def run(batches):
        for b in batches:
            ids, kept_texts, before, dropped = b.column(0).to_pylist(), [], [], []
            for text, lost in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                lines = text.split("\n")
                before.append(len(lines))
                if lost:
                    kept = kept_of(lines, lost, min_points)
                    dropped.append(len(lines) - len(kept))
                    kept_texts.append("\n".join(kept))
                else:
                    dropped.append(0)
                    kept_texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kept_texts, pa.string()), pa.array(before, pa.int64()), pa.array(dropped, pa.int64())], names=["doc_id", "kept_text", "n_lines", "n_dropped"])

    return run
