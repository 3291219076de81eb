"""Phrase collocation mining by SON partitioning (operator 13).

Every document belongs to one of SHARDS shards by a hash of its doc_id. If a phrase occurs `support` times in all, then in
some shard it occurs at least support times the shard's share of the language's words, rounded up: the shard's local
support. So:

1. Word counts of each language and shard give the local supports; words below the support can't be in a candidate.
2. Each shard is mined completely: tasks send the phrases of their part of it, counted and as 56-bit hashes in sorted runs,
   to buckets of the hash range. A bucket adds up each shard's counts, keeps what reaches the local support, unites the
   shards' lists, and counts the union over all shards. Hashes only let too much through, never too little.
3. What is left goes into a Bloom filter; tasks read the texts again and count the phrases that it knows as strings, each
   told apart by its words. These counts, summed, are exact, and the support is applied to them.

No task holds a shard, a language or a phrase's occurrences: the buckets' number follows the corpus, a frequent phrase is one
number of each run, and the best of a language are found in two turns. The filter has at least 16 bits a phrase, and at most
FILTER_MOST in all; past some 10^8 phrases it fills up, and more phrases are counted as strings than need be.

The driver holds one number for each language and shard, so languages should be labels, not free text.

Cases: a null or empty text has no words; a null lang is `und`, the same as the label `und`; rows that repeat a doc_id or
are equal count as often as they stand there; ties are ordered by count and then phrase; a very long text is one value in
one task, whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bloom_filters, discard, materialize, mix64, small_batches, two_hashes, word_hashes, workspace
from .ngram_join import pack_run, unpack_run

SUPPORT, LONGEST, BEST = 10, 3, 2_000
#: Percent of a phrase's occurrences that lie in a longer one, from which on the longer one stands for it.
CONTAINED = 50
SHARDS = 4
#: Words that a task gathers before it counts; words of the corpus for each bucket, and buckets at most.
CHUNK_WORDS, BUCKET_WORDS, BUCKETS = 1_500_000, 2_000_000, 1 << 17
HASH_BITS = 56
FILTER_LEAST, FILTER_MOST = 1 << 20, 1 << 30
#: Parts into which each language's candidates are dealt before the best are chosen.
DEALT = 64

_CUTS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b"\n" * 10 + b" ")
#: Stands between pieces; no UTF-8 text holds this byte.
BREAK = b"\xff"


class Chunk:
    """Words of some documents as numbers, by cell (language and shard); 0 stands between pieces."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.numbers[BREAK]
        self.cells: dict[tuple, list[np.ndarray]] = defaultdict(list)
        self.size = 0

    def add(self, cell: tuple, text: str) -> None:
        words = (text.encode("utf-8", "surrogatepass").lower().translate(_CUTS) + b"\n").replace(b"\n", b" \xff ").split()
        self.cells[cell].append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def runs(self) -> Iterator[tuple[tuple, np.ndarray]]:
        for cell, parts in self.cells.items():
            yield cell, np.concatenate(parts)


def grams(ids: np.ndarray, width: int, usable: np.ndarray | None = None) -> np.ndarray:
    """Starts of all runs of width words within a piece, of usable words only where these are given."""
    fine = (ids > 0) if usable is None else usable[ids]
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    whole = fine[:n].copy()
    for k in range(1, width):
        whole &= fine[k : k + n]
    return np.flatnonzero(whole)


def lang_hash(lang: str) -> np.ndarray:
    return mix64(word_hashes([lang.encode()]))


def gram_hashes(words: np.ndarray, at: np.ndarray, width: int, lang: str) -> np.ndarray:
    """56-bit hashes of the runs at these starts, other ones for each width and language."""
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[at + k]
    return mix64(h + lang_hash(lang) * np.uint64(width)) >> np.uint64(64 - HASH_BITS)


def chunked(rows: DataFrame, each: Callable[[Chunk], Iterator[pa.RecordBatch]], schema: str, by_shard: bool) -> DataFrame:
    """each over the chunks of rows (lang, shard, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk()
        for b in batches:
            for lang, shard, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                chunk.add((lang, shard if by_shard else 0), text)
                if chunk.size >= CHUNK_WORDS:
                    yield from each(chunk)
                    chunk = Chunk()
        if chunk.size:
            yield from each(chunk)

    return rows.mapInArrow(run, schema)


def count_words(chunk: Chunk) -> Iterator[pa.RecordBatch]:
    """(lang, shard, word, c): words without a shard, and under an empty word the shard's number of words."""
    words = [w.decode("utf-8", "replace") for w in chunk.numbers]
    totals: dict[str, np.ndarray] = {}
    for (lang, shard), ids in chunk.runs():
        n = np.bincount(ids, minlength=len(words))
        n[0] = 0
        totals[lang] = totals.get(lang, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([shard], pa.int32()), pa.array([""]), pa.array([int(n.sum())])], names=["lang", "shard", "word", "c"])
    for lang, n in totals.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(np.full(len(some), -1, np.int32)), pa.array([words[k] for k in some.tolist()]), pa.array(n[some])], names=["lang", "shard", "word", "c"])


def word_keys(words: np.ndarray, lang: str) -> np.ndarray:
    return mix64(words + lang_hash(lang))


RUN = "bucket long, lang string, shard int, hashes binary, counts binary"


def _narrow(counts: np.ndarray) -> bytes:
    kind = "<u1" if counts.max() < 1 << 8 else "<u2" if counts.max() < 1 << 16 else "<u8"
    return kind[2].encode() + counts.astype(kind).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[:1].decode()}", offset=1).astype(np.int64)


def phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a): every phrase of 1 to `longest` words with a >= support, counted exactly; (lang, n): all words."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = workspace(spark)
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(shards)).cast("int").alias("shard"), F.col("text").cast("string").alias("text"),
    )
    counted = chunked(rows, count_words, "lang string, shard int, word string, c long", by_shard=True)
    counted = materialize(counted.groupBy("lang", "shard", "word").agg(F.sum("c").alias("c")).where((F.col("word") == "") | (F.col("c") >= support)), folder + "/words")
    sizes = counted.where("word = ''").select("lang", "shard", "c")
    words = counted.where("word <> ''").select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), F.col("c").alias("a"))
    shares = {(r.lang, r.shard): r.c for r in sizes.collect()}  # one row for each language and shard
    totals: dict[str, int] = defaultdict(int)
    for (lang, _), c in shares.items():
        totals[lang] += c
    local = {cell: max(1, -(-support * c // max(1, totals[cell[0]]))) for cell, c in shares.items()}
    buckets = 1 << min(BUCKETS.bit_length() - 1, max(0, (sum(totals.values()) // BUCKET_WORDS).bit_length()))

    def bits(n: int) -> int:
        return min(FILTER_MOST, max(FILTER_LEAST, 1 << (16 * n).bit_length()))

    def keys_of_words(b: pa.RecordBatch) -> np.ndarray:
        h = word_hashes([w.encode() for w in b.column(1).to_pylist()])
        langs = b.column(0).to_pylist()
        of = {lang: lang_hash(lang)[0] for lang in set(langs)}
        return two_hashes(mix64(h + np.array([of[lang] for lang in langs], np.uint64)))

    frequent = spark.sparkContext.broadcast(bloom_filters(words.select("lang", "phrase"), keys_of_words, bits(words.count())))

    def send(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes(list(chunk.numbers))
        shift = np.uint64(HASH_BITS - (buckets.bit_length() - 1))
        for (lang, shard), ids in chunk.runs():
            usable = frequent.value.has(two_hashes(word_keys(hashes, lang)))
            usable[0] = False
            own = hashes[ids]
            found = np.concatenate([gram_hashes(own, grams(ids, w, usable), w, lang) for w in range(2, longest + 1)])
            if len(found):
                found, n = np.unique(found, return_counts=True)
                bucket = (found >> shift).astype(np.int64)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                parts = list(zip(cuts.tolist(), np.append(cuts[1:], len(found)).tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cuts]), pa.array([lang] * len(cuts)), pa.array(np.full(len(cuts), shard, np.int32)), pa.array([pack_run(found[i:j]) for i, j in parts], pa.binary()), pa.array([_narrow(n[i:j]) for i, j in parts], pa.binary())],
                    names=["bucket", "lang", "shard", "hashes", "counts"],
                )

    def mine(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple, list] = defaultdict(list)
        for b in batches:
            for lang, shard, h, c in zip(*(b.column(k).to_pylist() for k in range(1, 5))):
                cells[lang, shard].append((unpack_run(h), _wide(c)))
        shard_counts: dict[str, list] = defaultdict(list)
        for (lang, shard), runs in cells.items():
            h, c = (np.concatenate(x) for x in zip(*runs))
            by = np.argsort(h, kind="stable")
            h, c = h[by], c[by]
            starts = np.flatnonzero(np.diff(h, prepend=~h[:1]))
            shard_counts[lang].append((h[starts], np.add.reduceat(c, starts), local[lang, shard]))
            runs.clear()
        for lang, mined in shard_counts.items():
            union = np.unique(np.concatenate([h[c >= least] for h, c, least in mined]))
            if not len(union):
                continue
            total = np.zeros(len(union), np.int64)
            for h, c, _ in mined:
                at = np.minimum(np.searchsorted(union, h), len(union) - 1)
                some = union[at] == h
                total[at[some]] += c[some]
            yield pa.RecordBatch.from_arrays([pa.array(union[total >= support].astype(np.int64))], names=["hash"])

    sent = chunked(rows, send, RUN, by_shard=True)
    known = materialize(sent.groupBy("bucket").applyInArrow(mine, "hash long"), folder + "/known")
    kept = spark.sparkContext.broadcast(bloom_filters(known, lambda b: two_hashes(b.column(0).to_numpy()), bits(known.count())))

    def count_known(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        names = list(chunk.numbers)
        hashes, width_bits = word_hashes(names), max(1, (len(names) - 1).bit_length())
        for (lang, _), ids in chunk.runs():
            own = hashes[ids]
            for w in range(2, longest + 1):
                at = grams(ids, w)
                at = at[kept.value.has(two_hashes(gram_hashes(own, at, w, lang).astype(np.int64)))] if len(at) else at
                if not len(at):
                    continue
                if w * width_bits <= 63:
                    key = ids[at]
                    for k in range(1, w):
                        key = key << width_bits | ids[at + k]
                    _, first, n = np.unique(key, return_index=True, return_counts=True)
                else:
                    _, first, n = np.unique(np.stack([ids[at + k] for k in range(w)]), axis=1, return_index=True, return_counts=True)
                parts = [[names[x] for x in ids[at[first] + k].tolist()] for k in range(w)]
                text = [b" ".join(p).decode("utf-8", "replace") for p in zip(*parts)]
                for k in range(0, len(text), 1 << 16):
                    some = text[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(np.full(len(some), w, np.int32)), pa.array(n[k : k + (1 << 16)])], names=["lang", "phrase", "size", "c"])

    exact = chunked(rows, count_known, "lang string, phrase string, size int, c long", by_shard=False)
    exact = exact.groupBy("lang", "phrase", "size").agg(F.sum("c").alias("a")).where(F.col("a") >= support)
    exact = materialize(exact, folder + "/phrases")
    discard(spark, folder + "/known")
    n_words = sizes.groupBy("lang").agg(F.sum("c").alias("n"))
    return words.unionByName(exact), n_words


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, contained: int = CONTAINED, best: int = BEST, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two words or more."""
    counted, sizes = phrases(docs, support, longest, shards)
    parts = counted.select("lang", "phrase", "a")
    candidates = counted.where("size > 1")
    words = F.split("phrase", " ")
    cut = candidates.select("lang", "phrase", "size", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "size", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    cut = cut.join(parts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    wide = {c: f"CAST({c} AS DECIMAL(19,0))" for c in "alr"}
    cut = cut.withColumn("score", F.expr(f"CAST({wide['a']} * {wide['a']} * 1000000 AS DECIMAL(38,0)) div CAST({wide['l']} * {wide['r']} AS DECIMAL(38,0))"))
    scored = cut.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst"))
    # a phrase of size s lies in a longer one at one of its places
    longer = candidates.where("size > 2").select("lang", "size", "a", words.alias("w"))
    longer = longer.select("lang", "size", "a", "w", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("s"))
    longer = longer.select("lang", "a", "w", "s", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("s") + 1)).alias("from"))
    longer = longer.select("lang", "a", F.array_join(F.slice("w", F.col("from"), F.col("s")), " ").alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < contained * F.col("a")))
    kept = kept.select("lang", "phrase", "a", F.col("worst.l").alias("l"), F.col("worst.r").alias("r"), F.col("worst.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    first = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    some = dealt.withColumn("rank", first).where(F.col("rank") <= best).drop("rank", "part")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    top = some.withColumn("rank", rank).where(F.col("rank") <= best)
    return top.join(F.broadcast(sizes), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
