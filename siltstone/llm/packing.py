"""Packing into optimal length buckets (operator 9).

Dynamic programming over the histogram of all lengths picks the bucket boundaries that pad least; inside a bucket,
documents padded to its boundary fill batches of a token budget. Places in a bucket are counted without sorting a
bucket in one task: rows are dealt to cells of bounded size, a cell's rows are numbered in it, and the running sum of
cell sizes gives its offset. Every batch of a bucket but the last is full.

Lengths up to EXACT have a bin each; above, a bin is a 1/1024 of its octave, which bounds the histogram. A bucket's
boundary is always the greatest length in it, so padding is never understated.

Cases: a null or empty text has length 0 and is packed like length 1; a document longer than the budget is a batch by
itself; of boundaries that pad as little the first stand, and rows of one cell and doc_id follow each other in the order
in which they were read; a very long text counts in one task and moves nowhere; repeated rows are packed each; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, workspace

BUCKETS, TOKEN_BUDGET = 16, 65_536
EXACT = 2_048
CELL_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def histogram(lengths: DataFrame) -> list[tuple[int, int, int]]:
    """(greatest length, rows, sum of lengths) of each bin, by length; a bounded number of bins."""
    n = F.col("n_tokens")
    octave = F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")
    wide = F.pow(F.lit(2.0), F.greatest(octave - 10, F.lit(0))).cast("long")
    bins = lengths.groupBy(F.when(n <= EXACT, n).otherwise(F.floor(n / wide) * wide).alias("bin")).agg(F.max(n).alias("most"), F.count("*").alias("rows"), F.sum(n).alias("total"))
    return sorted((r.most, r.rows, r.total) for r in bins.collect())


def boundaries(bins: list[tuple[int, int, int]], buckets: int = BUCKETS) -> list[int]:
    """Greatest lengths of at most `buckets` buckets with the least total padding.

    The cost of a bucket satisfies the quadrangle inequality, so the best last cut moves with the end and each layer
    is solved by divide and conquer.
    """
    if not bins:
        return []
    most = np.array([b[0] for b in bins], float)
    rows = np.concatenate([[0.0], np.cumsum([b[1] for b in bins], dtype=float)])
    total = np.concatenate([[0.0], np.cumsum([b[2] for b in bins], dtype=float)])
    m = len(bins)
    layers = min(buckets, m)
    best = most * rows[1:] - total[1:]
    cuts = [np.zeros(m, np.int64)]
    for _ in range(1, layers):
        new, cut = best.copy(), np.zeros(m, np.int64)
        todo = [(1, m - 1, 1, m - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(j, last) + 1)
            if not len(i):
                i = np.array([min(first, j)])
            cost = best[i - 1] + most[j] * (rows[j + 1] - rows[i]) - (total[j + 1] - total[i])
            k = int(cost.argmin())
            new[j], cut[j] = cost[k], i[k]
            todo += [(low, j - 1, first, int(i[k])), (j + 1, high, int(i[k]), last)]
        best = new
        cuts.append(cut)
    out, j = [], m - 1
    for cut in reversed(cuts):
        out.append(int(most[j]))
        j = int(cut[j]) - 1
        if j < 0:
            break
    return out[::-1]


def pack(lengths: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, cell_rows: int = CELL_ROWS) -> DataFrame:
    """lengths: doc_id, n_tokens. Adds bucket, bucket_len, batch (within the bucket), place (within the batch) and
    padding."""
    spark = lengths.sparkSession
    rows = lengths.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens"))
    rows = materialize(rows.where("doc_id IS NOT NULL").withColumn("row", F.monotonically_increasing_id()), workspace(spark) + "/lengths")
    bins = histogram(rows)
    ends = boundaries(bins, buckets)
    cells = max(1, -(-sum(b[1] for b in bins) // cell_rows))
    limits = F.array(*[F.lit(e).cast("long") for e in ends or [0]])
    dealt = rows.withColumn("bucket", F.size(F.filter(limits, lambda e: e < F.col("n_tokens"))))
    dealt = dealt.withColumn("bucket_len", F.element_at(limits, F.col("bucket") + 1)).withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)))
    sizes = dealt.groupBy("bucket", "cell").count()
    before = Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket", "cell").orderBy("doc_id", "row")
    capacity = F.greatest(F.lit(1).cast("long"), F.expr(f"{int(token_budget)}L div greatest(bucket_len, 1L)"))
    placed = dealt.withColumn("rank", F.row_number().over(inside)).join(offsets, ["bucket", "cell"])
    placed = placed.withColumn("at", F.col("offset") + F.col("rank") - 1).withColumn("capacity", capacity)
    return placed.select("doc_id", "n_tokens", "bucket", "bucket_len", F.expr("at div capacity").alias("batch"), F.expr("at % capacity").alias("place"), (F.greatest("bucket_len", F.lit(1)) - F.col("n_tokens")).alias("padding"))


def pack_documents(docs: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """Packs documents by their number of words."""
    return pack(docs.select("doc_id", word_count(F.col("text")).alias("n_tokens")), buckets, token_budget)
