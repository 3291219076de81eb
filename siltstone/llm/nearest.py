"""Approximate nearest neighbours by shifted space-filling curves (operator 8).

Each of CURVES curves rotates the vectors at random, keeps a few coordinates, shifts them by its own offset and reads
off a Hilbert key. A curve's keys are cut into WINDOWS ranges, at every size of the table; a query is compared with its
own range and the ones on either side (on small tables with as many around it as hold LEAST times k rows), and what all
curves bring together is ranked by the exact inner product. Largest inner product becomes
nearness on a sphere by one more coordinate: candidates get sqrt(M^2 - |x|^2), queries, scaled to norm M, 0. Candidates
are split into bands of norms that differ by less than a factor of two, each with its own M, curves and cuts, and every
query searches every band: a few very long vectors change nothing for the others.

Equal vectors are one: each distinct vector stands for its k + 1 smallest vec_ids, which are all that can be among a
query's k best (one may be the query). The curves order distinct vectors, the best ones are expanded to their ids, and a
query's own vector is always among them.

Cuts are fitted on a bounded sample (about SAMPLE vectors, by a bound on their hash, shared out among the bands), every one is
indexed. A range holds a fixed share of the
rows, so the work grows with queries times rows: on vectors without cluster structure no curve can do better at a
given recall. Ranges are dealt to tasks in tiles of bounded size (TILE_ROWS candidates by TILE_QUERIES queries).

Cases: vectors that are null, zero, of another dimension than the most frequent one, or with a null or non-finite
component take no part; rows that repeat a vec_id are candidates once each but not for their own id; ties go to the
smaller vec_id; with fewer candidates than k all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix64, small_batches, workspace

CURVES, WINDOWS = 24, 48
#: Rows, as a multiple of k, that a query meets on each curve at least (in the mean), if the table has them.
LEAST = 4
AXES, BITS = 6, 10
SAMPLE = 20_000
TILE_ROWS, TILE_QUERIES = 8_000, 4_000
#: Values of the hash by which the sample is drawn.
SHARES = 1 << 30


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of each row of non-negative integers below 2**bits (axes times bits up to 64).

    Gray-code form: going down the bits, the lower bits of the axes are swapped or inverted so that each sub-cube has
    the curve's orientation; then the transposed Gray code is undone and the bits are interleaved.
    """
    x = [c.astype(np.uint64) for c in cells.T]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(len(x)):
            up = (x[i] & q) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> np.uint64(b)) & one, turn ^ ((one << np.uint64(b)) - one), turn)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = (key << one) | (((v ^ turn) >> np.uint64(b)) & one)
    return key


def norms_of(v: np.ndarray) -> np.ndarray:
    most = np.abs(v).max(axis=1)
    return most * np.sqrt(((v / most[:, None]) ** 2).sum(axis=1))


def bands_of(v: np.ndarray) -> np.ndarray:
    """The band of each row: norms from 2^(b - 1/2) to below 2^(b + 1/2)."""
    return np.rint(np.log2(norms_of(v))).astype(np.int32)


def _curve_ties(ties: np.ndarray, curve: int) -> np.ndarray:
    return mix64(ties.view(np.uint64) + np.uint64(curve))


class Curves:
    """Rotations, shifts and the fitted cuts; keys(v) gives an array of curves by rows."""

    def __init__(self, dimension: int, curves: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.axes = np.stack([np.linalg.qr(rng.normal(size=(dimension + 1, AXES)))[0] for _ in range(curves)])
        self.shifts = rng.random((curves, AXES))
        self.middle = self.spread = None
        self.norm = 1.0
        self.cuts: np.ndarray | None = None

    def lift(self, v: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """The extra coordinate, for candidates scaled to the greatest norm and queries of norm 1."""
        v = v / np.where(queries, norms_of(v), self.norm)[:, None]
        rest = np.sqrt(np.maximum(0, 1 - (v * v).sum(axis=1)))
        return np.hstack([v, np.where(queries, 0, rest)[:, None]])

    def fit_scale(self, v: np.ndarray, norm: float) -> None:
        self.norm = norm
        lifted = self.lift(v, np.zeros(len(v), bool))
        self.middle = lifted.mean(axis=0)
        self.spread = np.maximum(1e-12, np.stack([((lifted - self.middle) @ a).std(axis=0) for a in self.axes]))

    def keys(self, v: np.ndarray, queries: np.ndarray) -> np.ndarray:
        lifted = self.lift(v, queries) - self.middle
        out = []
        for axes, shift, spread in zip(self.axes, self.shifts, self.spread):
            unit = np.clip((lifted @ axes / spread + 3) / 6, 0, 1) / 2 + shift / 2
            out.append(hilbert_keys(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS))
        return np.stack(out)

    def fit_cuts(self, keys: np.ndarray, ties: np.ndarray, windows: int) -> None:
        """Cuts between windows of equal share, as (key, tie) pairs: equal keys are parted by the tie, a hash of the
        vector that is mixed anew for each curve, so that a dense spot still fills several windows."""
        at = (np.arange(1, windows) * keys.shape[1]) // windows
        self.cuts = []
        for c, k in enumerate(keys):
            t = _curve_ties(ties, c)
            o = np.lexsort((t, k))[at]
            self.cuts.append((k[o], t[o]))

    def windows(self, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """The window of each row on each curve."""
        out = []
        for c, (k, (ck, ct)) in enumerate(zip(keys, self.cuts)):
            t = _curve_ties(ties, c)
            first, last = np.searchsorted(ck, k, side="left"), np.searchsorted(ck, k, side="right")
            w = first.copy()
            for r in np.flatnonzero(last > first):
                w[r] = first[r] + np.searchsorted(ct[first[r] : last[r]], t[r], side="right")
            out.append(w)
        return np.stack(out)


def reach(count: int, windows: int, k: int) -> int:
    """How many neighbouring windows a query looks at: three, or more where these hold too few rows."""
    return min(windows, max(3, -(-LEAST * k * windows // count) | 1))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (common.d if common else 0))


def distinct_vectors(rows: DataFrame, k: int, folder: str) -> DataFrame:
    """(node, v, tie, first, ids, band): every vector once, with its k + 1 smallest vec_ids and its band of norms;
    materialized. The ranks are limited before the shuffle too, so a very common vector sends few rows."""

    @F.pandas_udf("int")
    def band(v: pd.Series) -> pd.Series:
        return pd.Series(bands_of(np.stack(v.to_numpy())) if len(v) else np.empty(0, np.int32))

    rank = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    some = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    return materialize(some.select(F.monotonically_increasing_id().alias("node"), "v", F.xxhash64("v").alias("tie"), F.col("ids")[0].alias("first"), "ids", band("v").alias("band")), folder)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, curves: int = CURVES, windows: int = WINDOWS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row with is_query (over vec_id) the k best found."""
    spark = vectors.sparkSession
    small_batches(spark)
    folder = workspace(spark)
    rows = usable(vectors)
    groups = distinct_vectors(rows, k, folder + "/vectors")
    counts = {r.band: r["count"] for r in groups.groupBy("band").count().collect()}
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v").distinct()
    asked = materialize(asked.join(groups.select("v", "node"), "v").select("query_id", "node"), folder + "/queries")
    searched = groups.join(asked.select("node").distinct(), "node", "left_semi").select("node", "v", "tie", "first", "band")
    queries = asked.select("node").distinct().count()
    # rows whose hash is in the share that makes about as many as are wanted of each band: no order of all rows is needed
    wanted = max(windows, sample // len(counts))
    share = F.create_map(*[F.lit(x) for band, n in counts.items() for x in (band, int(min(1.0, wanted / n) * SHARES))])[F.col("band")]
    picked = groups.select("v", "tie", "band").where(F.pmod(F.xxhash64("v", F.lit(1)), F.lit(SHARES)) < share).toPandas().sort_values("tie", kind="stable")
    # for each band its curves, tiles of candidates, windows that a query looks at, and tiles of queries
    plan = {}
    for band, some in picked.groupby("band"):
        fitted = np.stack(some.v.to_numpy())
        width = reach(counts[band], windows, k)
        index = Curves(fitted.shape[1], curves if width < windows else 1)  # one curve will do where all windows are seen
        index.fit_scale(fitted, norms_of(fitted).max())
        index.fit_cuts(index.keys(fitted, np.zeros(len(fitted), bool)), some.tie.to_numpy(), windows)
        plan[int(band)] = index, max(1, -(-counts[band] // (windows * TILE_ROWS))), width, max(1, -(-width * queries // (windows * TILE_QUERIES)))
    shared = spark.sparkContext.broadcast(plan)

    def dealt(b: pa.RecordBatch, band: int, queries: bool) -> Iterator[pa.RecordBatch]:
        index, tiles, width, query_tiles = shared.value[band]
        ties = b.column(2).to_numpy()
        v = np.stack(b.column(1).to_numpy(zero_copy_only=False))
        at = index.windows(index.keys(v, np.full(len(v), queries)), ties)
        own = ((ties.view(np.uint64) >> np.uint64(20)) % np.uint64(query_tiles if queries else tiles)).astype(np.int32)
        for c in range(len(at)):
            first = np.clip(at[c] - width // 2, 0, windows - width) if queries else at[c]
            for w in (first + j for j in range(width if queries else 1)):
                for t in range(tiles if queries else query_tiles):
                    other = np.full(len(w), t, np.int32)
                    n, m = (other, own) if queries else (own, other)
                    head = [pa.array(np.full(len(w), x, np.int32)) for x in (band, c)]
                    yield pa.RecordBatch.from_arrays([*head, pa.array(w.astype(np.int32)), pa.array(n), pa.array(m), b.column(0), b.column(3), b.column(1)], names=[*key, "node", "first", "v"])

    def deal(queries: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bands = b.column(4).to_numpy()
                for band in (shared.value if queries else np.unique(bands).tolist()) if len(bands) else ():
                    yield from dealt(b if queries else b.filter(pa.array(bands == band)), band, queries)

        return run

    key = ["band", "curve", "window", "tile", "query_tile"]
    places = "band int, curve int, window int, tile int, query_tile int, node long, first long, v array<double>"
    left = searched.mapInArrow(deal(True), places)
    right = groups.select("node", "v", "tie", "first", "band").mapInArrow(deal(False), places)

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            x, y = np.stack(q.v.to_numpy()), np.stack(c.v.to_numpy())
            nodes, firsts = c.node.to_numpy(), c["first"].to_numpy()
            slack = 1e-12 * np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1).max())
            for start in range(0, len(x), 256):
                scores = x[start : start + 256] @ y.T
                for r, row in enumerate(scores, start):
                    least = np.partition(row, len(row) - k - 1)[len(row) - k - 1] if len(row) > k + 1 else -np.inf
                    some = np.flatnonzero(row >= least - slack[r])
                    exact = (x[r] * y[some]).sum(axis=1)
                    some, exact = (z[np.lexsort((firsts[some], -exact))[: k + 1]] for z in (some, exact))
                    out.append(pd.DataFrame({"query": q.node.iat[r], "node": nodes[some], "first": firsts[some], "score": exact}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "node": [], "first": [], "score": []})

    def own_vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(float)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(0), b.column(3), pa.array((v * v).sum(axis=1))], names=["query", "node", "first", "score"])

    pairs = "query long, node long, first long, score double"
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, pairs).unionByName(searched.mapInArrow(own_vector, pairs))

    def best(scored: DataFrame, query: str, item: list[str], order: str, n: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), order))
        return scored.groupBy(query, *item).agg(F.max("score").alias("score")).withColumn("rank", rank.cast("int")).where(F.col("rank") <= n)

    vectors_found = best(found, "query", ["node", "first"], "first", k + 1).join(groups.select("node", "ids"), "node")
    ids_found = best(vectors_found.select("query", F.explode("ids").alias("vec_id"), "score"), "query", ["vec_id"], "vec_id", k + 1)
    answers = ids_found.groupBy(F.col("query").alias("node")).agg(F.collect_list(F.struct("vec_id", "score")).alias("hits"))
    every = asked.join(answers, "node").select("query_id", F.inline("hits")).where("vec_id <> query_id")
    return best(every, "query_id", ["vec_id"], "vec_id", k).select("query_id", "rank", "vec_id", "score")
