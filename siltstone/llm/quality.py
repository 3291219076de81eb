"""Quality rules: boosted trees over document statistics (operator 10).

Each document becomes a vector of statistics. A gradient-boosted ensemble is fitted on a bounded sample of labelled
documents, its trees are flattened into numpy node arrays, and every document is scored a batch at a time. Trees are
monotone in the features listed in MONOTONE: more junk can never raise the score.

Cases: a null or empty text has zero words and fails the base rule; a document without words is never kept; repeated
rows are scored alike; a score on the threshold is kept; a very long text is one value in one task, in proportion to
its length; with no labels, or labels of one class only, the verdict is the base rule alone; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, window_hashes, word_hashes

SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_len", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "punct_rate", "digit_rate", "distinct_rate", "max_word_rate"]
#: -1: the score never rises with the feature.
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "upper_rate": -1}
#: Labelled documents that the fit uses at most, chosen by a hash of doc_id.
MAX_TRAIN = 20_000


def statistics(text: str) -> tuple[list[int], list[float]]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    dup_lines = len(lines) - len(set(lines))
    h = word_hashes(words)
    repeated = 0
    if n >= 3:
        g = window_hashes(h, 3)
        _, inverse, counts = np.unique(g, return_inverse=True, return_counts=True)
        hit = counts[inverse] > 1
        if hit.any():
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : k + len(hit)] |= hit
            repeated = int(covered.sum())
    octets = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, digits = int(octets[65:91].sum()), int(octets[48:58].sum())
    letters = max(1, upper + int(octets[97:123].sum()))
    punct = int(octets[33:48].sum() + octets[58:65].sum() + octets[91:97].sum() + octets[123:127].sum())
    if n:
        _, counts = np.unique(h, return_counts=True)
        distinct, top = len(counts) / n, counts.max() / n
    else:
        distinct, top = 0.0, 0.0
    size = max(1, chars)
    return [n, chars, symbols, dup_lines, repeated], [
        float(np.log1p(n)), chars / max(1, n), symbols / size, dup_lines / max(1, len(lines)), repeated / max(1, n),
        upper / letters, punct / size, digits / size, float(distinct), float(top),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, and the features as an array."""

    def make():
        def each(ids, texts):
            pairs = [statistics(t) for t in texts]
            out = {"doc_id": ids, "features": [p[1] for p in pairs]}
            return out | {k: [p[0][i] for p in pairs] for i, k in enumerate(COUNTS)}

        return each

    return map_texts(docs, make, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", features array<double>")


class Forest:
    """A fitted ensemble as flat node arrays; leaves point to themselves."""

    def __init__(self, feature, threshold, left, right, value, roots, depth, base):
        self.feature, self.threshold, self.left, self.right, self.value = feature, threshold, left, right, value
        self.roots, self.depth, self.base = roots, depth, base

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of x."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit_forest(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Forest:
    """Second-order boosting of the logistic loss on feature histograms.

    A split on a constrained feature must order its two leaf values as asked, and the midpoint of these bounds all
    values below, so that the whole ensemble is monotone in that feature.
    """
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    rate0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate0 / (1 - rate0)))
    nodes: list[list[float]] = []
    roots = []
    f = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        grad, hess = y - p, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        todo = [(roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
        while todo:
            at, rows, low, high, level = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            value = float(np.clip(g / (h + ridge), low, high))
            best = None
            if level < depth and len(rows) >= 2 * least:
                for j, c in enumerate(cuts):
                    b = binned[rows, j]
                    size = len(c) + 1
                    gl = np.cumsum(np.bincount(b, grad[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(b, hess[rows], size))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                    if not len(gl):
                        continue
                    vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip((g - gl) / (h - hl + ridge), low, high)
                    gain = gl * vl - (hl + ridge) * vl**2 / 2 + (g - gl) * vr - (h - hl + ridge) * vr**2 / 2
                    ok = (nl >= least) & (len(rows) - nl >= least) & ((vr - vl) * monotone[j] >= 0)
                    gain = np.where(ok, gain, -np.inf)
                    k = int(gain.argmax())
                    if gain[k] > g * value - (h + ridge) * value**2 / 2 + 1e-6 and (best is None or gain[k] > best[0] + 1e-12):
                        best = (gain[k], j, k, vl[k], vr[k])
            if best is None:
                nodes[at][4] = rate * value
                f[rows] += rate * value
                continue
            _, j, k, vl, vr = best
            left, right = len(nodes), len(nodes) + 1
            nodes += [[0, np.inf, left, left, 0.0], [0, np.inf, right, right, 0.0]]
            nodes[at][:4] = [j, cuts[j][k], left, right]
            mid = (vl + vr) / 2
            below = binned[rows, j] <= k
            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[int(monotone[j])]
            todo.append((left, rows[below], *bounds[0], level + 1))
            todo.append((right, rows[~below], *bounds[1], level + 1))
    a = np.array(nodes, dtype=float).reshape(-1, 5)
    return Forest(a[:, 0].astype(np.int32), a[:, 1], a[:, 2].astype(np.int32), a[:, 3].astype(np.int32), a[:, 4], np.array(roots, np.int32), depth, base)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Forest | None:
    """Fits on at most max_train labelled documents; the rows that reach the driver are bounded by that."""
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    ours = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = ours.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    rows = document_statistics(chosen).join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "features").orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(max_train).toPandas()
    if rows.empty or rows.quality.nunique() < 2:
        return None
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.stack([np.asarray(v, float) for v in rows.features])
    return fit_forest(x, rows.quality.to_numpy(float), np.array([MONOTONE.get(k, 0) for k in FEATURES]))


def score(docs: DataFrame, forest: Forest | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, the five counts, base_failed, quality_score (null without a model) and kept."""

    def make():
        def each(ids, texts):
            pairs = [statistics(t) for t in texts]
            out = {k: [p[0][i] for p in pairs] for i, k in enumerate(COUNTS)}
            failed = [p[0][0] < 50 or 100 * p[0][4] > 50 * p[0][0] for p in pairs]
            if forest is None:
                s, kept = [None] * len(ids), [not b for b in failed]
            else:
                s = forest.score(np.array([p[1] for p in pairs])).tolist()
                kept = [not b and v >= threshold for b, v in zip(failed, s)]
            return out | {"doc_id": ids, "base_failed": failed, "quality_score": s, "kept": kept}

        return each

    return map_texts(docs, make, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, quality_score double, kept boolean")


def verdicts(spark: SparkSession, forest: Forest | None, threshold: float = 0.5):
    """A function of a text column: whether to keep the document."""
    shared = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        pairs = [statistics(t) for t in texts]
        fine = np.array([p[0][0] >= 50 and 100 * p[0][4] <= 50 * p[0][0] for p in pairs], bool)
        if shared.value is not None and len(pairs):
            fine &= shared.value.score(np.array([p[1] for p in pairs])) >= threshold
        return pd.Series(fine)

    return keep


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    return score(docs, train(docs, labels, max_train), threshold)
