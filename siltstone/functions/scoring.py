"""Scores used by retrieval, graph building and queues, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def npmi(p_head: Column, p_tail: Column, p_both: Column) -> Column:
    """Normalised pointwise mutual information in [-1, 1]; -1 without joint occurrence."""
    value = F.log(p_both / (p_head * p_tail)) / -F.log(p_both)
    return F.when((p_both <= 0) | (p_head <= 0) | (p_tail <= 0), -1.0).when(p_both >= 1, 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def npmi_confidence(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value + 1) / 2))


def graph_score(hop: Column, confidence: Column, is_card: Column, decay: float = 0.6) -> Column:
    """0.85 x decay^hop x confidence, a tenth more for cards, at most 1; a confidence of 0 or less counts as 0.01."""
    decay = decay if 0 < decay <= 1 else 0.6
    own = F.when(confidence <= 0, 0.01).otherwise(confidence)
    return F.least(F.lit(1.0), F.lit(0.85) * F.pow(F.lit(decay), hop) * own * F.when(is_card, 1.1).otherwise(1.0))


def expansion_score(depth: Column) -> Column:
    return 1.0 / (1.0 + depth)


def backoff(base: float, attempt: Column, most: float) -> Column:
    return F.least(F.pow(F.lit(base), attempt), F.lit(most))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
