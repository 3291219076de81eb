"""Discourse relations between segments: windows, clean-up of labelled pairs, roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import best_of

#: Relation labels and which end is the nucleus: the earlier segment, the later one, or both.
NUCLEUS = {
    "elaborates": "earlier", "exemplifies": "earlier", "evidences": "earlier", "justifies": "earlier", "purposes": "earlier", "results_in": "earlier",
    "backgrounds": "later", "conditions": "later", "enables": "later", "causes": "later", "concedes": "later",
    "summarizes": "both", "sequences": "both", "contrasts_with": "both", "parallels": "both",
}


def overlapping_windows(segments: DataFrame, keys: Sequence[str], order: str, size: int = 15) -> DataFrame:
    """Adds window: segment i of a document is in every window of `size` that starts at a multiple of size - 1, so
    neighbouring windows share one segment. A document's last segment opens no window of its own past the first."""
    step = size - 1
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    at = segments.withColumn("__i", i)
    shared = (F.col("__i") % step == 0) & (F.col("__i") > 0)
    own = F.floor(F.col("__i") / step)
    return at.withColumn("window", F.explode(F.when(shared, F.array(own - 1, own)).otherwise(F.array(own)))).drop("__i")


def clean_relations(labelled: DataFrame, labels: Sequence[str] = tuple(NUCLEUS), min_confidence: float = 0.5) -> DataFrame:
    """Known labels with enough confidence between different segments; of a repeated (src, dst, type) the most
    confident, with its distance."""
    fine = labelled.where(F.col("type").isin(*labels) & (F.col("confidence") >= min_confidence) & (F.col("src") != F.col("dst")))
    best = best_of(fine, ["document", "src", "dst", "type"], [F.col("confidence")], ["confidence"])
    return best.withColumn("distance", F.abs(F.col("src") - F.col("dst")))


def roles(segments: DataFrame, relations: DataFrame) -> DataFrame:
    """document, segment, role: nucleus if any relation makes it one, else satellite if it is in one, else standalone.
    Which end is earlier is a matter of segment order; a label's source and target do not count."""
    nucleus = F.create_map(*[F.lit(x) for kv in NUCLEUS.items() for x in kv])[F.col("type")]

    def end(segment: Column, side: str) -> DataFrame:
        rank: Column = F.when(nucleus.isin(side, "both"), 2).otherwise(1)
        return relations.select("document", segment.alias("segment"), rank.alias("rank"))

    best = end(F.least("src", "dst"), "earlier").unionByName(end(F.greatest("src", "dst"), "later")).groupBy("document", "segment").agg(F.max("rank").alias("rank"))
    named = F.when(F.col("rank") == 2, "nucleus").when(F.col("rank") == 1, "satellite").otherwise("standalone")
    return segments.join(best, ["document", "segment"], "left").select("document", "segment", named.alias("role"))
