"""Upkeep of a co-occurrence graph: counts of entities and pairs that follow changes of confirmed mentions.

A change of a few mentions (a review confirms, a merge renames, a retraction removes) changes only the counts of their
entities and of the pairs that these form in their segments. Such a delta is computed from the touched segments alone and
added to the counts; the strength of a pair is computed from counts when it is read, so nothing goes out of date.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import npmi


@dataclass
class GraphCounts:
    """entities: entity, c (segments); pairs: head < tail, n_both; total: one row, n (segments with a mention)."""

    entities: DataFrame
    pairs: DataFrame
    total: DataFrame


def count_all(mentions: DataFrame) -> GraphCounts:
    """mentions: segment, entity. A segment's mentions are few, so its pairs are formed in place."""
    m = mentions.select("segment", "entity").distinct()
    head, tail = m.select("segment", F.col("entity").alias("head")), m.select("segment", F.col("entity").alias("tail"))
    pairs = head.join(tail, "segment").where("head < tail").groupBy("head", "tail").agg(F.count("*").alias("n_both"))
    return GraphCounts(m.groupBy("entity").agg(F.count("*").alias("c")), pairs, m.agg(F.count_distinct("segment").alias("n")))


def touched_members(mentions: DataFrame, changes: DataFrame) -> DataFrame:
    """segment, entity, old, new (0 or 1): the members, before and after, of the segments with changes. changes: segment,
    entity, sign (1 appears, -1 disappears); one that changes nothing is none, and appearing counts if both are said."""
    own = changes.select("segment").distinct()
    had = mentions.select("segment", "entity").distinct().join(own, "segment", "left_semi")
    said = had.select("segment", "entity", F.lit(1).alias("old"), F.lit(0).alias("sign")).unionByName(changes.select("segment", "entity", F.lit(0).alias("old"), F.col("sign").cast("int").alias("sign")))
    d = said.groupBy("segment", "entity").agg(F.max("old").alias("old"), F.max("sign").alias("most"), F.min("sign").alias("least"))
    new = F.when(F.col("most") > 0, 1).when(F.col("least") < 0, 0).otherwise(F.col("old"))
    return d.select("segment", "entity", "old", new.alias("new"))


def changed_mentions(mentions: DataFrame, changes: DataFrame) -> DataFrame:
    """The mentions after the changes."""
    touched = touched_members(mentions, changes)
    rest = mentions.select("segment", "entity").distinct().join(changes.select("segment").distinct(), "segment", "left_anti")
    return rest.unionByName(touched.where("new = 1").select("segment", "entity"))


def _added(old: DataFrame, delta: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sums; what comes to nothing goes. Both sides combine before the shuffle."""
    both = old.select(*keys, value).unionByName(delta.select(*keys, value))
    return both.groupBy(*keys).agg(F.sum(value).alias(value)).where(F.col(value) > 0)


def apply_changes(counts: GraphCounts, mentions: DataFrame, changes: DataFrame) -> tuple[GraphCounts, DataFrame]:
    """The counts after the changes of mentions, and the entities (entity) whose counts changed. mentions: as they were."""
    m = touched_members(mentions, changes)
    moved = m.where("old <> new")
    entities = moved.groupBy("entity").agg(F.sum(F.col("new") - F.col("old")).cast("bigint").alias("c"))
    a = moved.select("segment", F.col("entity").alias("a"), F.col("old").alias("a_old"), F.col("new").alias("a_new"))
    b = m.select("segment", F.col("entity").alias("b"), F.col("old").alias("b_old"), F.col("new").alias("b_new"))
    once = (F.col("a") != F.col("b")) & ((F.col("b_old") == F.col("b_new")) | (F.col("a") < F.col("b")))  # pairs of two that moved meet twice
    step = F.col("a_new") * F.col("b_new") - F.col("a_old") * F.col("b_old")
    pairs = a.join(b, "segment").where(once & (step != 0)).groupBy(F.least("a", "b").alias("head"), F.greatest("a", "b").alias("tail")).agg(F.sum(step).cast("bigint").alias("n_both"))
    had = m.groupBy("segment").agg(F.max("old").alias("had"), F.max("new").alias("has"))
    total = counts.total.unionByName(had.agg(F.coalesce(F.sum(F.col("has") - F.col("had")), F.lit(0)).cast("bigint").alias("n"))).agg(F.sum("n").alias("n"))
    new = GraphCounts(_added(counts.entities, entities, ["entity"], "c"), _added(counts.pairs, pairs, ["head", "tail"], "n_both"), total)
    return new, entities.select("entity")


def strengths(counts: GraphCounts, of: DataFrame | None = None) -> DataFrame:
    """head, tail, n_both, npmi of all pairs, or of those with an end among some entities (entity). Pairs of others keep
    theirs as long as the number of segments does."""
    pairs = counts.pairs
    if of is not None:
        pairs = pairs.join(of.select(F.col("entity").alias("head")), "head", "left_semi").unionByName(pairs.join(of.select(F.col("entity").alias("tail")), "tail", "left_semi")).distinct()
    c = counts.entities
    d = pairs.join(c.select(F.col("entity").alias("head"), F.col("c").alias("ch")), "head").join(c.select(F.col("entity").alias("tail"), F.col("c").alias("ct")), "tail")
    d = d.join(F.broadcast(counts.total))  # one row
    n = F.col("n")
    return d.select("head", "tail", "n_both", npmi(F.col("ch") / n, F.col("ct") / n, F.col("n_both") / n).alias("npmi"))


def merges(mentions: DataFrame, renamed: DataFrame) -> DataFrame:
    """Changes for apply_changes that give entities other names (entity, becomes): merges, retypings, renamings."""
    d = mentions.select("segment", "entity").distinct().join(renamed.where("entity <> becomes"), "entity")
    gone = d.select("segment", "entity", F.lit(-1).alias("sign"))
    return gone.unionByName(d.select("segment", F.col("becomes").alias("entity"), F.lit(1).alias("sign")))
