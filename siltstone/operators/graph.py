"""Entities and their graph: resolution, relation candidates, co-occurrence, edges, recall and expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import npmi, npmi_confidence
from ..functions.text import alias_form
from .relational import both_directions, bounded, top_per


def cooccurrence(mentions: DataFrame, corpus_segments: int | None = None) -> DataFrame:
    """head < tail, n_both, npmi over segments that hold either; mentions: segment, entity. The number of segments may be
    given, for a recount over part of the corpus."""
    m = mentions.select("segment", "entity").distinct()
    total = m.agg(F.count_distinct("segment").alias("n")) if corpus_segments is None else m.sparkSession.range(1).select(F.lit(corpus_segments).alias("n"))
    alone = m.groupBy("entity").agg(F.count("*").alias("c"))
    head, tail = m.select("segment", F.col("entity").alias("head")), m.select("segment", F.col("entity").alias("tail"))
    both = head.join(tail, "segment").where("head < tail").groupBy("head", "tail").agg(F.count("*").alias("n_both"))
    d = both.join(alone.select(F.col("entity").alias("head"), F.col("c").alias("ch")), "head").join(alone.select(F.col("entity").alias("tail"), F.col("c").alias("ct")), "tail")
    d = d.join(F.broadcast(total))  # one row
    return d.select("head", "tail", "n_both", npmi(F.col("ch") / F.col("n"), F.col("ct") / F.col("n"), F.col("n_both") / F.col("n")).alias("npmi"))


def resolve(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds canonical and status: auto if the normalised name is an alias or a canonical name itself, else pending."""
    known = aliases.select(alias_form(F.col("alias")).alias("__form"), F.col("canonical").alias("__found"))
    own = aliases.select(alias_form(F.col("canonical")).alias("__form"), F.col("canonical").alias("__found"))
    names = known.unionByName(own).groupBy("__form").agg(F.min("__found").alias("__found"))
    d = mentions.withColumn("__form", alias_form(F.col("name"))).join(names, "__form", "left")
    return d.withColumn("canonical", F.coalesce("__found", "name")).withColumn("status", F.when(F.col("__found").isNotNull(), "auto").otherwise("pending")).drop("__form", "__found")


def relation_candidates(mentions: DataFrame, rules: DataFrame, most: int = 20) -> DataFrame:
    """Ordered pairs of different entities in a segment with the relation types that allow their types ('*' allows
    any); relation_type is null where no rule does. rules: relation_type, head_type, tail_type. Where mentions have a
    confidence, the `most` surest entities of a segment (ties by name) form pairs, as an extraction's rule asks."""
    m = mentions.select("segment", "entity", "type").distinct()
    if "confidence" in mentions.columns:
        own = mentions.groupBy("segment", "entity", "type").agg(F.max("confidence").alias("confidence"))
        m = top_per(own, ["segment"], [F.desc("confidence"), F.col("entity"), F.col("type")], most).drop("confidence")
    h = m.select("segment", F.col("entity").alias("head"), F.col("type").alias("head_type"))
    t = m.select("segment", F.col("entity").alias("tail"), F.col("type").alias("tail_type"))
    pairs = h.join(t, "segment").where("head <> tail")
    r = rules.select("relation_type", F.col("head_type").alias("rh"), F.col("tail_type").alias("rt"))
    return pairs.join(bounded(r), F.expr("(rh = '*' OR rh = head_type) AND (rt = '*' OR rt = tail_type)"), "left").drop("rh", "rt")


def edges(mentions: DataFrame, rules: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Kept edges: allowed pairs with an NPMI of at least the threshold, with confidence and evidence count."""
    allowed = relation_candidates(mentions, rules).where("relation_type IS NOT NULL")
    counted = allowed.groupBy("head", "tail", "relation_type").agg(F.count_distinct("segment").alias("evidence"))
    n = cooccurrence(mentions)
    sym = n.select("head", "tail", "npmi").unionByName(n.select(F.col("tail").alias("head"), F.col("head").alias("tail"), "npmi"))
    return counted.join(sym, ["head", "tail"]).where(F.col("npmi") >= threshold).withColumn("confidence", npmi_confidence(F.col("npmi")))


def recall(seeds: DataFrame, edge_rows: DataFrame, max_hop: int = 2, min_confidence: float = 0.5) -> DataFrame:
    """seed, node, hop, confidence: nodes on simple paths of at most max_hop undirected edges, each confident enough;
    the least hop, and the greatest product of confidences."""
    e = both_directions(edge_rows.where(F.col("confidence") >= min_confidence).select("head", "tail", "confidence"), "head", "tail")
    paths = seeds.select("seed", F.col("seed").alias("node"), F.array("seed").alias("path"), F.lit(1.0).alias("confidence"))
    out = []
    for hop in range(1, max_hop + 1):
        step = e.select("node", "other", F.col("confidence").alias("c"))
        paths = paths.join(step, "node").where(~F.array_contains("path", F.col("other")))
        paths = paths.select("seed", F.col("other").alias("node"), F.array_append("path", F.col("other")).alias("path"), (F.col("confidence") * F.col("c")).alias("confidence"))
        out.append(paths.select("seed", "node", F.lit(hop).alias("hop"), "confidence"))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.groupBy("seed", "node").agg(F.min("hop").alias("hop"), F.max("confidence").alias("confidence"))


def neighbours(seeds: DataFrame, edge_rows: DataFrame, hops: int = 1) -> DataFrame:
    """Edges that touch a node within `hops` of a seed; some lead out of the last ring."""
    e = both_directions(edge_rows.select("head", "tail"), "head", "tail")
    ring = seeds.select(F.col("seed").alias("node")).distinct()
    for _ in range(hops - 1):
        ring = ring.unionByName(e.join(ring, "node", "left_semi").select(F.col("other").alias("node"))).distinct()
    touch = lambda c: edge_rows.join(ring.withColumnRenamed("node", c), c, "left_semi")
    return touch("head").unionByName(touch("tail")).distinct()
