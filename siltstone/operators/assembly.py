"""From fused candidates to an evidence pack: items, attribution, issues, groups, budgets."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A role of an item and its order when an item has several.
ROLE_ORDER = {"seed": 0, "context": 1, "support": 2}


def items(seeds: DataFrame, context: DataFrame, support: DataFrame, most_items: int = 10, most_expanded: int = 20) -> DataFrame:
    """query_id, item_id, role, score: each item once, in its first role; seeds and expanded items are capped on their
    own. Inputs: query_id, item_id, score."""
    every = seeds.withColumn("role", F.lit("seed")).unionByName(context.withColumn("role", F.lit("context"))).unionByName(support.withColumn("role", F.lit("support")))
    order = F.create_map(*[F.lit(x) for kv in ROLE_ORDER.items() for x in kv])[F.col("role")]
    best = every.groupBy("query_id", "item_id").agg(F.min_by(F.struct("role", "score"), F.struct(order.alias("o"), (-F.col("score")).alias("s"))).alias("b")).select("query_id", "item_id", "b.*")
    seed = (F.col("role") == "seed").cast("int")
    rank = F.row_number().over(Window.partitionBy("query_id", seed).orderBy(order, F.desc("score"), "item_id"))
    return best.withColumn("__r", rank).where(F.col("__r") <= F.when(F.col("role") == "seed", most_items).otherwise(most_expanded)).drop("__r")


def sole_document(rows: DataFrame, key: str, document: str) -> DataFrame:
    """key, document: the document if there is only one, else null."""
    return rows.groupBy(key).agg(F.count_distinct(document).alias("n"), F.min(document).alias("d")).select(key, F.when(F.col("n") == 1, F.col("d")).alias(document))


def issues(queries: DataFrame, found: DataFrame, low: float = 0.1) -> DataFrame:
    """query_id, issue: no_result, or low_confidence when every score is low."""
    d = queries.select("query_id").join(found.groupBy("query_id").agg(F.max("score").alias("best")), "query_id", "left")
    issue = F.when(F.col("best").isNull(), "no_result").when(F.col("best") < low, "low_confidence")
    return d.select("query_id", issue.alias("issue")).where("issue IS NOT NULL")


def inner_relations(relations: DataFrame, found: DataFrame) -> DataFrame:
    """Relations both of whose ends are items, once each."""
    own = found.select("item_id").distinct()
    d = relations.join(own.withColumnRenamed("item_id", "src"), "src", "left_semi").join(own.withColumnRenamed("item_id", "dst"), "dst", "left_semi")
    return d.dropDuplicates(["relation_id"])


def group_relations(found: DataFrame, relations: DataFrame) -> DataFrame:
    """snapshot, item_ids, relation_ids: a snapshot's items, and the relations that touch one of them, once each. Both are of
    one pack, so the lists are short. found: item_id, snapshot."""
    ends = relations.select("relation_id", F.col("src").alias("item_id")).unionByName(relations.select("relation_id", F.col("dst").alias("item_id")))
    touch = found.join(ends, "item_id").groupBy("snapshot").agg(F.sort_array(F.collect_set("relation_id")).alias("relation_ids"))
    own = found.where("snapshot IS NOT NULL AND trim(snapshot) <> ''").groupBy("snapshot").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    empty = F.array().cast(relations.select(F.array("relation_id").alias("a")).schema["a"].dataType)
    return own.join(touch, "snapshot", "left").withColumn("relation_ids", F.coalesce("relation_ids", empty))


def groups(found: DataFrame, relations: DataFrame) -> DataFrame:
    """snapshot, items, relations: how many items and touching relations a snapshot has. found: item_id, snapshot."""
    ends = relations.select("relation_id", F.col("src").alias("item_id")).unionByName(relations.select("relation_id", F.col("dst").alias("item_id")))
    touch = found.join(ends, "item_id").groupBy("snapshot").agg(F.count_distinct("relation_id").alias("relations"))
    return found.groupBy("snapshot").agg(F.count_distinct("item_id").alias("items")).join(touch, "snapshot", "left").withColumn("relations", F.coalesce("relations", F.lit(0)))


#: Semantic roles that contradict each other.
OPPOSED = (("advantage", "disadvantage"), ("pro", "con"), ("benefit", "risk"))


def conflicts(found: DataFrame) -> DataFrame:
    """query_id, issue, item_ids: conflicting_evidence where two seeds have opposed semantic roles, with all seeds whose role is
    one of those that can be opposed. found: query_id, item_id, role, semantic_role."""
    said = F.lower("semantic_role")
    d = found.where((F.col("role") == "seed") & said.isin(*[r for pair in OPPOSED for r in pair]))
    d = d.groupBy("query_id").agg(F.collect_set(said).alias("roles"), F.array_sort(F.collect_list("item_id")).alias("item_ids"))  # of a query's seeds
    both = F.lit(False)
    for one, other in OPPOSED:
        both = both | (F.array_contains("roles", one) & F.array_contains("roles", other))
    return d.where(both).select("query_id", F.lit("conflicting_evidence").alias("issue"), "item_ids")


def seed_budget(found: DataFrame, budget: int = 12_000, share: float = 0.6, least: int = 200) -> DataFrame:
    """Adds given: the characters that a seed may keep, its share of the seeds' budget but never less than `least`."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    return found.withColumn("given", F.least(F.length("text"), F.greatest(F.lit(least), F.floor(F.lit(budget * share) / n))))


#: White space around a sentence; where a sentence ends.
AROUND, END = "".join(map(chr, range(0x21))), re.compile(r"(?<=[。！？!?])[ \t\n\x0b\f\r]*|\n+")


@functools.lru_cache(1 << 10)
def _bigrams(text: str) -> frozenset[tuple[str, str]]:
    return frozenset(zip(text, text[1:]))


def _extract(text: str, most: int, asked: str) -> str:
    """One text of extract(). A sentence's bigrams meet the query's in one pass, and no list is copied."""
    wanted = _bigrams(asked)
    parts = [p for p in (s.strip(AROUND) for s in END.split(text)) if p]
    if len(parts) <= 1 or not wanted:
        return text[:most] + "..."
    score = [len(wanted.intersection(zip(p, p[1:]))) for p in parts]
    ranked = sorted(range(len(parts)), key=lambda i: (-score[i], i))
    picked, used = [], 0
    for i in ranked:
        need = len(parts[i]) + bool(picked)
        if used + need <= most:
            picked.append(i)
            used += need
    return " ".join(parts[i] for i in sorted(picked)) if picked else parts[ranked[0]][:most]


@F.pandas_udf(StringType())
def extract(text: pd.Series, most: pd.Series, asked: pd.Series) -> pd.Series:
    """The text within `most` characters: sentences (pieces after a stop or at line ends, without white space around them) by the
    number of the query's (asked) bigrams that they have, the earlier one of equals first, each if it still fits with a blank
    before it; in their own order. If none fits, the beginning of the best one; a text of one sentence, or a query without
    bigrams, gives the beginning of the text and dots. Null texts stay null."""
    return pd.Series([None if t is None else _extract(t, int(m), a or "") for t, m, a in zip(text, most, asked)], dtype=object)


def compress(found: DataFrame, queries: DataFrame, budget: int = 12_000, share: float = 0.6, least_seed: int = 200, least_other: int = 100) -> DataFrame:
    """found with shorter texts, for queries whose items hold more than `budget` characters in all. Seeds have `share` of it in
    equal parts and are cut off; all others have the rest in equal parts and keep the sentences nearest to the query.
    Parts have their least sizes. Lengths are code points. found: query_id, item_id, role, text; queries: query_id, text,
    keywords."""
    w = Window.partitionBy("query_id")
    seed = F.col("role") == "seed"
    asked = F.trim(F.array_join(F.concat(F.array(F.coalesce("text", F.lit(""))), F.coalesce("keywords", F.array().cast("array<string>"))), " "))
    d = found.join(queries.select("query_id", asked.alias("__asked")), "query_id", "left")
    d = d.withColumn("__all", F.sum(F.coalesce(F.length("text"), F.lit(0))).over(w))
    d = d.withColumn("__seeds", F.count_if(seed).over(w)).withColumn("__others", F.count_if(~seed).over(w))
    first = int(budget * share)
    each = F.when(seed, F.greatest(F.lit(least_seed), F.floor(F.lit(first) / F.col("__seeds")))).otherwise(F.greatest(F.lit(least_other), F.floor(F.lit(budget - first) / F.col("__others")))).cast("int")
    fits = (F.col("__all") <= budget) | F.col("text").isNull() | (F.length("text") <= each)
    cut = F.concat(F.substring("text", F.lit(1), each), F.lit("..."))
    kept = extract(F.when(~fits & ~seed, F.col("text")), each, F.col("__asked"))  # of no other texts
    return d.withColumn("text", F.when(fits, F.col("text")).when(seed, cut).otherwise(kept)).select(*found.columns)


#: Relations whose expansion items support a seed.
SUPPORTING = ("elaborates", "conditions", "causes", "results_in")


def evidence_role(role, score, discourse, relation, high: float = 0.7, medium: float = 0.4):
    """direct_answer, support, contrast or background. Seeds go by score, but a satellite is never a direct answer; an item
    that a relation led to goes by that relation; any other by score, and a satellite is background."""
    satellite = F.coalesce(discourse, F.lit("standalone")) == "satellite"
    near = F.when(score >= medium, "support").otherwise("background")
    seed = F.when(~satellite & (score >= high), "direct_answer").otherwise(near)
    expanded = F.when(relation == "contrasts_with", "contrast").when(relation.isin(*SUPPORTING), "support").otherwise("background")
    return F.when(role == "seed", seed).when(F.coalesce(relation, F.lit("")) != "", expanded).when(satellite, "background").otherwise(near)


def section_prefix(path, levels: int = 1):
    """The lower-cased titles of a section path's first levels, as tree navigation names chapters."""
    return F.lower(F.array_join(F.slice(path, 1, levels), "/"))


def order_seeds(found: DataFrame) -> DataFrame:
    """Adds place, from 1: seeds of navigated chapters first, then nuclei before standalone ones before satellites, then
    by score. found: query_id, item_id, score, navigated, discourse."""
    tier = F.when(F.col("discourse") == "nucleus", 0).when(F.col("discourse") == "satellite", 2).otherwise(1)
    w = Window.partitionBy("query_id").orderBy(F.when(F.col("navigated"), 0).otherwise(1), tier, F.desc("score"), "item_id")
    return found.withColumn("place", F.row_number().over(w))


def source_segments(candidates: DataFrame) -> DataFrame:
    """query_id, unit_id, segment_id: of each candidate its own segment, else the segments of its source reference, else
    those of its target reference if it has a target type; none without any. candidates: query_id, unit_id,
    source_segment_id, source_refs, target_type, target_ref (JSON with raw_segment_ids or a list)."""

    def ids(column: str):
        text = F.coalesce(F.col(column), F.lit("{}"))
        named = F.from_json(F.get_json_object(text, "$.raw_segment_ids"), "array<string>")
        return F.filter(F.coalesce(named, F.from_json(text, "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))

    own = F.when(F.trim(F.coalesce("source_segment_id", F.lit(""))) != "", F.array("source_segment_id"))
    source = F.when(F.size(ids("source_refs")) > 0, ids("source_refs"))
    target = F.when(F.trim(F.coalesce("target_type", F.lit(""))) != "", ids("target_ref"))
    found = F.array_distinct(F.coalesce(own, source, target))
    return candidates.select("query_id", "unit_id", F.explode(found).alias("segment_id"))
