"""What a search may read and what it brings back: scope, authorization, hydration, drill-down, expansion along relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import both_directions, window_join

#: Relations in the order in which they fill an expansion; equal ranks go by the segment.
PRIORITY = {
    "entity_relation": 0, "elaborates": 1, "conditions": 2, "backgrounds": 3, "enables": 4, "results_in": 5, "sequences": 6, "contrasts_with": 7,
    "causes": 8, "parallels": 9, "evidences": 2, "exemplifies": 3, "purposes": 5, "justifies": 5, "summarizes": 6, "concedes": 7,
    "section_header_of": 10, "same_section": 11, "previous": 12, "next": 13, "same_parent_section": 14,
}
#: Score and role of an item that a relation led to; any other relation gives 0.3 and background.
RELATION_ITEMS = {
    "elaborates": (1.5, "support"), "conditions": (1.4, "support"), "backgrounds": (1.3, "background"), "enables": (1.2, "support"),
    "results_in": (1.1, "support"), "sequences": (1.0, "background"), "contrasts_with": (0.9, "contrast"), "causes": (0.8, "support"),
    "parallels": (0.7, "context"), "evidences": (1.35, "support"), "exemplifies": (1.25, "support"), "purposes": (1.15, "support"),
    "justifies": (1.10, "support"), "summarizes": (1.05, "support"), "concedes": (0.85, "contrast"), "section_header_of": (0.6, "context"),
    "same_section": (0.5, "context"), "previous": (0.4, "context"), "next": (0.4, "context"), "same_parent_section": (0.3, "context"),
}
#: Nodes of one expansion at most, whatever the caller asks for.
EXPANSION_BUDGET = 20


def resolve_scope(channels: DataFrame, releases: DataFrame) -> DataFrame:
    """channel, release, issue: the one active release of each asked channel, or why there is none. releases: channel,
    release, status."""
    live = releases.where("status = 'active'").groupBy("channel").agg(F.count("*").alias("n"), F.min("release").alias("release"))
    n = F.coalesce("n", F.lit(0))
    issue = F.when(n == 0, "no_active_release").when(n > 1, "multiple_active_releases")
    return channels.join(live, "channel", "left").select("channel", F.when(n == 1, F.col("release")).alias("release"), issue.alias("issue"))


def active_scope(releases: DataFrame, builds: DataFrame, selections: DataFrame, documents: DataFrame) -> DataFrame:
    """channel, build, document, snapshot: what the active releases serve. releases: channel, build, status; builds: build;
    selections: build, document, snapshot, status; documents: document."""
    live = releases.where("status = 'active'").select("channel", "build").join(builds.select("build"), "build")
    chosen = selections.where("status = 'active'").select("build", "document", "snapshot")
    return live.join(chosen, "build").join(documents.select("document"), "document").select("channel", "build", "document", "snapshot")


def authorize(requested: DataFrame, bases: DataFrame, members: DataFrame) -> DataFrame:
    """user, base, role, allowed: owner, editor or viewer of each requested base; a public one may be read by anyone, an
    unknown one by nobody. requested: user, base; bases: base, owner, public; members: base, user, role."""
    d = requested.join(bases, "base", "left").join(members, ["base", "user"], "left")
    role = F.when(F.col("owner") == F.col("user"), "owner").when(F.col("role") == "editor", "editor").when(F.col("role").isNotNull() | F.col("public"), "viewer")
    return d.select("user", "base", role.alias("role"), role.isNotNull().alias("allowed"))


def hydrate(candidates: DataFrame, details: DataFrame, key: str = "unit_id", scope: DataFrame | None = None) -> DataFrame:
    """Candidates with the columns of details, and found: whether there were any. With a scope (snapshot), details of other
    snapshots count as absent."""
    own = details if scope is None else details.join(scope.select("snapshot").distinct(), "snapshot", "left_semi")
    return candidates.join(own.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def embedded_units(vectors: DataFrame, units: DataFrame, dimension: int) -> DataFrame:
    """Units with their embeddings of the dimension. vectors: unit_id, v; units: unit_id and more."""
    return vectors.where(F.size("v") == dimension).join(units, "unit_id")


def drill_down(refs: DataFrame, units: DataFrame, segments: DataFrame, radius: int = 1, most: int = 50) -> DataFrame:
    """request, document, segment_index, is_target, issue: the segments that a request's references stand for, with their
    neighbours. A reference is a segment or a unit, which stands for its segment; more than `most` of them are refused.
    refs: request, ref; units: ref, document, segment_index; segments: ref, document, segment_index."""
    many = refs.groupBy("request").agg(F.count_distinct("ref").alias("n"))
    refused = many.where(F.col("n") > most).select("request", F.lit(None).cast("string").alias("document"), F.lit(None).cast("int").alias("segment_index"), F.lit(None).cast("boolean").alias("is_target"), F.lit("too_many_refs").alias("issue"))
    fine = refs.join(many.where(F.col("n") <= most).select("request"), "request").distinct()
    known = units.select("ref", "document", "segment_index").unionByName(segments.select("ref", "document", "segment_index"))
    targets = fine.join(known, "ref").select("request", "document", F.col("segment_index").alias("at")).distinct()
    met = window_join(targets, segments.select("document", "segment_index"), ["document"], "at", "segment_index", radius)
    out = met.groupBy("request", "document", "segment_index").agg(F.max(F.col("at") == F.col("segment_index")).alias("is_target"))
    return out.select("request", F.col("document").cast("string").alias("document"), F.col("segment_index").cast("int").alias("segment_index"), "is_target", F.lit(None).cast("string").alias("issue")).unionByName(refused)


def expand_segments(seeds: DataFrame, relations: DataFrame, types: Sequence[str] | None = None, max_depth: int = 2, most: int = EXPANSION_BUDGET) -> DataFrame:
    """query_id, segment, depth, type, root: breadth first from each query's seeds along relations of either direction, no
    segment twice. In a step the relations of the highest priority (the order of types, if given) come first; a query
    ends when it has `most` segments. seeds: query_id, segment; relations: src, dst, type."""
    most = min(most, EXPANSION_BUDGET)
    order = {t: i for i, t in enumerate(types)} if types else PRIORITY
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("type")], F.lit(10**6))
    some = relations.where(F.col("type").isin(*types)) if types else relations
    step = both_directions(some.select("src", "dst", "type", rank.alias("p")), "src", "dst")
    visited = seeds.select("query_id", "segment").distinct()
    frontier = visited.withColumn("root", F.col("segment"))
    found = None
    for depth in range(1, max_depth + 1):
        met = frontier.withColumnRenamed("segment", "node").join(step, "node").select("query_id", F.col("other").alias("segment"), "root", "type", "p")
        met = met.join(visited, ["query_id", "segment"], "left_anti")
        first = met.groupBy("query_id", "segment").agg(F.min(F.struct("p", "type", "root")).alias("b")).select("query_id", "segment", "b.*")
        if found is not None:
            used = found.groupBy("query_id").agg(F.count("*").alias("used"))
            first = first.join(used, "query_id", "left")
        else:
            first = first.withColumn("used", F.lit(0))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("p", "segment"))
        new = first.withColumn("place", place + F.coalesce("used", F.lit(0))).where(F.col("place") <= most).select("query_id", "segment", F.lit(depth).alias("depth"), "type", "root")
        found = new if found is None else found.unionByName(new)
        visited = visited.unionByName(new.select("query_id", "segment"))
        frontier = new.select("query_id", "segment", "root")
    return found


def relation_items(kind: Column) -> tuple[Column, Column]:
    """Score and role of the item that a relation led to."""
    score, role = (F.create_map(*[F.lit(x) for k, v in RELATION_ITEMS.items() for x in (k, v[i])]) for i in (0, 1))
    return F.coalesce(score[kind], F.lit(0.3)), F.coalesce(role[kind], F.lit("background"))
