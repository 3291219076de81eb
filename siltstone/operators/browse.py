"""Reads of the knowledge tables: pages, latest rows, progress and counts.

Lists are pages in a full order; "latest" is decided by a maximum over a struct, which combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import best_of, page, top_per


def total_and_page(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page of rows, each with the total of all rows."""
    return page(rows, order, offset, limit).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


def scoped(rows: DataFrame, scope: DataFrame, *conditions: Column | None) -> DataFrame:
    """Rows of the snapshots in scope that meet the conditions that are given."""
    out = rows.join(scope.select("snapshot").distinct(), "snapshot", "left_semi")
    for c in conditions:
        out = out if c is None else out.where(c)
    return out


def latest(rows: DataFrame, keys: Sequence[str], by: Sequence[Column]) -> DataFrame:
    """For each key its last row, by columns that break ties; nulls count as the least."""
    return best_of(rows, keys, by, [c for c in rows.columns if c not in keys])


def relations_with_text(relations: DataFrame, segments: DataFrame, width: int = 120) -> DataFrame:
    """Relations with the beginnings of both ends' texts, null where an end is gone. relations: relation, src, dst, type;
    segments: segment, text."""
    ends = [segments.select(F.col("segment").alias(c), F.substring("text", 1, width).alias(f"{c}_text")) for c in ("src", "dst")]
    return relations.join(ends[0], "src", "left").join(ends[1], "dst", "left")


def run_documents(documents: DataFrame, events: DataFrame) -> DataFrame:
    """run, document, stage, status, duration_ms: each document with its latest stage and the time from its first event to
    its last. documents: run, document; events: run, document, stage, status, at (timestamp), seq."""
    last = F.max_by(F.struct("stage", "status"), F.struct("at", "seq")).alias("b")
    span = F.floor((F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / 1000).alias("duration_ms")
    return documents.join(events.groupBy("run", "document").agg(last, span).select("run", "document", "b.*", "duration_ms"), ["run", "document"], "left")


def document_status(documents: DataFrame, builds: DataFrame, runs: DataFrame) -> DataFrame:
    """document, status: published if an active build has it, else what its latest run says, else uploaded. builds:
    document, status; runs: document, status, run_no."""
    live = builds.where("status = 'active'").select("document").distinct().withColumn("__p", F.lit(True))
    last = best_of(runs, ["document"], [F.col("run_no")], ["status"]).withColumnRenamed("status", "__s")
    d = documents.select("document").join(live, "document", "left").join(last, "document", "left")
    return d.select("document", F.when(F.col("__p"), "published").otherwise(F.coalesce("__s", F.lit("uploaded"))).alias("status"))


def pending_mentions(mentions: DataFrame, documents: DataFrame, entities: DataFrame, segments: DataFrame, reach: int = 80) -> DataFrame:
    """Pending mentions of a run's documents, with what they may stand for and the text around them: up to `reach`
    characters on either side, empty where the segment or the mention in it is absent. mentions: mention, document,
    segment, text, entity, status; documents: run, document; entities: entity, canonical; segments: segment, body."""
    d = mentions.where("status = 'pending'").join(documents, "document").join(entities, "entity", "left").join(segments, "segment", "left")
    return d.select("run", "mention", "canonical", mention_window(F.col("body"), F.col("text"), reach).alias("quote"))


def mention_window(body: Column, text: Column, reach: int = 80) -> Column:
    at = F.position(text, body)
    start = F.greatest(at - reach, F.lit(1))
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(body, start, at - start + F.length(text) + reach)).otherwise("")


def quality_summary(units: DataFrame, relations: DataFrame) -> DataFrame:
    """build, questions, numbered, relations, warnings of each build: what its active snapshots hold. units: build,
    unit_type, title; relations: build, type, source."""
    u = units.groupBy("build").agg(F.count_if(F.col("unit_type") == "generated_question").alias("questions"), F.count_if((F.col("unit_type") == "generated_question") & F.col("title").startswith("Q")).alias("numbered"))
    r = relations.where("source = 'discourse_llm'").groupBy("build").agg(F.count("*").alias("relations"))
    d = u.join(r, "build", "left").withColumn("relations", F.coalesce("relations", F.lit(0)))
    said = [F.when(F.col("questions") == 0, "no questions"), F.when(F.col("numbered") > 0, "numbered questions"), F.when(F.col("relations") == 0, "no relations")]
    return d.withColumn("warnings", F.array_join(F.filter(F.array(*said), lambda x: x.isNotNull()), ","))


def quality_counts(units: DataFrame, relations: DataFrame) -> DataFrame:
    """build, kind (unit or relation), name, n: units of each type, and discourse relations of each type. units: build,
    unit_type; relations: build, type, source."""
    u = units.select("build", F.lit("unit").alias("kind"), F.col("unit_type").alias("name"))
    r = relations.where("source = 'discourse_llm'").select("build", F.lit("relation").alias("kind"), F.col("type").alias("name"))
    return u.unionByName(r).groupBy("build", "kind", "name").agg(F.count("*").alias("n"))


def first_of_each(rows: DataFrame, key: str, order: Sequence[Column], most: int) -> DataFrame:
    """The first rows of each key, with the key's total: a first page of every list at once. The totals combine and the pages are
    cut before the shuffle."""
    totals = rows.groupBy(key).agg(F.count("*").alias("total"))
    return top_per(rows, [key], order, most).join(totals, key)


def artifact_counts(owners: DataFrame, key: str, parts: Mapping[str, DataFrame]) -> DataFrame:
    """Owners (key) with a count of each kind of artifact that they have, zero if none. parts: frames with the key."""
    every = None
    for name, rows in parts.items():
        own = rows.select(key, F.lit(name).alias("__kind"))
        every = own if every is None else every.unionByName(own)
    counts = every.groupBy(key).agg(*[F.count_if(F.col("__kind") == n).alias(n) for n in parts])
    return owners.select(key).distinct().join(counts, key, "left").fillna(0, list(parts))


def active_links(links: DataFrame, now: Column) -> DataFrame:
    """document, link: each document's last link that is neither revoked nor over. links: document, link, expires_at, revoked,
    created_no."""
    live = links.where(~F.coalesce("revoked", F.lit(False)) & (F.col("expires_at") > now))
    return best_of(live, ["document"], [F.col("created_no")], ["link"])


def paradigm_of(domains: DataFrame, paradigms: DataFrame) -> DataFrame:
    """domain, paradigm: the domain's last published paradigm, else the last published default one; null without any. domains:
    domain; paradigms: paradigm, domain, status, is_default, version."""
    out = paradigms.where("status = 'published'")
    own = best_of(out.where("domain IS NOT NULL"), ["domain"], [F.col("version"), F.col("paradigm")], ["paradigm"])
    default = out.where("is_default").agg(F.max_by("paradigm", F.struct("version", "paradigm")).alias("__default"))
    d = domains.select("domain").distinct().join(own, "domain", "left").crossJoin(F.broadcast(default))  # one row
    return d.select("domain", F.coalesce("paradigm", "__default").alias("paradigm"))


def run_outcome(documents: DataFrame) -> DataFrame:
    """run, committed, failed, status: failed if no document is committed, partial if some failed. documents: run, status."""
    d = documents.groupBy("run").agg(F.count_if(F.col("status") == "committed").alias("committed"), F.count_if(F.col("status") == "failed").alias("failed"))
    return d.withColumn("status", F.when(F.col("committed") == 0, "failed").when(F.col("failed") > 0, "partial").otherwise("completed"))


def unshared(segments: DataFrame, snapshots: DataFrame, stored: DataFrame) -> DataFrame:
    """Segments that must be stored: one document's for each content hash that no stored snapshot has. segments: document
    and more; snapshots: document, hash; stored: hash."""
    first = snapshots.join(stored.select("hash").distinct(), "hash", "left_anti").groupBy("hash").agg(F.min("document").alias("document"))
    return segments.join(first.select("document"), "document", "left_semi")


def adopt_orphans(documents: DataFrame, default_base: str) -> DataFrame:
    """Documents without a base get the domain's default one. documents: document, domain, base."""
    return documents.withColumn("base", F.coalesce("base", F.concat(F.lit(default_base + ":"), "domain")))
