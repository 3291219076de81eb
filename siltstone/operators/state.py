"""Versioned state: classification of documents, builds, releases, withdrawal, preflight.

State is append-only tables; a change is a new version of the rows, written by one writer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import first_per, tasks_for, upsert


def classify(previous: DataFrame, current: DataFrame) -> DataFrame:
    """document, action: NEW, UPDATE, SKIP or REMOVE against the previous active build; both: document, hash."""
    d = previous.select("document", F.col("hash").alias("old")).join(current.select("document", F.col("hash").alias("new")), "document", "full_outer")
    action = F.when(F.col("old").isNull(), "NEW").when(F.col("new").isNull(), "REMOVE").when(F.col("old") == F.col("new"), "SKIP").otherwise("UPDATE")
    return d.select("document", action.alias("action"))


def lifecycle(current: DataFrame, active: DataFrame, history: DataFrame) -> DataFrame:
    """document, action: SKIP if the active hash is the same, RESTORE if the hash was there before, UPDATE if another
    one is active, else NEW."""
    seen = history.select("document", "hash").distinct().withColumn("seen", F.lit(True))
    d = current.join(active.select("document", F.col("hash").alias("active")), "document", "left").join(seen, ["document", "hash"], "left")
    action = F.when(F.col("active") == F.col("hash"), "SKIP").when(F.col("seen"), "RESTORE").when(F.col("active").isNotNull(), "UPDATE").otherwise("NEW")
    return d.select("document", action.alias("action"))


def assemble_build(parent: DataFrame, decisions: DataFrame) -> DataFrame:
    """The parent's selections that no decision touches, and the decisions that select; both: document, snapshot,
    status."""
    return upsert(parent, decisions, "document")


def build_problems(selections: DataFrame, segments: DataFrame) -> DataFrame:
    """Active selections whose snapshot has no segments; a valid build has none."""
    return selections.where("status = 'active'").join(segments.select("snapshot").distinct(), "snapshot", "left_anti")


def invalid_builds(builds: DataFrame, selections: DataFrame, segments: DataFrame) -> DataFrame:
    """build, problem, snapshot of everything that keeps a build from being published: missing_parent of an incremental one,
    no_active (a withdrawal may be empty), and no_segments of an active snapshot. builds: build, mode, parent, operation;
    selections: build, snapshot, status; segments: snapshot."""
    tasks = tasks_for(builds, selections, segments)
    every, active = builds.repartition(tasks, "build"), selections.where("status = 'active'").repartition(tasks, "build")
    parents = builds.select(F.col("build").alias("parent")).repartition(tasks, "parent")
    orphan = builds.where("mode = 'incremental' AND parent IS NOT NULL").repartition(tasks, "parent").join(parents, "parent", "left_anti")
    empty = every.where("coalesce(operation, '') <> 'withdrawal'").join(active.select("build"), "build", "left_anti")
    known = active.join(every.select("build"), "build", "left_semi")
    bare = known.repartition(tasks, "snapshot").join(segments.select("snapshot").repartition(tasks, "snapshot"), "snapshot", "left_anti")
    none = F.lit(None).cast(dict(selections.dtypes)["snapshot"]).alias("snapshot")
    one = lambda d, name, s=none: d.select("build", F.lit(name).alias("problem"), s)
    return one(orphan, "missing_parent").unionByName(one(empty, "no_active")).unionByName(one(bare, "no_segments", F.col("snapshot")))


def publish(releases: DataFrame, build: str, channel: str, at: str) -> DataFrame:
    """The channel's active release retired, the new one active: exactly one is active per channel."""
    old = releases.withColumn("status", F.when((F.col("channel") == channel) & (F.col("status") == "active"), "retired").otherwise(F.col("status")))
    new = releases.sparkSession.createDataFrame([(build, channel, "active", at)], releases.schema)
    return old.unionByName(new)


def withdraw(selections: DataFrame, targets: DataFrame) -> DataFrame:
    """A copy of the build with the target documents removed."""
    t = targets.select("document").distinct().withColumn("__t", F.lit(True))
    return selections.join(t, "document", "left").withColumn("status", F.when(F.col("__t"), "removed").otherwise(F.col("status"))).drop("__t")


def latest_selections(builds: DataFrame) -> DataFrame:
    """The last build's selection of each document; removed ones go after that."""
    return first_per(builds, ["document"], [F.desc("build_no")]).where("status <> 'removed'")


#: What is done by default with a document of each class.
DEFAULT_ACTION = {
    "NEW": "NEW", "REUSED": "REUSED", "IN_PROGRESS": "JOINED_EXISTING", "RESTORABLE": "RESTORED",
    "RESTORABLE_CONFLICT": "KEPT_CURRENT", "WORKFLOW_CONFLICT": "KEPT_CURRENT", "HISTORY_UNAVAILABLE": "REMINED",
}


def preflight(requested: DataFrame, snapshots: DataFrame, running: DataFrame, workflow: str) -> DataFrame:
    """document, classification, default_action of each requested (document, hash) against snapshots (hash, workflow,
    active, complete) and running (hash, workflow); workflow names id, version and graph.

    A complete active snapshot of this workflow is reused, before any running job counts; then a running job of this
    workflow; then complete history of it, which an active snapshot of another kind opposes; then that active snapshot;
    then any row at all."""
    same = F.col("workflow") == workflow
    flags = {"exact": same & F.col("active") & F.col("complete"), "current": F.col("active"), "past": same & ~F.col("active") & F.col("complete")}
    s = snapshots.groupBy("hash").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(k) for k, c in flags.items()], F.lit(True).alias("any"))
    r = running.where(same).select("hash").distinct().withColumn("run", F.lit(True))
    d = requested.join(s, "hash", "left").join(r, "hash", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = (
        F.when(yes("exact"), "REUSED").when(yes("run"), "IN_PROGRESS").when(yes("past") & ~yes("current"), "RESTORABLE").when(yes("past"), "RESTORABLE_CONFLICT")
        .when(yes("current"), "WORKFLOW_CONFLICT").when(yes("any"), "HISTORY_UNAVAILABLE").otherwise("NEW")
    )
    action = F.create_map(*[F.lit(x) for kv in DEFAULT_ACTION.items() for x in kv])
    return d.select("document", kind.alias("classification")).withColumn("default_action", action[F.col("classification")])


def move_subtree(folders: DataFrame, old: str, new: str) -> DataFrame:
    """Paths at or below old, rewritten below new."""
    inside = (F.col("path") == old) | F.col("path").startswith(old + "/")
    return folders.withColumn("path", F.when(inside, F.concat(F.lit(new), F.expr(f"substr(path, {len(old) + 1})"))).otherwise(F.col("path")))
