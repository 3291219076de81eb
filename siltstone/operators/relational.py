"""Relational shapes that the knowledge tables need more than once."""

from __future__ import annotations

import functools
import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows, and bytes of their values, of a frame that is sent to every executor at most.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20
#: Narrow rows that one task sorts.
TASK_ROWS = 1_000_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Has df at most so many rows, of at most so many bytes? Counting stops beyond the rows."""
    sizes = [F.coalesce(F.length(F.to_json(F.struct(c)) if "<" in t else F.col(c).cast("string")), F.lit(0)) for c, t in ((f"`{c}`", t) for c, t in df.dtypes)]
    n, size = df.limit(rows + 1).agg(F.count("*"), F.sum(functools.reduce(lambda x, y: x + y, sizes))).first()
    return n <= rows and (size or 0) <= most_bytes


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is small; a larger one is left to the optimizer."""
    return F.broadcast(df) if is_small(df, most) else df


def tasks_for(*frames: DataFrame, rows: int = TASK_ROWS) -> int:
    """Into how many tasks to deal frames of narrow rows that meet, so that each gets about so many. The rows are counted, since
    the optimizer merges pieces of a shuffle by their bytes, and narrow rows, which compress well, take many times that when
    they are sorted."""
    return max(1, -(-sum(df.count() for df in frames) // rows))


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the cluster's checkpoint folder, so that later steps neither compute it again nor lose it
    with an executor. A session on this machine alone may do without that folder; on a cluster its absence is an error."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="siltstone-"))
    return df.checkpoint()


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in the given order (which must break ties). A hot key costs a sort of its rows
    in one task; where only a few columns are needed, best_of() combines before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key; up to a k of 1,000 tasks cut their own lists before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def spread_rank(df: DataFrame, keys: Sequence[str], score: str, tie: str, bins: int = 128, sample: int = 100_000) -> DataFrame:
    """Adds rank within keys, from 1: greatest score first (null last), then by tie, as a window over keys would; but no
    group is one task's. Rows are dealt to bins between cuts, ranked in their bin, and moved by the rows of the bins before
    it. Cuts are places in the order of (score, tie) in a sample of about `sample` rows, drawn by hash, so that bins fill
    evenly whatever the scores are, equal ones too, and every evaluation deals alike."""
    every = df.count()
    place = [F.when(F.col(score).isNull(), 1).otherwise(0).alias("absent"), (-F.coalesce(F.col(score).cast("double"), F.lit(0.0))).alias("score"), F.col(tie).alias("tie")]
    drawn = F.pmod(F.xxhash64(*keys, score, tie), F.lit(1 << 30)) < int(min(1.0, sample / max(1, every)) * (1 << 30))
    some = df.where(drawn).select(*keys, F.struct(*place).alias("__at"))
    ordered = Window.partitionBy(*keys).orderBy("__at")
    placed = some.withColumn("__r", F.row_number().over(ordered)).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    step = F.greatest(F.lit(1), F.ceil(F.col("__n") / bins))
    cuts = placed.where(F.col("__r") % step == 0).groupBy(*keys).agg(F.array_sort(F.collect_list("__at")).alias("__cuts"))  # bins a group at most
    all_of = lambda cs: functools.reduce(lambda x, y: x & y, cs)
    met = [F.col(f"__l.{k}").eqNullSafe(F.col(f"__r.{k}")) for k in keys]
    at = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__at"))), F.lit(0))
    dealt = df.withColumn("__at", F.struct(*place)).alias("__l").join(cuts.alias("__r"), all_of(met), "left").select("__l.*", F.when(F.col("__cuts").isNull(), 0).otherwise(at).alias("__bin"))
    before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*keys, "__bin").count().select(*keys, "__bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__bin").orderBy(F.desc_nulls_last(score), tie))
    ranked = dealt.withColumn("rank", inside).alias("__l").join(offsets.alias("__r"), all_of([*met, F.col("__l.__bin") == F.col("__r.__bin")]))
    return ranked.select(*[F.col(f"__l.{c}") for c in df.columns], (F.col("__l.rank") + F.col("__r.__offset")).alias("rank"))


def best_of(df: DataFrame, keys: Sequence[str], by: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """For each key the values of the row with the greatest `by`; partial results combine before the shuffle."""
    best = F.max_by(F.struct(*values), F.struct(*[b.alias(f"o{i}") for i, b in enumerate(by)]))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")


def latest_join(left: DataFrame, right: DataFrame, key: str, order: Sequence[Column], how: str = "left") -> DataFrame:
    """Each left row with the first right row of its key, as a lateral join with a limit of one would give."""
    return left.join(first_per(right, [key], order), key, how)


def exists_flag(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """Left rows with a boolean: does right have the key?"""
    return left.join(right.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def both_directions(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge from either end, so that joins on 'either end' are equi-joins."""
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.select(F.col(a).alias("node"), F.col(b).alias("other"), *rest).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"), *rest))


def window_join(targets: DataFrame, rows: DataFrame, keys: Sequence[str], at: str, position: str, radius: int) -> DataFrame:
    """Rows whose position is within radius of a target's, by equal keys. Positions are dealt to bins of the window's
    width, so that the join has one more equal key and a long sequence is not one group."""
    width = 2 * radius + 1
    reach = targets.withColumn("__bin", F.explode(F.sequence(F.floor((F.col(at) - radius) / width), F.floor((F.col(at) + radius) / width))))
    dealt = rows.withColumn("__bin", F.floor(F.col(position) / width))
    return reach.join(dealt, [*keys, "__bin"]).where(F.abs(F.col(position) - F.col(at)) <= radius).drop("__bin")


def latest_not_after(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, event: str, bins: int = 64) -> DataFrame:
    """As-of join: each left row with the last right row of its keys whose event time is not after the left time.

    Both sides go through one window over the union, ordered by time; no pair is formed. Times are cut into bins at their
    approximate quantiles, so a key's whole history is not one group: a window sees a key's bin, and rows before the bin's first
    event take the last event of the bins before, of which there is one row a bin."""
    values = [c for c in right.columns if c not in keys and c != event]
    l = left.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*[c for c in left.columns if c not in keys]).alias("__l"), F.lit(None).cast(right.select(F.struct(event, *values).alias("s")).schema["s"].dataType).alias("__r"))
    r = right.select(*keys, F.col(event).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), F.struct(event, *values).alias("__r"))
    every = l.unionByName(r)
    cuts = every.agg(F.percentile_approx("__t", [k / bins for k in range(1, bins)], 1_000)).first()[0]
    kind = every.schema["__t"].dataType
    # a sum, not a lambda: in one the optimizer doesn't see the column and fails when it carries the bin through the union
    after = [F.when(F.lit(c).cast(kind) < F.col("__t"), 1).otherwise(0) for c in sorted(set(cuts or []))]
    placed = every.withColumn("__bin", functools.reduce(lambda x, y: x + y, after, F.lit(0)))
    w = Window.partitionBy(*keys, "__bin").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    lasts = placed.groupBy(*keys, "__bin").agg(F.max_by("__r", F.when(F.col("__side") == 0, F.col("__t"))).alias("__last"))
    before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.withColumn("__carried", F.last("__last", ignorenulls=True).over(before)).drop("__last").where("__carried IS NOT NULL")
    same = functools.reduce(lambda x, y: x & y, [F.col(f"__a.{k}").eqNullSafe(F.col(f"__b.{k}")) for k in keys] + [F.col("__a.__bin") == F.col("__b.__bin")])
    met = own.alias("__a").join(carried.alias("__b"), same, "left").select(*[F.col(f"__a.{k}").alias(k) for k in keys], "__l", F.coalesce("__r", "__carried").alias("__r"))
    return met.select(*keys, "__l.*", F.col(f"__r.{event}").alias(event), *[F.col(f"__r.{v}").alias(v) for v in values])


def contained_pairs(names: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """outer, inner, after the columns of within: distinct names (name), of equal ones of these, of which the outer one contains
    the other, which isn't empty. Names meet where the beginning of the inner one, up to three characters, is a piece of the
    outer one."""
    n = names.where("name <> ''").select(*within, "name").distinct()
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.array(*[F.substring("name", i, F.lit(k)) for k in (1, 2, 3)])))
    outer = n.select(*within, F.col("name").alias("outer"), F.explode(F.array_distinct(pieces)).alias("piece"))
    inner = n.select(*within, F.col("name").alias("inner"), F.substring("name", 1, 3).alias("piece"))
    return outer.join(inner, [*within, "piece"]).where((F.col("outer") != F.col("inner")) & F.contains(F.col("outer"), F.col("inner"))).select(*within, "outer", "inner")


def reachable(seeds: DataFrame, edges: DataFrame, most_hops: int | None = None) -> DataFrame:
    """seed, node, hop: all nodes that directed edges (src, dst) lead to from each seed (seed), itself at hop 0, with the least
    number of edges. Each turn goes on from the nodes met in the one before and ends when there are none, whatever cycles
    there are; what is known is kept in the checkpoint folder, so a turn costs its own joins only. These are merged: to the
    optimizer each turn's rows are few enough to be sent to every task, but the turns add up at the driver."""
    e = settled(edges.select("src", "dst").where("src <> dst").distinct()).hint("merge")
    first = settled(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop")).distinct())
    known, frontier, hop = first, first, 0
    while not frontier.isEmpty() and (most_hops is None or hop < most_hops):
        hop += 1
        step = frontier.select("seed", F.col("node").alias("src")).join(e, "src").select("seed", F.col("dst").alias("node")).distinct()
        frontier = settled(step.join(known.select("seed", "node").hint("merge"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        known = known.unionByName(frontier)
    return known


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and rows of old whose key new hasn't."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
