"""Incremental counts, committed sinks, resumed streams, reachability, containment and leases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.operators import containment, edge_upkeep, relational
from siltstone.sources import sink
from siltstone.streaming import ingest


def mentions(spark, rows):
    return spark.createDataFrame(sorted(rows), "segment int, entity string")


def counts_of(c):
    return sorted(map(tuple, c.entities.collect())), sorted(map(tuple, c.pairs.collect())), c.total.first().n


def test_changes_give_what_a_full_count_gives(spark):
    rng = random.Random(7)
    rows = {(rng.randrange(20), rng.choice("abcdefg")) for _ in range(60)}
    counts = edge_upkeep.count_all(mentions(spark, rows))
    for turn in range(3):
        m = mentions(spark, rows)
        said = [(rng.randrange(23), rng.choice("abcdefgh"), rng.choice([1, -1])) for _ in range(12)] + [(turn, e, -1) for e in "abcdefgh"]
        changes = spark.createDataFrame(said, "segment int, entity string, sign int")
        plus, minus = {(s, e) for s, e, x in said if x > 0}, {(s, e) for s, e, x in said if x < 0}
        after = (rows - minus) | plus
        counts, moved = edge_upkeep.apply_changes(counts, m, changes)
        assert {tuple(r) for r in edge_upkeep.changed_mentions(m, changes).collect()} == after
        assert counts_of(counts) == counts_of(edge_upkeep.count_all(mentions(spark, after)))
        net = lambda e: sum(x == e for _, x in after) - sum(x == e for _, x in rows)
        assert {e for e in "abcdefgh" if net(e)} <= {r.entity for r in moved.collect()}
        rows = after
        counts = edge_upkeep.GraphCounts(*(relational.settled(x) for x in (counts.entities, counts.pairs, counts.total)))


def test_merging_entities(spark):
    rows = {(1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "b"), (3, "c")}
    m = mentions(spark, rows)
    renamed = spark.createDataFrame([("a", "b"), ("c", "c")], "entity string, becomes string")
    new, moved = edge_upkeep.apply_changes(edge_upkeep.count_all(m), m, edge_upkeep.merges(m, renamed))
    assert counts_of(new) == ([("b", 3), ("c", 2)], [("b", "c", 2)], 3)
    assert {(r.head, r.tail) for r in edge_upkeep.strengths(new, moved).collect()} == {("b", "c")}


def test_a_write_that_is_repeated_counts_once(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(i, f"v{i}{s}") for i, s in x], "id int, v string")
    folder = f"file://{tmp_path}/store"
    assert sink.read_committed(spark, folder, "units") is None
    assert sink.commit({"units": rows((1, "a"), (2, "a")), "segments": rows((1, "s"))}, folder, "one", 1) == {"units": 2, "segments": 1}
    assert sink.commit({"units": rows((1, "a"), (2, "a"))}, folder, "one", 1) == {}
    rows((9, "lost")).withColumn("snapshot", F.lit("x")).withColumn("place", F.lit(9).cast("long")).write.parquet(f"{folder}/units/unfinished")
    # the second of two attempts that raced
    spark.read.parquet(f"{folder}/manifests").where("kind = 'units'").withColumn("attempt", F.lit("zzz")).write.mode("append").parquet(f"{folder}/manifests")
    assert sorted((r.id, r.v) for r in sink.read_committed(spark, folder, "units").collect()) == [(1, "v1a"), (2, "v2a")]
    sink.commit({"units": rows((2, "b"), (3, "b"))}, folder, "two", 2)
    assert sorted((r.id, r.v) for r in sink.read_latest(spark, folder, "units", ["id"]).collect()) == [(1, "v1a"), (2, "v2b"), (3, "v3b")]


def test_a_stream_goes_on_where_it_failed(spark, tmp_path):
    source, folder, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    schema = spark.createDataFrame([(1,)], "id int").schema
    spark.createDataFrame([(1,), (2,)], "id int").coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    sink.sink_stream(stream(), folder, state, lambda b: {"rows": b}).awaitTermination()
    spark.createDataFrame([(3,)], "id int").coalesce(1).write.mode("append").parquet(source)

    def half(batch):  # the first kind is committed when the second one fails
        sink.commit({"rows": batch}, folder, next(iter(name)), 1)
        raise RuntimeError("stop")

    import hashlib

    name = {f"{hashlib.md5(state.encode()).hexdigest()[:12]}-{1:09d}"}
    with pytest.raises(Exception, match="stop"):
        sink.sink_stream(stream(), folder, state, half).awaitTermination()
    for _ in range(2):
        sink.sink_stream(stream(), folder, state, lambda b: {"rows": b}).awaitTermination()
    assert sorted(r.id for r in sink.read_committed(spark, folder, "rows").collect()) == [1, 2, 3]


def test_reachability(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (9, 8)], "src int, dst int")
    seeds = spark.createDataFrame([(1,), (4,), (7,)], "seed int")
    got = sorted(map(tuple, relational.reachable(seeds, edges).collect()))
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (4, 4, 0), (7, 7, 0)]
    assert max(r.hop for r in relational.reachable(seeds, edges, 1).collect()) == 1


def test_ranks_between_cuts(spark):
    rng = random.Random(3)
    rows = [("a", 5.0, k) for k in range(300)] + [("a", rng.random() * 1e9, 1000 + k) for k in range(50)] + [("a", None, 2000 + k) for k in range(5)] + [("b", 1.0, 1), (None, 2.0, 2), (None, 2.0, 1)]
    d = spark.createDataFrame(rows, "k string, s double, i int")
    got = {(r.k, r.i): r["rank"] for r in relational.spread_rank(d, ["k"], "s", "i", bins=16, sample=100).collect()}
    want = {}
    for key in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want.update({(key, r[2]): n for n, r in enumerate(own, 1)})
    assert got == want


def test_texts_that_hold_passages(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "de", "x", "漢字"]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for k in range(60)] + [(100, None), (101, "one  two\tthree"), (102, "")]
    passages = [(k, t[a:b]) for k, (_, t) in enumerate(texts) if t for a, b in [sorted((rng.randint(0, len(t)), rng.randint(0, len(t))))] if t[a:b].strip()]
    passages += [(200, "pha be"), (201, "  "), (202, ""), (203, None), (204, "two\tth"), (205, "two th"), (206, "nowhere to be found at all"), (207, "lph")]
    got = containment.holders(spark.createDataFrame(passages, "item_id int, passage string"), spark.createDataFrame(texts, "unit_id int, text string"))
    want = sorted((i, u) for i, p in passages for u, t in texts if p and p.strip() and t and p in t)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 60
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_leases_run_out_by_event_time(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda m: start + timedelta(minutes=m)
    schema = "task long, at timestamp, claims boolean"
    batches = [[(1, at(0), True), (2, at(0), True), (2, at(3), False), (3, at(1), True), (3, at(4), True)], [(9, at(30), False)], [(1, at(31), True), (9, at(60), False)], [(9, at(90), False)]]
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    found = lambda: ingest.expiries(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "5 minutes", "10 minutes")
    for rows in batches:  # each a run of its own that goes on from the checkpoint
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        found().writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.task, r.expires_at) for r in spark.read.parquet(out).collect())
    assert got == [(1, at(5)), (1, at(36)), (3, at(9))]
