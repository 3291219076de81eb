"""What must not grow with the input: frames sent through the driver, repeated work, lists held by one task."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siltstone import catalog
from siltstone.functions import text as T
from siltstone.operators import containment, relational, sparse
from siltstone.queries import load

from .conftest import SF

load()


def final_plan(df):
    """The plan that has run, after adaptive changes."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_fingerprints_are_not_broadcast(spark):
    plan = final_plan(catalog.QUERIES["x05_near_fingerprints"](spark, SF))
    assert "Broadcast" not in plan and "_simhash" not in plan  # fingerprints are computed once, before the join


def test_near_choice_is_the_first_shared_key(spark):
    pairs = [(0, 7), (5, 5), (-1, (1 << 63) - 2), (0, (1 << 63) - 1), (3, 3 ^ (1 << 20) ^ (1 << 40) ^ (1 << 62))]
    d = spark.createDataFrame(pairs, "a long, b long")
    shared = F.array_min(F.transform(F.array_intersect(T.near_keys(F.col("a")), T.near_keys(F.col("b"))), lambda k: k["choice"]))
    for r in d.select(shared.alias("want"), T.near_choice(F.col("a"), F.col("b")).alias("got")).collect():
        assert r.got == r.want


def test_turns_of_a_fixpoint_are_not_broadcast(spark):
    seeds, edges = spark.range(3).withColumnRenamed("id", "seed"), spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")
    seen = spark._jvm.java.util.ArrayList()
    settled = relational.settled
    relational.settled = lambda df: (seen.add(df._jdf.queryExecution().sparkPlan().toString()), settled(df))[1]
    try:
        assert relational.reachable(seeds, edges).count() == 9
    finally:
        relational.settled = settled
    turns = list(seen)[2:]
    assert turns and all(p.count("SortMergeJoin") == 2 and "Broadcast" not in p for p in turns)


def test_units_with_all_terms_are_found_where_they_are_read(spark):
    q = spark.createDataFrame([(1, ["a1", "b2"]), (2, ["b2"]), (3, [])], "query_id long, terms array<string>")
    u = spark.createDataFrame([(7, "A1 b2 b2"), (8, "b2 c3"), (9, None), (10, "a1b2")], "unit_id long, text string")
    found = sparse.holding_all(q, u, sparse.tokens)
    assert sorted(map(tuple, found.collect())) == [(1, 7), (2, 7), (2, 8)]
    plan = catalog.QUERIES["e2_first_rank"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan  # no word of a document is a row


def test_documents_and_groups_have_no_frames_of_their_own(spark):
    plans = {n: catalog.QUERIES[n](spark, SF)._jdf.queryExecution().sparkPlan().toString() for n in ("p08_docx", "u08_all_units")}
    assert "MapInArrow" in plans["p08_docx"] and "MapInPandas" not in plans["p08_docx"]
    assert "FlatMapGroupsInArrow" in plans["u08_all_units"] and "FlatMapGroupsInPandas" not in plans["u08_all_units"]


def test_builds_are_dealt_by_their_rows(spark, monkeypatch):
    """Tasks that check builds are as many as their rows ask for, whatever bytes a shuffle has."""
    monkeypatch.setattr(relational.tasks_for, "__kwdefaults__", {"rows": 1_000})
    plan = catalog.QUERIES["d06_invalid_builds"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("RepartitionByExpression") + plan.count("REPARTITION_BY_NUM") >= 6 and "HashAggregate" not in plan


def test_few_passages_are_found_where_texts_are_read(spark):
    p = spark.createDataFrame([(1, "the Blue ring  lies here"), (2, "x y"), (3, "a BΣ c"), (4, "")], "item_id long, passage string")
    u = spark.createDataFrame([(7, "see the Blue ring  lies hereby"), (8, "the blue ring  lies here"), (9, None), (10, "xx y, aa BΣ cc"), (11, "here lies Blue ring")], "unit_id long, text string")
    assert sorted(map(tuple, containment.holders(p, u).select("item_id", "unit_id").collect())) == [(1, 7), (2, 10), (3, 10)]
    plan = catalog.QUERIES["e2_containing_documents"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "xxhash64" not in plan  # no run of a text is a row


def test_many_passages_are_found_by_one_key_of_all_their_words(spark, monkeypatch):
    """Not by all runs of all texts; small chunks and a full filter lose nothing."""
    rng = random.Random(8)
    words, blanks = ["alpha", "beta", "gamma", "de", "x", "漢字", "é"], [" ", " ", "  ", "\t", "\n"]
    texts = [(k, "".join(rng.choice(words) + rng.choice(blanks) for _ in range(rng.randint(0, 60)))) for k in range(80)]
    texts += [(100, None), (101, "one  two\tthree four"), (102, ""), (103, " "), (104, "x " * 200), (105, texts[7][1])]
    passages = [(k, t[a:b]) for k, (_, t) in enumerate(texts) if t for a, b in [sorted((rng.randint(0, len(t)), rng.randint(0, len(t))))]]
    passages += [(200, "pha be"), (201, "  "), (202, ""), (203, None), (204, "ne  two\tth"), (205, "ne two th"), (206, "nowhere to be found at all"), (207, "x " * 150), (208, texts[7][1]), (209, texts[7][1])]
    want = sorted((i, u) for i, p in passages for u, t in texts if p and p.strip() and t and p in t)
    p, u = spark.createDataFrame(passages, "item_id int, passage string"), spark.createDataFrame(texts, "unit_id int, text string")
    monkeypatch.setattr(containment, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, containment.holders(p, u).collect())) == want and len(want) > 150
    plan = catalog.QUERIES["e2_quoted_turns"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "xxhash64" not in plan  # no run of a text is a row
    # chunks of a text or a few, and a filter that lets everything through: all runs of the sizes, once each
    monkeypatch.setattr(containment, "CHUNK", 50)
    monkeypatch.setattr(containment, "RUNS", 10)
    some = [t for _, t in texts if t is not None]
    found, sizes = [], {0: np.array([1]), 1: np.array([2, 3])}
    for a, _, words in containment._chunks(pa.array(some)):
        for at, n, _ in containment._runs_of(words, sizes, np.full(8, 255, np.uint8)):
            t = words.text[at]
            found += zip((a + t).tolist(), (at - words.first[t]).tolist(), n.tolist())
    assert sorted(found) == [(t, a, n) for t, x in enumerate(some) for a in range(len(x.split())) for n in (1, 2, 3) if a + n <= len(x.split())]
