"""The pipeline against the operators' plain versions, and the registry."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import pii, quality
from siltstone.llm.registry import oracle_sql, queries

from .conftest import make_docs
from .test_operators import components, plain_lines


def test_stages(spark, odd_rows, tmp_path):
    rows = [(i, t) for i, t in odd_rows] + [(800 + k, " ".join(f"u{(k * 5 + j * j) % 83}" for j in range(90)) + f" mail x{k}@mail.example.com") for k in range(12)]
    docs = make_docs(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(10, 1, 0), (60, 1, 0), (83, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(now)
    assert all(s.columns == docs.columns for s in seen[:-1])
    text = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    kept = {(r.doc_id) for r in quality.quality_rules(docs, labels).where("kept").collect()}
    first = sorted((i, t) for i, t in rows if i in kept)
    assert text(seen[0]) == first and {800, 811} <= kept and 83 not in kept
    second = [(i, t) for i, t, _, _ in plain_lines(first)]
    assert text(seen[1]) == second
    stays = {i for i, _, c in components(second) if i == c}
    third = sorted({(i, t) for i, t in second if i in stays})
    assert text(seen[2]) == third
    model = pii.train(seen[2])
    fourth = [(i, pii.redact(t, pii.find(t, model)[1])) for i, t in third]
    assert text(seen[3]) == fourth and "[EMAIL]" in dict(fourth)[800]
    assert seen[3].where(F.length("text") != F.col("n_chars")).count() == 0
    assert sorted((r.doc_id, r.n_tokens) for r in seen[4].collect()) == [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t))) for i, t in fourth]
    assert sorted(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()) == sorted(seen[4].select("doc_id").collect())


def test_near_duplicates_of_repeated_ids(spark):
    text = lambda s: " ".join(f"{s}{k}" for k in range(120))
    a, b, c = text("a"), text("b"), text("c")
    rows = [(5, a), (5, b), (5, a + " z"), (6, b + " y"), (7, c), (7, c), (8, ""), (8, ""), (9, None)]
    got = corpus_pipeline.near_duplicate_stage(spark, make_docs(spark, rows), "")
    assert got.columns == make_docs(spark, rows).columns
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.text) == [(5, a), (5, b), (7, c)]
    assert sorted(r.doc_id for r in got.collect() if not r.text) == [8, 9]


def test_stages_of_empty_and_odd_tables(spark, tmp_path):
    """No rows; rows of null and empty texts only; a column with the name of one of the stages' own."""
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in ([], [(1, None), (1, None), (2, ""), (None, "x")]):
        docs = make_docs(spark, rows).withColumn("lost", F.lit("own"))
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, docs, str(tmp_path))
            assert name == "packing" or out.columns == docs.columns
            if name == "line dedup":
                assert out.where("lost = 'own'").count() == len(rows)
            assert len({r.doc_id for r in out.collect()} - {None}) == min(2, len(rows))
        assert corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).count() == 0


def test_stages_with_clashing_and_unorderable_columns(spark, tmp_path):
    """Names that stages use themselves, a map, and a name with a dot; rows that tie in all but the map."""
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text = " ".join(f"w{k * k % 97}" for k in range(120))
    rows = [(i, t, "en", "s", None, 1, 2, 3, 4, "own", "x", {"a": i}, "r", "d") for i, t in ((1, text), (1, text), (2, text + " z"), (3, None))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __n int, __id long, __first int, n int, LOST string, `set` string, m map<string,int>, row string, `a.b` string")
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, str(tmp_path)).collect()
        if name != "packing":
            assert all(r.LOST == "own" and r["__n"] == 1 and r["a.b"] == "d" and r.m["a"] == r.doc_id for r in out)
        assert sorted(r.doc_id for r in out) == ([1, 3] if name == "n-gram Jaccard join" else [1, 1, 2, 3])


def test_stages_with_very_long_texts(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    long = " ".join(f"word{k * 7919 % 50_021}" for k in range(60_000))
    docs = make_docs(spark, [(1, long), (2, long + " end"), (3, "漢字" * 50_000), (4, "x y\n" * 20_000)])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).collect()
        if name == "n-gram Jaccard join":
            assert sorted((r.doc_id, len(r.text)) for r in out) == [(1, len(long)), (3, 100_000), (4, 80_000)]
        elif name in ("line dedup", "PII"):
            assert sorted(r.doc_id for r in out) == [1, 2, 3, 4]


def test_registry():
    names = sorted(queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(oracle_sql()) <= set(names)
