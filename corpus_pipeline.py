"""A corpus pipeline over the documents table: five stages, each one of the training-data operators.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns the rows that the next one works on, with
the columns of documents; the last one returns the packing plan. A changed text brings n_chars up to date. Rows without
doc_id are left out by the first stage; rows that repeat a doc_id are documents of their own text, and of those that are
near duplicates of each other the near-duplicate stage keeps one. Null and empty texts, and texts without words, are what the
operators say they are: the base quality rule rejects them, and the later stages leave them as they are, one for each doc_id;
ties are broken by doc_id, text and then the other columns in their order; a very long text is one value in one task, whole, in
every stage; an empty table stays empty. Other columns may have any names and types: a name that a stage uses itself is set
aside while it works, and columns that have no order (maps) are compared as JSON.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, small_batches, split_by_ids, workspace
from siltstone.llm.lines import MIN_POINTS, kept_lines, repeated_lines, with_lost
from siltstone.llm.ngram_join import set_id, shingle_set, similar_sets
from siltstone.llm.packing import pack_documents
from siltstone.llm.pii import redacted
from siltstone.llm.quality import train, verdicts


def _with_text(docs: DataFrame, text) -> DataFrame:
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that fail the base rule or the fitted model go."""
    small_batches(spark)
    forest = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(F.col("doc_id").isNotNull() & verdicts(spark, forest)(F.coalesce(F.col("text"), F.lit(""))))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: repeated lines go, but for those of the largest doc_id."""
    aside = {c: _free(f"own_{k}", docs.columns) for k, c in enumerate(docs.columns) if c.lower() == "lost"}  # the operator's own name
    every = with_lost(docs.withColumnsRenamed(aside), repeated_lines(docs))

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series, lost: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or gone is None else kept_lines(t, gone, MIN_POINTS) for t, gone in zip(texts, lost)], dtype=object)

    out = _with_text(every, F.when(F.col("lost").isNull(), F.col("text")).otherwise(rewrite("text", "lost"))).drop("lost")
    return out.withColumnsRenamed({v: k for k, v in aside.items()})


def _free(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def _ordered(docs: DataFrame) -> list:
    """The columns of row, a struct of a document's, that break ties after its text; those without an order as JSON."""
    fields = [(F.col("row")[c], c, t) for c, t in docs.dtypes if c not in ("doc_id", "text")]
    return [F.to_json(F.struct(x.alias("x"))) if "map<" in t or "variant" in t else x for x, _, t in fields]


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each class of near duplicates one row stays: by doc_id, then set, then text and the other columns.
    Empty sets are one class for each doc_id. A document that is the only row of its doc_id and stays is not moved."""
    small_batches(spark)
    rows = materialize(similar_sets(docs)[0], workspace(spark) + "/classes")
    alone = F.col("root").isNull()
    least = rows.where("doc_id = component_id").groupBy("doc_id", "root", F.when(alone, F.col("n")), F.when(alone, F.col("id"))).agg(F.min(F.struct("n", "id")).alias("__set"))
    stays = materialize(least.select("doc_id", "__set.n", "__set.id").toDF("doc_id", "__n", "__id"), workspace(spark) + "/stays")
    plain = rows.groupBy("doc_id").agg(F.count("*").alias("c")).where("c = 1").join(stays, "doc_id", "left_semi")
    doubtful = rows.select("doc_id").distinct().join(plain, "doc_id", "left_anti")
    touched, others = split_by_ids(docs.where(F.col("doc_id").isNotNull()), doubtful)

    @F.pandas_udf("n int, id long")
    def name(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t) for t in texts]
        return pd.DataFrame({"n": pd.Series([len(g) for g in sets], dtype="int32"), "id": pd.Series([set_id(g) for g in sets], dtype="int64")})

    names = [F.col(f"`{c}`") for c in docs.columns]
    packed = touched.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(*names).alias("row"))
    some = packed.join(stays.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    named = some.withColumn("set", name("text")).select("doc_id", "row", F.col("set.n").alias("__n"), F.col("set.id").alias("__id"))
    first = F.row_number().over(Window.partitionBy("doc_id", "__n", "__id").orderBy(F.col("row")["text"], *_ordered(docs)))
    kept = named.join(stays.hint("merge"), ["doc_id", "__n", "__id"], "left_semi").withColumn("first", first)
    return kept.where("first = 1").select("row.*").unionByName(others.select(*names))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: personal data is replaced by its kind."""
    small_batches(spark)
    return _with_text(docs, redacted(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: buckets and batches."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("PII", pii_stage),
    ("packing", packing_stage),
]

#: The quality model and the added PII spans aren't SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = workspace(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):  # written and read again, so that every later evaluation sees the same rows
            docs = materialize(docs, f"{folder}/stage-{k}")
    return docs
