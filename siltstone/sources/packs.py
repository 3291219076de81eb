"""Domain packs: a domain's rules as data, read from JSON text.

A pack is small configuration that a user writes; it becomes DataFrames with stated columns, so that operators take it
like any other table. Absent parts are empty tables; rules with a pattern that is no regular expression are refused.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import bounded

PARTS = {
    "entity_rules": "type string, pattern string",
    "relation_rules": "relation_type string, head_type string, tail_type string",
    "semantic_roles": "role string",
    "routes": "intent string, source string, weight double, top_k int",
    "questions": "id string, question string, expected string",
}


def load_pack(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """The pack's parts by name, with the columns of PARTS; missing fields are null."""
    pack = json.loads(text or "{}")
    for r in pack.get("entity_rules", []):
        re.compile(r["pattern"])
    out = {}
    for name, ddl in PARTS.items():
        fields = [(f.split()[0], float if f.split()[1] == "double" else int if f.split()[1] == "int" else str) for f in ddl.split(", ")]
        rows = [tuple(None if r.get(f) is None else kind(r[f]) for f, kind in fields) for r in pack.get(name, [])]
        out[name] = spark.createDataFrame(rows, ddl)
    return out


def rule_entities(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """id, type, name, hits: what the rules find in the texts (id, text), each name once for its type. The rules are few
    and go to every task."""
    met = texts.join(bounded(rules.select("type", "pattern")))
    names = met.select("id", "type", F.explode(F.expr("regexp_extract_all(text, pattern, 0)")).alias("name"))
    return names.where("name <> ''").groupBy("id", "type", "name").agg(F.count("*").alias("hits"))
