"""Topics of an extracted help archive in the order of its table of contents."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

ENTRY = ArrayType(StructType([StructField("place", IntegerType()), StructField("depth", IntegerType()), StructField("title", StringType()), StructField("local", StringType())]))


_OBJECT, _PARAM = re.compile(r"(?i)<object\b([^>]*)>"), re.compile(r"(?i)<param\b((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>")
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_LIST, _END = re.compile(r"(?i)<(/?)ul\b"), re.compile(r"(?i)</object\s*>")


def attributes(tag: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(tag)}


def contents(text: str) -> list[tuple[int, str, str]]:
    """(depth, title, local) of every entry with both a title and a place, in order. An entry is what stands in an object of the
    site map; its depth is the number of lists open before the object's end."""
    out, depth = [], 0
    for part in _END.split(text)[:-1]:
        for closes in _LIST.findall(part):
            depth = max(0, depth - 1) if closes else depth + 1
        objects = list(_OBJECT.finditer(part))
        if objects and attributes(objects[-1][1]).get("type", "").lower() == "text/sitemap":
            params = [attributes(m[1]) for m in _PARAM.finditer(part, objects[-1].end())]
            said = {p.get("name", "").lower(): p.get("value", "").strip() for p in params}
            if said.get("name") and said.get("local"):
                out.append((depth, said["name"], said["local"]))
    return out


@F.pandas_udf(ENTRY)
def toc_entries(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: [{"place": k, "depth": d, "title": t, "local": p} for k, (d, t, p) in enumerate(contents(text or ""))])


def ordered_topics(tables: DataFrame, topics: DataFrame) -> DataFrame:
    """archive, place, depth, title, local, text: the topics that the contents name, each at its first place. tables:
    archive, text of the contents; topics: archive, local (path in the archive), text. Entries without a topic are left out, and
    counted by toc_summary."""
    return _first(tables).join(topics.select("archive", "local", "text"), ["archive", "local"]).select("archive", "place", "depth", "title", "local", "text")


def _first(tables: DataFrame) -> DataFrame:
    every = tables.select("archive", F.explode(toc_entries("text")).alias("e")).select("archive", "e.*")
    best = F.min_by(F.struct("place", "depth", "title"), "place").alias("b")
    return every.groupBy("archive", "local").agg(best).select("archive", "local", "b.*")


def toc_summary(tables: DataFrame, topics: DataFrame) -> DataFrame:
    """archive, entries (repeated ones too), converted, missing."""
    every = tables.select("archive", F.size(toc_entries("text")).alias("entries"))
    met = _first(tables).join(topics.select("archive", "local", F.lit(1).alias("there")), ["archive", "local"], "left")
    return every.join(met.groupBy("archive").agg(F.count("there").alias("converted"), (F.count("*") - F.count("there")).alias("missing")), "archive", "left").fillna(0)


def archive_layout(paths: DataFrame) -> DataFrame:
    """archive, layout by the files' paths (archive, path): chm with a contents file at the top, hdx with resources and a profile,
    chm with pages at the top; null for none of these."""
    top = ~F.contains("path", F.lit("/"))
    has = lambda c: F.max(c)
    d = paths.groupBy("archive").agg(
        has(top & F.col("path").rlike(r"\.hhc$")).alias("toc"), has(F.col("path").startswith("resources/")).alias("res"),
        has(F.col("path") == "profile.xml").alias("profile"), has(top & F.col("path").rlike(r"\.htm")).alias("pages"),
    )
    return d.select("archive", F.when(F.col("toc"), "chm").when(F.col("res") & F.col("profile"), "hdx").when(F.col("pages"), "chm").alias("layout"))
