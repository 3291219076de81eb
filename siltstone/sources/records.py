"""Record sources and sinks: JSON lines, archives, tables, compact logs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def search_sections(sections: DataFrame, words: Sequence[str], k: int = 10, history: bool = False) -> DataFrame:
    """Sections (id, title, text) that hold all words: a thousand points for each time a word stands in the title, and up to
    fifty for its times in the text. Sections about the change history are left out unless asked for."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    d = sections if history else sections.where(~F.contains(low("title"), F.lit("change history")))
    score = F.lit(0)
    for w in words:
        titled, hits = (F.regexp_count(low(c), F.lit("\\Q" + w.lower() + "\\E")) for c in ("title", "text"))
        d = d.where((titled > 0) | (hits > 0))
        score = score + 1000 * titled + F.least(hits, F.lit(50))
    return d.withColumn("score", score).orderBy(F.desc("score"), "id").limit(k)


def unpack(archives: DataFrame, largest: int | None = None) -> DataFrame:
    """path, member, content of every file in the ZIP archives (path, content). Members that would leave the archive's
    folder are left out, and with `largest` those that unpack to more bytes; unreadable archives have none."""

    def members(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                out = []
                for i in z.infolist():
                    name = i.filename.replace("\\", "/")
                    if not i.is_dir() and not name.startswith("/") and ".." not in name.split("/") and (largest is None or i.file_size <= largest):
                        out.append((path, name, z.read(i)))
                yield pd.DataFrame(out, columns=["path", "member", "content"])

    return archives.select("path", "content").mapInPandas(members, "path string, member string, content binary")


#: Charsets that are declared by a name but written in a larger one.
LARGER = {"gb2312": "gb18030", "gbk": "gb18030"}
_DECLARED = re.compile(rb"""charset\s*=\s*["']?([\w-]+)""", re.IGNORECASE)
#: Bytes at the beginning of a file among which the declaration is looked for; it has to stand there by the format's rule.
DECLARED_WITHIN = 4_096


def decoded(content: bytes | None, default: str = "utf-8") -> str | None:
    """Bytes as text: in the charset that their beginning declares, if there is one that is known, else in the default;
    what is not valid in it becomes the replacement sign."""
    if content is None:
        return None
    found = _DECLARED.search(content[:DECLARED_WITHIN])
    name = found[1].decode("ascii", "replace").lower() if found else default
    try:
        return content.decode(LARGER.get(name, name), "replace")
    except LookupError:
        return content.decode(default, "replace")


@F.pandas_udf(StringType())
def declared_text(content: pd.Series) -> pd.Series:
    return content.map(decoded)


def export_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def import_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def compact_log(results: DataFrame) -> DataFrame:
    """query_id and its items as one JSON text, best first, without texts: the rows of a query log. A query's items
    are its top k, so the group is small. results: query_id, unit_id, score."""
    s = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "unit_id", "score")))
    return results.groupBy("query_id").agg(F.to_json(F.transform(s, lambda x: F.struct(x["unit_id"].alias("unit_id"), F.round(x["score"], 6).alias("score")))).alias("items"))


def append_rows(rows: DataFrame, folder: str, kind: str) -> None:
    """Adds rows of one kind of asset to its table; a table is a Parquet folder, its snapshots are folders in it."""
    rows.write.mode("append").partitionBy("snapshot").parquet(f"{folder}/{kind}")


#: MIME types by extension; any other is application/octet-stream.
MIME = {
    "md": "text/markdown", "txt": "text/plain", "html": "text/html", "htm": "text/html", "pdf": "application/pdf", "json": "application/json",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "csv": "text/csv", "zip": "application/zip",
}


def mime_type(path):
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])[ext], F.lit("application/octet-stream"))
