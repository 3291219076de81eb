"""A sink whose writes count once: rows first, then a manifest that names them.

Every attempt writes to a folder of its own; readers see the attempts that manifests name, one for each snapshot. So an attempt
that fails leaves nothing that is read, one that is repeated adds nothing, and two that race count once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MANIFEST = "kind string, snapshot string, place long, attempt string, rows long"


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """kind, snapshot, place, attempt, rows: the attempt that counts of each snapshot."""
    try:
        every = spark.read.schema(MANIFEST).parquet(f"{folder}/manifests")
    except AnalysisException:  # nothing is committed yet
        every = spark.createDataFrame([], MANIFEST)
    return every.groupBy("kind", "snapshot").agg(F.min_by(F.struct("place", "attempt", "rows"), "attempt").alias("m")).select("kind", "snapshot", "m.*")


def commit(rows: dict[str, DataFrame], folder: str, snapshot: str, place: int = 0) -> dict[str, int]:
    """Writes the rows of each kind of asset under this snapshot, unless that is committed already, and returns how many rows
    of each kind are new. place orders snapshots for read_latest."""
    if not rows:
        return {}
    spark = next(iter(rows.values())).sparkSession
    done = {r.kind for r in manifests(spark, folder).where(F.col("snapshot") == snapshot).select("kind").collect()}  # one row a kind
    new = {}
    for kind, df in rows.items():
        if kind not in done:
            attempt = uuid.uuid4().hex
            at = f"{folder}/{kind}/{attempt}"
            df.withColumn("snapshot", F.lit(snapshot)).withColumn("place", F.lit(place).cast("long")).write.parquet(at)
            new[kind] = (attempt, spark.read.parquet(at).count())
    if new:
        spark.createDataFrame([(k, snapshot, place, a, n) for k, (a, n) in new.items()], MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifests")
    return {k: n for k, (_, n) in new.items()}


def read_committed(spark: SparkSession, folder: str, kind: str) -> DataFrame | None:
    """All committed rows of a kind, with their snapshot and place; None if there are none."""
    attempts = [r.attempt for r in manifests(spark, folder).where(F.col("kind") == kind).select("attempt").toLocalIterator()]  # one a snapshot
    return spark.read.parquet(*[f"{folder}/{kind}/{a}" for a in attempts]) if attempts else None


def read_latest(spark: SparkSession, folder: str, kind: str, keys: Sequence[str]) -> DataFrame | None:
    """Of each key the row of the latest place (of equal ones the greatest snapshot): snapshots as upserts."""
    rows = read_committed(spark, folder, kind)
    if rows is None:
        return None
    best = F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct("place", "snapshot"))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def sink_stream(stream: DataFrame, folder: str, checkpoint: str, split: Callable[[DataFrame], dict[str, DataFrame]]) -> StreamingQuery:
    """Commits each batch of a stream as a snapshot, split into kinds of assets, until all that is there is in. A run that goes on
    from the checkpoint gives a batch the same number again, so one that was committed before the run ended counts once."""
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        commit(split(batch), folder, f"{run}-{number:09d}", number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
