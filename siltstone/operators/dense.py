"""Dense search for batches of queries: tiles of vectors meet tiles of queries as matrices.

A tile is a row: numbers of units and their vectors as one block of bytes, at most TILE_BYTES. Tasks build the vectors' tiles
where they read them, so vectors cross the network only if the queries are too many to be sent to every task. Tiles join by
scope; a scope with many tiles is dealt over several parts, each with a copy of the scope's queries. One product gives all
scores of a pair of tiles, of which each query's k best go on, so what is merged in the end is lists of k, not pairs.

Scores are cosines, summed anew for what is kept: equal vectors score alike, whatever tile they are in.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import starmap

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import top_per

#: Bytes of one tile, and rows; bytes of all queries' tiles that are sent to every task.
TILE_BYTES, TILE_ROWS = 1 << 20, 4_096
SENT_BYTES = 32 << 20
#: Tiles of one scope that meet the scope's queries in one part of the join.
PART_TILES = 64
TILE = "scope string, tile int, ids binary, sections array<string>, vectors binary"
#: Filters that a candidate meets, from none to scope and section.
ANY, SCOPED, BOTH = 0, 1, 2


def tiles(rows: DataFrame, dimension: int, by_scope: bool) -> DataFrame:
    """Rows (id, scope, section, v) as tiles; those without direction, of another dimension, or with a null in them have
    no cosine and are left out. Without by_scope a tile has one scope for all, and the sections' array holds each row's
    scope and section."""
    fine = rows.where((F.size("v") == dimension) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("v", lambda x: x != 0))
    most = max(1, min(TILE_ROWS, TILE_BYTES // (8 * dimension)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str | None, list[tuple]] = {}
        held, number = 0, 0

        def tile(scope: str | None, parts: list[tuple]) -> tuple:
            ids, marks, v = zip(*parts)
            return scope, number, np.concatenate(ids).tobytes(), [m for own in marks for m in own], np.concatenate(v).tobytes()

        def out(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.string(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.binary()))], names=["scope", "tile", "ids", "sections", "vectors"])

        for b in batches:
            scopes, sections = b.column(1).to_pylist(), b.column(2).to_pylist()
            v = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            ids = b.column(0).to_numpy()
            marks = sections if by_scope else [x for pair in zip(scopes, sections) for x in pair]
            groups: dict[str | None, list[int]] = {}
            for k, scope in enumerate(scopes if by_scope else [None] * len(scopes)):
                groups.setdefault(scope, []).append(k)
            wide = 1 if by_scope else 2
            for scope, some in groups.items():
                for k in range(0, len(some), most):
                    at = np.array(some[k : k + most])
                    own = [marks[wide * i + j] for i in at.tolist() for j in range(wide)]
                    have = waiting.setdefault(scope, [])
                    if have and sum(len(p[0]) for p in have) + len(at) > most:
                        number += 1
                        yield out([tile(scope, have)])
                        held -= sum(len(p[0]) for p in have)
                        have.clear()
                    have.append((ids[at], own, v[at]))
                    held += len(at)
            if held > 16 * most:  # many scopes with a few rows each
                number += 1
                yield out(list(starmap(tile, ((s, p) for s, p in waiting.items() if p))))
                waiting, held = {}, 0
        if held:
            number += 1
            yield out(list(starmap(tile, ((s, p) for s, p in waiting.items() if p))))

    return fine.select(F.col("id").cast("long").alias("id"), F.col("scope").cast("string").alias("scope"), F.col("section").cast("string").alias("section"), F.col("v").cast("array<double>").alias("v")).mapInArrow(build, TILE)


def best_pairs(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray, met: np.ndarray | None, k: int) -> list[np.ndarray]:
    """query, unit, level, score of each query's k best units (by their best vector) of the tile at each level."""
    q_norm, v_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    scores = (q / q_norm[:, None]) @ (v / v_norm[:, None]).T
    by = np.argsort(v_ids, kind="stable")
    firsts = np.flatnonzero(np.diff(v_ids[by], prepend=v_ids[by[0]] - 1))
    found = []
    for level in (None,) if met is None else np.unique(met[met >= ANY]).tolist():
        own = scores if met is None else np.where(met == level, scores, -np.inf)
        units = np.maximum.reduceat(own[:, by], firsts, axis=1) if len(firsts) < len(by) else own
        least = np.partition(units, -k, axis=1)[:, -k] if units.shape[1] > k else np.full(len(q), -2.0)
        rows, columns = np.nonzero(own >= np.maximum(least, -2.0)[:, None] - 1e-12)
        exact = (q[rows] * v[columns]).sum(axis=1) / (q_norm[rows] * v_norm[columns])
        order = np.lexsort((v_ids[columns], -exact, rows))
        rows, ids, exact = rows[order], v_ids[columns[order]], exact[order]
        if len(firsts) < len(by):  # a unit's best vector alone
            _, first = np.unique(np.stack([rows, ids]), axis=1, return_index=True)
            first.sort()
            rows, ids, exact = rows[first], ids[first], exact[first]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < k
        found.append((q_ids[rows[kept]], ids[kept], np.full(int(kept.sum()), 0 if level is None else level), exact[kept]))
    return [np.concatenate(x) for x in zip(*found)] or [np.empty(0, int)] * 4


def blocked_top(queries: DataFrame, vectors: DataFrame, dimension: int, k: int = 20, relax: bool = False) -> DataFrame:
    """query_id, unit_id, score: the k units nearest by cosine. queries: query_id, scope, section, v; vectors: unit_id,
    scope, section, v; ids are integers, a unit may have several vectors.

    A query's scope must be equal to the vector's (null: only those without one) and its section, if not null, a prefix of the
    vector's. With relax a query takes all scopes if its own is null, and one for which scope and section leave nothing
    drops the section, and if that leaves nothing the scope."""
    asked = tiles(queries.withColumnRenamed("query_id", "id"), dimension, not relax)
    size = asked.agg(F.sum(F.length("vectors"))).first()[0] or 0
    there = tiles(vectors.withColumnRenamed("unit_id", "id"), dimension, not relax)
    small = size <= SENT_BYTES
    if small:
        there, asked = there.withColumn("part", F.lit(0)), asked.withColumn("part", F.lit(0))
    else:  # parts for the largest scope; each has a copy of its queries
        most = there.groupBy("scope").count().agg(F.max("count")).first()[0] or 0
        parts = max(1, -(-most // PART_TILES))
        there = there.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = asked.select(F.coalesce("scope", F.lit("")).alias("s"), F.col("scope").isNull().alias("no_scope"), "part", F.col("ids").alias("q_ids"), F.col("sections").alias("q_sections"), F.col("vectors").alias("q"))
    left = there.select(F.coalesce("scope", F.lit("")).alias("s"), F.col("scope").isNull().alias("no_scope"), "part", "ids", "sections", F.col("vectors").alias("v"))
    pairs = left.join(F.broadcast(right) if small else right, ["s", "no_scope", "part"]).select("ids", "sections", "v", "q_ids", "q_sections", "q")

    def met_levels(sections: list, q_sections: list) -> np.ndarray | None:
        if not relax:
            if not any(q_sections):
                return None
            return np.array([[BOTH if not p or (s or "").startswith(p) else -1 for s in sections] for p in q_sections])
        own = list(zip(sections[::2], sections[1::2]))
        table: dict[tuple, np.ndarray] = {}
        for query in zip(q_sections[::2], q_sections[1::2]):
            if query not in table:
                scope, p = query
                inside = np.array([scope is None or s == scope for s, _ in own])
                below = np.array([not p or (x or "").startswith(p) for _, x in own])
                table[query] = np.where(inside & below, BOTH, np.where(inside, SCOPED, ANY))
        return np.stack([table[query] for query in zip(q_sections[::2], q_sections[1::2])])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, sections, v, q_ids, q_sections, q in zip(*(b.column(c) for c in range(6))):
                met = met_levels(sections.as_py(), q_sections.as_py())
                matrix = lambda x: np.frombuffer(x.as_buffer(), float).reshape(-1, dimension)
                number = lambda x: np.frombuffer(x.as_buffer(), np.int64)
                found = best_pairs(matrix(q), number(q_ids), matrix(v), number(ids), met, k)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.int32(), pa.float64()))], names=["query_id", "unit_id", "level", "score"])

    lists = pairs.mapInArrow(multiply, "query_id long, unit_id long, level int, score double")
    merged = lists.groupBy("query_id", "unit_id", "level").agg(F.max("score").alias("score"))
    if relax:
        merged = top_per(merged, ["query_id", "level"], [F.desc("score"), F.col("unit_id")], k)
        best = F.max("level").over(Window.partitionBy("query_id"))  # over three lists of k at most
        merged = merged.withColumn("best", best).where("level = best")
    return top_per(merged, ["query_id"], [F.desc("score"), F.col("unit_id")], k).select("query_id", "unit_id", "score")
