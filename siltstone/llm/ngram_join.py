"""N-gram Jaccard join by vertical partitioning (operator 1).

Every document is the set of its distinct five-word shingles; documents with equal sets are one vertex. Three exact
facts keep the work near the size of the duplicated part of the corpus:

* A shingle of one set only is in no intersection. Tasks gather their shingles as sorted runs; buckets of the hash
  range count them over all documents and send back, to each run, those found twice or more. A set whose shared
  shingles are fewer than its share of the threshold is linked with nothing and leaves here, before any join.
* The shingles have one global order: document frequency (in half octaves), then the hash. Two sets of Jaccard
  similarity t share a shingle among the first m - ceil(t n) + 1 of the m shared shingles of each, so an inverted index
  over these prefixes finds every candidate. The order is cut into FRAGMENTS ranges; each candidate pair's overlap is
  counted in each range on its own, and the partial counts are summed per pair.
* Classes only need a spanning set of links. Members of a large list of the index first meet a few hubs (the most
  central one, by the frequency of its shingles, and some chosen by hash). After that, only members outside the list's
  largest class meet the others, and a pair goes on only if sizes and a parity sketch allow it: cells of the sketch that
  differ are shingles of the symmetric difference, so it bounds the similarity from above.

Nothing is collected but counts per frequency class; nothing that grows with the corpus is broadcast. A shingle that
very many sets share reaches its bucket as one number per run.

Cases: a null or empty text, or one of white space only, is an empty set and linked with nothing; fewer than five
words are one shingle; rows that repeat a doc_id are vertices of their own text; an empty table gives an empty
result; a very long text is one set in one run, whole; ties in the order are broken by the hash, ties between hubs by
the vertex. Shingles are 56-bit hashes; vertices are (set size, 64-bit hash of the set). The input is read once, and a
lost task must meet the same rows again: pass a table, or a frame that reads one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, doc_texts, materialize, mix64, window_hashes, word_hashes, workspace

WORDS = 5
NUMERATOR, DENOMINATOR = 80, 100
TOKEN_BITS = 56
#: Shingles and documents that a task gathers before it writes a run.
RUN_TOKENS, RUN_DOCS = 1_500_000, 200_000
#: Characters of text for which there is one bucket of the hash range, and buckets at most.
BUCKET_CHARS, BUCKETS = 12_000_000, 1 << 17
FRAGMENTS = 4
#: Hubs that members of a large list meet in a round (the central one and others by hash), and rounds at most.
HUBS, ROUNDS = 3, 4
#: Vertices of a list that gives all its pairs in the first turn.
SMALL = 8
#: Hub rounds go on while the pairs left to verify outnumber the rows of the index by this factor.
LINEAR = 4
#: 64-bit words of a parity sketch.
SKETCH = 8
SKETCHES = [f"s{k}" for k in range(SKETCH)]


def shingle_set(text: str, width: int = WORDS) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    if len(words) < width:
        return mix64(window_hashes(h, len(words)) + np.uint64(len(words)))
    return np.unique(window_hashes(h, width))


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def pack_run(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers: the width of the steps, the first number, and the steps in as few bytes as the largest needs."""
    steps = np.diff(values).astype("<u8")
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values[:1].astype("<u8").tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_run(raw: bytes) -> np.ndarray:
    width = raw[0]
    steps = np.zeros(((len(raw) - 9) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(np.concatenate([np.frombuffer(raw, "<u8", 1, offset=1), steps.reshape(-1).view("<u8")]), dtype=np.uint64)


ROW = pa.schema([("bucket", pa.int64()), ("run", pa.int64()), ("kind", pa.int32()), ("sets", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
ROW_DDL = "bucket long, run long, kind int, sets int, a binary, b binary, c binary, d binary"
SET_DDL = "doc_id long, n int, id long, m int, score double, tokens array<long>, " + ", ".join(f"{s} long" for s in SKETCHES)
HEAD, MANY, BLOCK = 0, 1, 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ROW)], schema=ROW)


def _gatherer(buckets: int):
    """Runs of the shingles of a task's distinct sets. A run has a HEAD (documents and sets), a MANY row (shingles that
    several sets of the run have, with these sets) and a BLOCK for each bucket: its distinct shingles, each with the
    number of its set, or with the number of sets as a mark if it stands in the MANY row, and then with their count."""
    shift = np.uint64(TOKEN_BITS - (buckets.bit_length() - 1))

    def run_of(run: int, docs: list[tuple], at: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        doc_ids, n, ids = zip(*docs)
        head = [np.array(x, t).tobytes() for x, t in ((doc_ids, "<i8"), (n, "<i4"), (ids, "<i8"), (at, "<i4"))]
        rows = [(-1 - run, run, HEAD, len(sets), *head)]
        if sets:
            tokens = np.concatenate(sets) >> np.uint64(64 - TOKEN_BITS)
            owner = np.repeat(np.arange(len(sets), dtype="<u2" if len(sets) < 1 << 16 else "<u4"), [len(g) for g in sets])
            by = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[by], owner[by]
            starts = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
            counts = np.diff(starts, append=len(tokens)).astype("<i4")
            tokens, many = tokens[starts], counts > 1
            if many.any():
                rows.append((-1 - run, run, MANY, len(sets), pack_run(tokens[many]), owner[np.repeat(many, counts)].tobytes(), counts[many].tobytes(), None))
            owner = owner[starts]
            owner[many] = len(sets)
            bucket = (tokens >> shift).astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            for i, j in zip(cuts, np.append(cuts[1:], len(tokens))):
                rows.append((int(bucket[i]), run, BLOCK, len(sets), pack_run(tokens[i:j]), owner[i:j].tobytes(), counts[i:j][many[i:j]].tobytes(), None))
        return _rows(rows)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, seen, held = TaskContext.get().partitionId() << 32, set(), 0
        docs, at, sets = [], [], []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = shingle_set(text)
                v = (len(g), set_id(g))
                if len(g) and v not in seen:
                    seen.add(v)
                    at.append(len(docs))
                    sets.append(g)
                    held += len(g)
                docs.append((doc_id, *v))
                if held >= RUN_TOKENS or len(docs) >= RUN_DOCS:
                    yield run_of(run, docs, at, sets)
                    run, held, docs, at, sets = run + 1, 0, [], [], []
        if docs:
            yield run_of(run, docs, at, sets)

    return gather


def _owners(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * size else "<u4")


def count_bucket(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run, the shingles of its block that two sets or more have, with the class of their frequency."""
    if key[0].as_py() < 0:
        yield from batches
        return
    runs, sets, tokens, owners, counts = [], [], [], [], []
    for b in batches:
        for r in b.to_pylist():
            t = unpack_run(r["a"])
            own = _owners(r["b"], len(t))
            n = np.ones(len(t), np.int64)
            n[own == r["sets"]] = np.frombuffer(r["c"], "<i4")
            runs.append(r["run"])
            sets.append(r["sets"])
            tokens.append(t)
            owners.append(own)
            counts.append(n)
    every = np.concatenate(tokens)
    by = np.argsort(every, kind="stable")
    starts = np.flatnonzero(np.diff(every[by], prepend=~every[by[:1]]))
    totals = np.add.reduceat(np.concatenate(counts)[by], starts)
    total = np.empty(len(every), np.int64)
    total[by] = np.repeat(totals, np.diff(starts, append=len(every)))
    out, at, held = [], 0, 0
    for run, of, t, own in zip(runs, sets, tokens, owners):
        shared = total[at : at + len(t)] >= 2
        if shared.any():
            classes = np.minimum(127, 2 * np.log2(total[at : at + len(t)][shared])).astype(np.uint8)
            out.append((0, run, BLOCK, of, pack_run(t[shared]), own[shared].tobytes(), classes.tobytes(), None))
            held += len(classes)
        at += len(t)
        if held > RUN_TOKENS:
            yield _rows(out)
            out, held = [], 0
    if out:
        yield _rows(out)


def _assembler(numerator: int, denominator: int):
    """Of each run: (doc_id, n, id) of its documents and, with doc_id null, its sets that may have links: number m of
    shared shingles, mean class of all, the shared ones in the global order, and the parity sketch of these."""

    def assemble(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, many, blocks = None, None, []
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == HEAD:
                    head = r
                elif r["kind"] == MANY:
                    many = r
                else:
                    blocks.append(r)
        doc_ids, n, ids, at = (np.frombuffer(head[c], t) for c, t in zip("abcd", ("<i8", "<i4", "<i8", "<i4")))
        names = [x.split()[0] for x in SET_DDL.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int64())] + [pa.int64()] * SKETCH

        def table(doc_id, n, id_, *rest) -> pa.RecordBatch:
            size = len(n)
            return pa.RecordBatch.from_arrays([pa.nulls(size, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip([doc_id, n, id_, *rest, *[None] * (len(types) - 3 - len(rest))], types)], names=names)

        yield table(doc_ids, n, ids)
        if not blocks:
            return
        if many is not None:
            many_tokens, spans = unpack_run(many["a"]), np.frombuffer(many["c"], "<i4").astype(np.int64)
            many_owners, begins = _owners(many["b"], int(spans.sum())), np.cumsum(spans) - spans
        keys, owners = [], []
        for r in blocks:
            t = unpack_run(r["a"])
            own = _owners(r["b"], len(t)).astype(np.int64)
            k = t | (np.frombuffer(r["c"], np.uint8).astype(np.uint64) << np.uint64(TOKEN_BITS))
            marked = own == head["sets"]
            keys.append(k[~marked])
            owners.append(own[~marked])
            if marked.any():
                of = np.searchsorted(many_tokens, t[marked])
                size = spans[of]
                places = np.repeat(begins[of] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                keys.append(np.repeat(k[marked], size))
                owners.append(many_owners[places].astype(np.int64))
        keys, owners = np.concatenate(keys).view(np.int64), np.concatenate(owners)
        m, sizes = np.bincount(owners, minlength=head["sets"]), n[at].astype(np.int64)
        stays = m * denominator >= sizes * numerator
        if not stays.any():
            return
        keys, owners = keys[stays[owners]], (np.cumsum(stays) - 1)[owners[stays[owners]]]
        by = np.lexsort((keys, owners))
        keys, owners = keys[by], owners[by]
        m, sizes = m[stays], sizes[stays]
        score = np.bincount(owners, weights=keys >> TOKEN_BITS, minlength=len(m)) / sizes
        cells = mix64(keys.view(np.uint64)) % np.uint64(64 * SKETCH)
        sketch = np.zeros((len(m), SKETCH), np.uint64)
        np.bitwise_xor.at(sketch, (owners, (cells >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (cells & np.uint64(63)))
        ends = np.concatenate([[0], np.cumsum(m)])
        for i in range(0, len(m), 2_000):
            j = min(i + 2_000, len(m))
            lists = pa.ListArray.from_arrays(pa.array(ends[i : j + 1] - ends[i], pa.int32()), pa.array(keys[ends[i] : ends[j]]))
            yield table(None, sizes[i:j], ids[at][stays][i:j], m[i:j], score[i:j], lists, *sketch[i:j].T.copy().view(np.int64))

    return assemble


def shared_sets(docs: DataFrame, folder: str, numerator: int, denominator: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, id) of every row, and the distinct sets that may have links, numbered: node, n, id, m, score, tokens,
    sketch; both materialized."""
    texts = doc_texts(docs)
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = 1 << min(BUCKETS.bit_length() - 1, max(3, (chars // BUCKET_CHARS).bit_length()))
    runs = texts.mapInArrow(_gatherer(buckets), ROW_DDL)
    counted = runs.groupBy("bucket").applyInArrow(count_bucket, ROW_DDL)
    rows = materialize(counted.groupBy("run").applyInArrow(_assembler(numerator, denominator), SET_DDL), folder + "/sets")
    own = rows.where("doc_id IS NULL").drop("doc_id")
    # a set found by several tasks is one vertex; vertices get numbers, so that all that follows joins on one long
    nodes = materialize(own.dropDuplicates(["n", "id"]).withColumn("node", F.monotonically_increasing_id()), folder + "/nodes")
    return rows.where("doc_id IS NOT NULL").select("doc_id", "n", "id"), nodes


def prefix_index(nodes: DataFrame, folder: str, numerator: int, denominator: int) -> DataFrame:
    """The lists of the prefix index that hold two vertices or more, as (token, size, node, n, m, score, sketch); materialized."""
    length = F.expr(f"m - ({numerator}L * n + {denominator - 1}) div {denominator} + 1").cast("int")
    every = nodes.select(F.explode(F.slice("tokens", F.lit(1), length)).alias("token"), "node", "n", "m", "score", *SKETCHES)
    met = every.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    return materialize(every.join(met, "token"), folder + "/index")


def fragment_cuts(nodes: DataFrame) -> list[int]:
    """The keys at which the global order is cut, so that each of the FRAGMENTS ranges holds about as many shingles."""
    counts = nodes.select(F.explode("tokens").alias("key")).groupBy(F.shiftright("key", TOKEN_BITS).alias("class")).count().collect()
    sizes = np.zeros(128)
    for r in counts:
        sizes[r["class"]] = r["count"]
    ends = np.cumsum(sizes) / max(1.0, sizes.sum())
    cuts = []
    for q in np.arange(1, FRAGMENTS) / FRAGMENTS:
        c = min(127, int(np.searchsorted(ends, q)))
        below = ends[c - 1] if c else 0.0
        share = (q - below) / max(1e-12, ends[c] - below)
        cuts.append((c << TOKEN_BITS) + min((1 << TOKEN_BITS) - 1, int(share * (1 << TOKEN_BITS))))
    return cuts


def links_among(pairs: DataFrame, nodes: DataFrame, cuts: list[int], numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) of (a, b, na, nb) that are similar enough: shared shingles are counted in each fragment of the
    global order on its own, and the partial counts are summed per pair."""
    lows, highs = [-1, *cuts], [*cuts, 2**63 - 1]

    def part(f: int) -> Column:
        return F.struct(F.lit(f).alias("fragment"), F.filter("tokens", lambda t: (t >= lows[f]) & (t < highs[f])).alias("tokens"))

    segments = nodes.select("node", F.explode(F.array(*map(part, range(FRAGMENTS)))).alias("s")).select("node", "s.fragment", "s.tokens").where(F.size("tokens") > 0)
    left = segments.select(F.col("node").alias("a"), "fragment", F.col("tokens").alias("x"))
    right = segments.select(F.col("node").alias("b"), "fragment", F.col("tokens").alias("y"))
    met = pairs.select("a", "b", "na", "nb").join(left, "a").join(right, ["b", "fragment"])
    common = met.groupBy("a", "b", "na", "nb").agg(F.sum(F.size(F.array_intersect("x", "y"))).alias("common"))
    return common.where(F.col("common") * denominator >= (F.col("na") + F.col("nb") - F.col("common")) * numerator).select("a", "b")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root): the smallest node of each class, by alternating large and small stars until nothing changes.

    Every step is a groupBy with map-side minima and a join back, so that a vertex of very many links is never one
    task's group.
    """

    def written(e: DataFrame, k: int) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = materialize(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), f"{folder}/{k}")
        return out, (seen.get["n"], seen.get["h"])

    def hooked(e: DataFrame, by_larger: bool) -> DataFrame:
        # a > b in every edge; large star: neighbours above u go to the least around u; small star: those below do
        both = e.select(F.col("a").alias("u"), F.col("b").alias("w"))
        if by_larger:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("m", "u").alias("m"))
        rows = both.join(least, "u")
        if by_larger:
            out = rows.where("w > u").select(F.col("w").alias("a"), F.col("m").alias("b"))
        else:
            out = rows.select(F.explode(F.array(F.struct(F.col("w").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        return out.where("a > b")

    now, state = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), 0)
    before, k = None, 0
    while state != before:
        before, k = state, k + 1
        now, state = written(hooked(hooked(now, True), False).distinct(), k)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def may_link_by(numerator: int, denominator: int) -> Column:
    """Whether (na, ma), (nb, mb) and the sketches of a pair leave room for the similarity."""
    sizes = (F.least("na", "nb") * denominator >= F.greatest("na", "nb") * numerator) & (F.least("ma", "mb") * (numerator + denominator) >= (F.col("na") + F.col("nb")) * numerator)
    apart = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(1, SKETCH)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    alone = F.col("na") - F.col("ma") + F.col("nb") - F.col("mb")
    return sizes & ((apart + alone) * (numerator + denominator) <= (F.col("na") + F.col("nb")) * (denominator - numerator))


PAIR = ["a", "b", "na", "nb", "ma", "mb"]


def _side(at: DataFrame, node: str, *more: str | Column) -> DataFrame:
    """The index with its columns named after the end of a pair: node, and n, m, root and sketch with it as a suffix."""
    return at.select(*more, F.col("node").alias(node), *[F.col(c).alias(f"{c[0]}{node}") for c in ("n", "m", "root")], *[F.col(s).alias(f"{node}{s[1:]}") for s in SKETCHES])


def _ordered(met: DataFrame) -> DataFrame:
    swap = F.col("a") > F.col("b")
    return met.select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in zip(PAIR, ["b", "a", "nb", "na", "mb", "ma"])])


def hub_pairs(at: DataFrame, turn: int, may_link: Column) -> DataFrame:
    """Pairs of one round; at: token, size, node, n, m, score, root, sketch. In the first turn lists of at most SMALL
    vertices give all their pairs; each vertex of a larger list meets the list's hubs."""
    large = at.where(F.col("size") > SMALL)
    own = F.struct("node", "n", "m", "root", *SKETCHES)
    salts = [turn * HUBS + k for k in range(HUBS - 1)]
    # the most central vertex; in later turns, of those outside the list's largest class
    central = F.struct(F.col("root") != F.col("major"), "score", "node") if turn else F.struct("score", "node")
    chosen = [F.max_by(own, central), *[F.min_by(own, F.xxhash64(F.lit(s), "node")) for s in salts]]
    hubs = large.groupBy("token").agg(F.array_distinct(F.array(*chosen)).alias("hubs")).select("token", F.explode("hubs").alias("h")).select("token", "h.*")
    pairs = _side(large, "a", "token").join(_side(hubs, "b", "token"), "token").where((F.col("ra") != F.col("rb")) & may_link).select(*PAIR)
    if not turn:
        small = at.where(F.col("size") <= SMALL)
        pairs = pairs.unionByName(_side(small, "a", "token").join(_side(small, "b", "token"), "token").where((F.col("a") < F.col("b")) & may_link).select(*PAIR))
    return _ordered(pairs)


def pairs_left(at: DataFrame, may_link: Column) -> DataFrame:
    """Pairs of the last turn; at has major, the root of the list's largest class, besides: every vertex outside the
    largest class meets all vertices of other classes that its size and sketch allow."""
    x = _side(at.where("root <> major"), "a", "token")
    y = _side(at, "b", "token", (F.col("root") == F.col("major")).alias("large"))
    return _ordered(x.join(y, "token").where((F.col("ra") != F.col("rb")) & (F.col("large") | (F.col("a") < F.col("b"))) & may_link))


def similar_sets(docs: DataFrame, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, id, n_shingles, component_id, root) of every row, where (n, id) names its set and root its class (null
    for a set without links), and the links (a, b) between sets that were verified and span all classes, each end as
    (n, id)."""
    spark = docs.sparkSession
    folder = workspace(spark)
    vertices, nodes = shared_sets(docs, folder, numerator, denominator)
    index = prefix_index(nodes, folder, numerator, denominator)
    cuts = fragment_cuts(nodes)
    may_link = may_link_by(numerator, denominator)
    rows = index.count()
    links = roots = spark.createDataFrame([], "a long, b long")
    roots = roots.toDF("node", "root")
    at = index.withColumn("root", F.col("node"))
    for turn in range(ROUNDS + 1 if rows else 0):
        last = False
        if turn:  # small lists are done
            at = index.where(F.col("size") > SMALL).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            by_root = at.groupBy("token", "root").count()
            whole = F.sum("count")
            open_lists = by_root.groupBy("token").agg(((whole * whole - F.sum(F.col("count") * F.col("count"))) / 2).alias("left"), F.max_by("root", F.struct("count", "root")).alias("major")).where("left > 0")
            at = materialize(at.join(open_lists, "token"), f"{folder}/at-{turn}")
            left = at.groupBy("token").agg(F.max("left").alias("left")).agg(F.sum("left")).first()[0] or 0
            if not left:
                break
            last = turn == ROUNDS or left <= LINEAR * rows or pairs_left(at, may_link).count() <= LINEAR * rows
        pairs = (pairs_left(at, may_link) if last else hub_pairs(at, turn, may_link)).distinct()
        found = materialize(links_among(pairs, nodes, cuts, numerator, denominator), f"{folder}/found-{turn}")
        links = links.unionByName(found)
        known = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = materialize(components(known.unionByName(found), f"{folder}/stars-{turn}"), f"{folder}/roots-{turn}")
        discard(spark, f"{folder}/stars-{turn}", f"{folder}/at-{turn}")
        if last:
            break
    first = vertices.where("n > 0").groupBy("n", "id").agg(F.min("doc_id").alias("first"))
    rooted = nodes.select("n", "id", "node").join(roots, "node").select("n", "id", "root")
    classes = materialize(first.join(rooted, ["n", "id"], "left"), folder + "/classes")
    least = classes.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("least"))
    named = classes.join(least, "root", "left").select("n", "id", "root", F.coalesce("least", "first").alias("component_id"))
    out = vertices.join(named, ["n", "id"], "left").select("doc_id", "n", "id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "root")
    ends = [nodes.select(F.col("node").alias(c), F.struct("n", "id").alias(f"{c}_set")) for c in ("a", "b")]
    return out, links.join(ends[0], "a").join(ends[1], "b").select(F.col("a_set").alias("a"), F.col("b_set").alias("b"))


def ngram_join(docs: DataFrame, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    return similar_sets(docs, numerator, denominator)[0].select("doc_id", "n_shingles", "component_id")
