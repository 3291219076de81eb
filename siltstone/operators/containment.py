"""Which texts hold which passages, whole: by the words between a passage's first and last, not by comparing all with all."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import sparse
from .relational import BROADCAST_BYTES, BROADCAST_ROWS, is_small, settled

#: Words of a lower-cased text between blanks, as the expressions below part them.
WORDS = sparse.Split(r"[^ \t\n\x0b\f\r]+")
#: Blanks, by their byte in UTF-8.
BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))
#: Bytes of texts that are looked through at once, beyond one text; runs that are, and bytes of what was found that leave together.
CHUNK, RUNS, FOUND = 1 << 20, 1 << 20, 8 << 20
#: Bits of the filter for each key of a passage, and at most.
KEY_BITS, MOST_BITS = 32, 1 << 29
#: Odd bases of the hashes of words and of runs, and what tells a run's beginning from a whole one.
LETTER, WORD, HEAD = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F


_known_powers: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base to the power of 0 and so on, n of them; kept, since chunks are about as long."""
    if len(_known_powers.get(base, ())) < n:
        out = np.full(2 * n, base, np.uint64)
        out[0] = 1
        _known_powers[base] = np.multiply.accumulate(out)
    return _known_powers[base][:n] if n else np.empty(0, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A key's two places in a filter of so many bits, a power of two."""
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return (key >> shift).astype(np.int64), ((key * np.uint64(LETTER)) >> shift).astype(np.int64)


class Words:
    """The words of some texts, given as bytes and offsets, and hashes of runs of them: any run's hash is one difference of sums
    over all words before its end and its beginning."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        blank, edge = BLANK[data], np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = ~blank & (edge[:-1] | np.append(True, blank[:-1])[: len(data)])
        ends = ~blank & (edge[1:] | np.append(blank[1:], True)[: len(data)])
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        n = len(self.start)
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.text, np.arange(len(offsets) - 1))  # of each text, and behind its last
        self.behind = np.searchsorted(self.text, np.arange(len(offsets) - 1), side="right")
        self.sums, self.back = np.zeros(n + 1, np.uint64), _powers(pow(WORD, -1, 1 << 64), n)
        if n:
            data = data[self.start[0] :]
            within = np.arange(len(data)) - np.repeat(self.start - self.start[0], np.diff(self.start, append=self.start[0] + len(data)))
            letters = _powers(LETTER, int(within.max()) + 1)[within] * (data.astype(np.uint64) + np.uint64(1))
            letters[BLANK[data]] = 0
            self.sums[1:] = np.cumsum(_mixed(np.add.reduceat(letters, self.start - self.start[0])) * _powers(WORD, n))

    def keys(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of the runs of so many words from these words on."""
        return _mixed((self.sums[at + size] - self.sums[at]) * self.back[at] + np.asarray(size).astype(np.uint64) * np.uint64(HEAD))

    def inner(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the first of its words that have a blank, or a word and a blank, on both sides, and their number."""
        some = np.flatnonzero(np.diff(self.offsets) > 0)
        first, behind = self.first.copy(), self.behind.copy()
        first[some] += ~BLANK[self.data[self.offsets[some]]]
        behind[some] -= ~BLANK[self.data[self.offsets[some + 1] - 1]]
        return first, np.maximum(behind - first, 0)

    def around(self, at: np.ndarray, size: np.ndarray) -> list[bytes]:
        """Runs with all that lies between them and the far ends of the words before and behind."""
        t, last = self.text[at], at + size
        a = np.where(at > self.first[t], self.start[np.maximum(at - 1, 0)], self.offsets[t])
        b = np.where(last < self.behind[t], self.end[np.minimum(last, len(self.end) - 1)], self.offsets[t + 1])
        data = self.data.tobytes()
        return [data[x:y] for x, y in zip(a.tolist(), b.tolist())]


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """The texts in pieces, from and to which place."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    cuts = np.flatnonzero(np.diff((offsets[:-1] - offsets[0]) // CHUNK)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _power(n: np.ndarray) -> np.ndarray:
    """The exponent of the largest power of two that isn't more; n from 1."""
    return np.frexp(n.astype(np.float64))[1] - 1


def keyed(passages: DataFrame) -> DataFrame:
    """passages (item_id, passage) with n, the number of inner words, and key, the hash of all of them, and head, that of the
    largest power of two of them from the first on; null without one."""
    given = passages.select("item_id", "passage")
    shape = StructType([*given.schema, StructField("n", LongType()), StructField("key", LongType()), StructField("head", LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in _chunks(batch.column(1)):
                first, n = words.inner()
                own = np.flatnonzero(n)
                key, head, none = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), n == 0
                key[own] = words.keys(first[own], n[own]).view(np.int64)
                head[own] = (words.keys(first[own], 1 << _power(n[own])) ^ np.uint64(HEAD)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(n), pa.array(key, mask=none), pa.array(head, mask=none)], names=shape.names)

    return given.mapInArrow(hashed, shape)


def _filter(keys: DataFrame) -> np.ndarray:
    """The bits, in bytes, at both places of all keys (key). The table's size is that of so many keys up to MOST_BITS; a fuller one
    lets more through, never less."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (keys.count() * KEY_BITS).bit_length()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(places(batch.column(0).to_numpy().view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at // 32_768), pa.array(at % 32_768)], names=["bucket", "bit"])

    pieces = keys.mapInArrow(placed, "bucket long, bit long").repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    for bucket, piece in zip(pieces["bucket"].to_pylist(), pieces["bits"]):
        out[bucket * 4_096 : (bucket + 1) * 4_096] = np.frombuffer(piece.as_buffer(), np.uint8)
    return out


def _runs_of(words: Words, sizes: dict[int, np.ndarray], known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Beginning, number of words and key of the texts' runs that the filter knows, of the sizes that passages have. Of these only those
    are looked up whose first words, as many as the largest power of two, are known."""
    left = words.behind[words.text] - np.arange(len(words.text))

    def there(key: np.ndarray) -> np.ndarray:
        fine = np.ones(len(key), bool)
        for at in places(key, len(known) * 8):
            fine &= (known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return fine

    for power, own in sizes.items():
        at = np.flatnonzero(left >= 1 << power)
        at = at[there(words.keys(at, 1 << power) ^ np.uint64(HEAD))]
        step = max(1, RUNS // len(own))
        for i in range(0, len(at), step):
            some = at[i : i + step]
            run, n = np.repeat(some, len(own)), np.tile(own, len(some))
            fine = left[run] >= n
            run, n = run[fine], n[fine]
            key = words.keys(run, n)
            fine = there(key)
            yield run[fine], n[fine], key[fine]


def holding_runs(p: DataFrame, narrow: DataFrame, texts: DataFrame) -> DataFrame:
    """item_id, unit_id: texts (unit_id, text) that hold the passage, of passages with an inner word; p: these as keyed gives them;
    narrow: their n, key and head.

    All inner words of a passage stand in the text as they are, in a row. A filter of the passages' keys, of a bounded size, goes to the
    tasks that read the texts; these look up the runs of as many words as passages have, and what leaves them is the runs that are known, with the words around,
    which meet the passages by key. No other run is a row."""
    lengths = np.array(sorted(r.n for r in narrow.select("n").distinct().collect()), np.int64)  # at most as many as a text has words
    power = _power(lengths)
    sizes = {int(k): lengths[power == k] for k in np.unique(power)}
    known = texts.sparkSession.sparkContext.broadcast(_filter(narrow.select(F.explode(F.array("key", "head")).alias("key"))))
    given = texts.where(F.col("text").isNotNull()).select("unit_id", "text")
    shape = StructType([given.schema["unit_id"], StructField("key", LongType()), StructField("piece", StringType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(unit: pa.Array, found: dict) -> pa.RecordBatch:
            at, key, piece = zip(*found)
            return pa.RecordBatch.from_arrays([unit.take(pa.array(at)), pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(piece, pa.binary()).cast(pa.string())], names=shape.names)

        for batch in batches:
            for a, b, words in _chunks(batch.column(1)):
                unit, found, size = batch.column(0).slice(a, b - a), {}, 0
                for at, n, key in _runs_of(words, sizes, known.value):
                    for i in range(0, len(at), 1_000):
                        s = slice(i, i + 1_000)
                        pieces = words.around(at[s], n[s])
                        found.update(dict.fromkeys(zip(words.text[at[s]].tolist(), key[s].tolist(), pieces)))
                        size += sum(map(len, pieces))
                        if size > FOUND:
                            yield out(unit, found)
                            found, size = {}, 0
                if found:
                    yield out(unit, found)

    met = given.mapInArrow(search, shape).join(p.select("item_id", "key", "passage"), "key")
    return met.where(F.contains("piece", "passage")).select("item_id", "unit_id").distinct()


def holders(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """item_id, unit_id: texts (unit_id, text) that hold the whole passage (item_id, passage) somewhere; passages without a
    word are in none.

    The words of a passage, but for its first and last, which may begin or end inside a word, stand in the text as they are.
    Texts are looked through for the run of all of these. Few passages are sent to the tasks that read the texts instead, which find those
    with all inner words (ids are integers then). In neither way a run is a row unless a passage has it. Passages without an inner word
    meet the words of texts by their first characters."""
    p = keyed(passages.where(F.length("passage") > 0))
    narrow = settled(p.select("n", "key", "head", F.length("passage").alias("size")))
    inner, size, without = narrow.agg(F.sum("n"), F.sum("size"), F.count_if(F.col("n") == 0)).first()
    few = (inner or 0) <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES
    send = F.broadcast if few else (lambda df: df)
    # runs of blanks give empty words: the words of both sides are those between them
    w = F.split("passage", r"\s")
    if few:
        terms = F.filter(F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))), lambda x: x != "")
        asked = p.where("n > 0").select(F.col("item_id").alias("query_id"), F.array_distinct(F.transform(terms, F.lower)).alias("terms"))
        found = sparse.holding_all(asked, texts.select("unit_id", "text"), WORDS).select(F.col("query_id").alias("item_id"), "unit_id")
    else:
        found = holding_runs(p.where("n > 0"), narrow.where("n > 0"), texts)
    short = p.where("n = 0").select("item_id", F.explode(F.array_distinct(F.filter(w, lambda x: x != ""))).alias("word"))
    short = short.groupBy("item_id").agg(F.max_by(F.substring("word", 1, 3), F.length("word")).alias("piece"))
    words = F.filter(F.split("text", r"\s"), lambda x: x != "")
    every = texts.where(F.col("text").isNotNull()).select("unit_id", words.alias("w"))
    pieces = F.array_distinct(F.flatten(F.transform("w", lambda x: F.flatten(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.array(*[F.substring(x, i, F.lit(k)) for k in (1, 2, 3)]))))))
    by_piece = every.select("unit_id", F.explode(pieces).alias("piece")).join(F.broadcast(short) if is_small(short) else short, "piece").select("item_id", "unit_id") if without and not short.isEmpty() else None
    unsure = [d for d in ((found, by_piece) if few else (by_piece,)) if d is not None]
    if not unsure:
        return found
    both = functools.reduce(DataFrame.unionByName, unsure).distinct().join(send(passages.select("item_id", "passage")), "item_id").join(texts.select("unit_id", "text"), "unit_id")
    sure = both.where(F.contains("text", "passage")).select("item_id", "unit_id")
    return sure if few else found.unionByName(sure)
