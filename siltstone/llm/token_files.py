"""Token-ID output: Arrow stream files of fixed-size-list batches (operator 7).

Every document becomes token ids plus an end id. Documents are dealt to files by ranges of doc_id, so that files in
name order hold the corpus in doc_id order. A file is one Arrow stream; each of its batches has the columns ids
(fixed-size list of the narrowest unsigned integer that holds the vocabulary) and mask (fixed-size list of booleans,
false where the last sequence is padded). Sequences have equal length, so sequence k of a batch is at a fixed offset
of its buffer and is read without a copy from a memory map. Documents run on from one sequence to the next; an index table tells where each one lies.

Encoding: space-separated chunks repeat a lot, and this tokenizer drops white space before it merges, so a document's ids
are its chunks' ids one after another; each worker keeps a bounded memory of chunks it has encoded. Whether a tokenizer does so,
and whether case counts for nothing and stops part from letters, it is asked by a few words; if not, it gets whole texts.

Cases: a null or empty text has the end id alone; rows that repeat a doc_id follow each other, ordered by text hash, and
rows that tie in both are equal; a very long text is one value in one task, whole, and may fill many sequences;
an empty table writes no file. Files are written under a name of their own and renamed, so a task that runs twice
leaves one whole file.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_texts, materialize, workspace

SEQUENCE, BATCH_SEQUENCES = 2_048, 64
END_ID = 1
#: Rows that one file gets on average.
FILE_ROWS = 20_000
STOPS = ".,;:!?"
#: What a code point below 128 is to chunks (127 stands for all others), and where a chunk begins after another, by both.
BLANK, LOWER, UPPER, STOP = 1, 2, 4, 5
KINDS = np.array([BLANK if c == 32 else LOWER if 97 <= c <= 122 else UPPER if 65 <= c <= 90 else STOP if chr(c) in STOPS else 0 for c in range(128)], np.uint8)
ENDS_AT_BLANKS = np.array([a == BLANK for a in range(8) for _ in range(8)])
ENDS = np.array([a == BLANK or {a, b} in ({LOWER, STOP}, {UPPER, STOP}) for a in range(8) for b in range(8)])
#: Characters of the texts that are encoded together.
TOGETHER_CHARS = 3_000_000
#: Chunks of each of the two generations that are remembered (the young one takes a batch's more).
MEMORY = 600_000
#: Characters of the longest chunk that is remembered.
LONG = 64
#: Chunks of one call to the tokenizer, and the sign between them: alone between spaces it is a token by itself.
TOGETHER, SIGN = 200, "→"
_memory: dict[tuple, tuple[dict[str, bytes], dict[str, bytes]]] = {}


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """ids of whole texts by way of their space-separated chunks."""

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), memory
        self.known, self.old = _memory.setdefault((path, memory), ({}, {}))
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.sign = self.tokenizer.encode(SIGN, add_special_tokens=False).ids
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        # only then are a text's ids those of its chunks; other tokenizers encode whole texts
        self.drops_space = ids(" ab  cd ") == ids("ab") + ids("cd")
        # more texts share chunks if case counts for nothing, and if letters part from the stops beside them
        self.lowers = self.drops_space and ids("Ab BA") == ids("ab ba")
        self.parts = self.drops_space and all(ids(f"ab{p}{p}cd,.") == ids("ab") + ids(p + p) + ids("cd") + ids(",.") for p in STOPS)

    def _ids(self, chunks: list[str]) -> dict[str, bytes]:
        plain = [c for c in chunks if SIGN not in c]
        parts = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        out, size = {}, self.type.itemsize
        for part, got in zip(parts, self.tokenizer.encode_batch_fast([f" {SIGN} ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(got.ids, self.type)
            ends = np.flatnonzero(ids == self.sign[0])
            if len(self.sign) == 1 and len(ends) == len(part) - 1:
                raw, starts = ids.tobytes(), [0, *(size * (ends + 1)).tolist()]
                out.update({c: raw[i:j] for c, i, j in zip(part, starts, [*(size * ends).tolist(), len(raw)])})
        for c in chunks:  # those with the sign in them, and all if the sign isn't a token by itself here
            if c not in out:
                out[c] = np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, self.type).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of self.type. Texts are taken some TOGETHER_CHARS at a time; a longer one is alone."""
        if not self.drops_space:
            return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.type).tobytes() for t in texts]
        part = (np.cumsum([len(t) for t in texts]) - 1) // TOGETHER_CHARS if texts else np.empty(0, np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        return [ids for i, j in zip(cuts, cuts[1:]) if i < j for ids in self._encode(texts[i:j])]

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Each distinct chunk is looked up once. Chunks are remembered in two generations: when the young one has reached the
        limit it becomes the old one, and what is met again there moves on."""
        from .byte_bpe import run_of_runs

        chunks = chunks_of(texts, self.lowers, self.parts)
        models, like = chunks.distinct()
        names = [c.removesuffix(" ") for c in chunks.strings(models)]
        known = [self.known.get(c) for c in names]
        missing = [k for k, x in enumerate(known) if x is None]
        if missing:
            new = {names[k]: self.old.get(names[k]) for k in missing}  # a chunk may be there with and without its blank
            new.update(self._ids([c for c, x in new.items() if x is None]))
            for k in missing:
                known[k] = new[names[k]]
            self.known.update((c, x) for c, x in new.items() if len(c) <= LONG)
            if len(self.known) > self.limit:
                self.old.clear()
                self.old.update(self.known)
                self.known.clear()
        sizes = np.array([len(x) // self.type.itemsize for x in known], np.int64)
        counts = sizes[like]
        ids = np.frombuffer(b"".join(known), self.type)[run_of_runs((np.cumsum(sizes) - sizes)[like], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])[chunks.signs].tolist()
        return [ids[i:j].tobytes() for i, j in zip([0, *ends], ends)]


def chunks_of(texts: list[str], lowers: bool, parts: bool):
    """The space-separated chunks of all texts, one after another, each with the blank that ends it; with lowers A-Z are a-z, with
    parts a chunk also ends between an ASCII letter and one of STOPS. signs has the number of chunks up to each text's end."""
    from .byte_bpe import Slices

    class Chunks(Slices):
        def __init__(self):
            self.joined = " ".join(texts) + " "
            p = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), "<u4")
            kind = KINDS[np.minimum(p, 127)]
            if lowers:
                p = p + (kind == UPPER) * np.uint32(32)
                self.joined = p.tobytes().decode("utf-32-le", "surrogatepass")
            begins = np.concatenate([[True], (ENDS if parts else ENDS_AT_BLANKS)[kind[:-1] * 8 + kind[1:]]])
            self.points, self.at = p, np.flatnonzero(begins)
            self.lengths = np.diff(self.at, append=len(p))
            self.signs = np.searchsorted(self.at, np.cumsum([len(t) + 1 for t in texts]) - 1, side="right")

    return Chunks()


def encoded(docs: DataFrame, path: str, end_id: int | None = END_ID, ends: Sequence[int] = ()) -> DataFrame:
    """doc_id, ids (bytes of the encoder's type, the end id included), text_hash, file: the number of ends of ranges below
    the doc_id."""
    cuts = docs.sparkSession.sparkContext.broadcast(np.array(ends, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path)
        end = b"" if end_id is None else np.array([end_id], encoder.type).tobytes()
        for b in batches:
            ids = [x + end for x in encoder.encode(b.column(1).to_pylist())]
            file = np.searchsorted(cuts.value, b.column(0).to_numpy(), side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), b.column(2), pa.array(file)], names=["doc_id", "ids", "text_hash", "file"])

    rows = doc_texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, text_hash long, file int")


def range_ends(docs: DataFrame, file_rows: int = FILE_ROWS) -> list[int]:
    """Ends of doc_id ranges of about file_rows rows: approximate quantiles, one number a file."""
    ids = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"))
    files = max(1, -(-ids.count() // file_rows))
    if files == 1:
        return []
    cuts = ids.agg(F.percentile_approx("doc_id", [k / files for k in range(1, files)], max(10_000, 20 * files))).first()[0]
    return sorted(set(cuts))


def _sink(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, folder: str, path: str, sequence: int = SEQUENCE, end_id: int | None = END_ID, file_rows: int = FILE_ROWS) -> DataFrame:
    """Writes the files to folder and returns the index: doc_id, file, position in the file, n_tokens, row (the
    document's place in its file). Materialized."""
    ends = range_ends(docs, file_rows)
    rows = encoded(docs, path, end_id, ends)
    kind = ChunkEncoder(path).type
    dealt = rows.repartitionById(len(ends) + 1, F.col("file")).sortWithinPartitions("doc_id", "text_hash")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _sink(folder)
        files.create_dir(base, recursive=True)
        out = None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                number = b.column(3)[0].as_py()
                name, own = f"tokens-{number:08d}.arrows", f"{base}/.{uuid.uuid4().hex}"
                out = SequenceWriter(files.open_output_stream(own), sequence, kind)
            sizes = np.array([len(x) // kind.itemsize for x in b.column(1).to_pylist()], np.int64)
            starts = out.length + np.cumsum(sizes) - sizes
            first = out.documents
            out.write(np.frombuffer(b"".join(b.column(1).to_pylist()), kind), len(sizes))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * len(sizes)), pa.array(starts), pa.array(sizes), pa.array(np.arange(first, first + len(sizes)))], names=["doc_id", "file", "position", "n_tokens", "row"])
        if out is not None:
            out.close()
            files.move(own, f"{base}/{name}")

    index = dealt.mapInArrow(write, "doc_id long, file string, position long, n_tokens long, row long")
    return materialize(index, folder.rstrip("/") + "-index")


class SequenceWriter:
    """Cuts a run of ids into sequences and writes them in batches of BATCH_SEQUENCES."""

    def __init__(self, sink, sequence: int, kind: np.dtype):
        ids, mask = pa.list_(pa.from_numpy_dtype(kind), sequence), pa.list_(pa.bool_(), sequence)
        self.schema = pa.schema([pa.field("ids", ids), pa.field("mask", mask)])
        self.sink, self.sequence, self.length, self.documents = sink, sequence, 0, 0
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.rest = np.empty(0, kind)

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def write(self, ids: np.ndarray, documents: int) -> None:
        self.length += len(ids)
        self.documents += documents
        ids = np.concatenate([self.rest, ids])
        step = self.sequence * BATCH_SEQUENCES
        whole = len(ids) // step * step
        for k in range(0, whole, step):
            self._batch(ids[k : k + step], step)
        self.rest = ids[whole:]

    def close(self) -> None:
        if len(self.rest):
            padded = np.zeros(-(-len(self.rest) // self.sequence) * self.sequence, self.rest.dtype)
            padded[: len(self.rest)] = self.rest
            self._batch(padded, len(self.rest))
        self.writer.close()
        self.sink.close()


def read_sequences(folder: str, file: str) -> tuple[list[pa.RecordBatch], np.ndarray]:
    """The batches of one file and the first sequence of each; local files are memory-mapped, not copied."""
    files, base = _sink(folder)
    source = pa.memory_map(f"{base}/{file}") if isinstance(files, pafs.LocalFileSystem) else files.open_input_file(f"{base}/{file}")
    batches = list(pa.ipc.open_stream(source))
    return batches, np.cumsum([0] + [b.num_rows for b in batches])


def sequence_at(batches: list[pa.RecordBatch], firsts: np.ndarray, k: int) -> tuple[pa.Array, pa.Array]:
    """Views (no copy) of the ids and the mask of sequence k."""
    b = int(np.searchsorted(firsts, k, side="right")) - 1
    columns = [batches[b].column(name) for name in ("ids", "mask")]
    at = [c.flatten().slice((k - firsts[b]) * c.type.list_size, c.type.list_size) for c in columns]
    return at[0], at[1]


def read_documents(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read back from the files."""
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = {}
    running = 0
    for r in totals.orderBy("file").toLocalIterator():  # one row a file
        before[r.file], running = running, running + r.total
    shared = spark.sparkContext.broadcast(before)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, stream = None, None
        for b in batches:
            crcs, starts = [], []
            for file, position, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if file != opened:
                    parts, _ = read_sequences(folder, file)
                    stream, opened = [p.column("ids").flatten().to_numpy() for p in parts], file
                    ends = np.cumsum([len(x) for x in stream])
                crc, at, left = 0, position, n
                while left:
                    k = int(np.searchsorted(ends, at, side="right"))
                    offset = at - (ends[k] - len(stream[k]))
                    piece = stream[k][offset : offset + left]
                    crc = zlib.crc32(piece.astype("<u4"), crc)
                    at, left = at + len(piece), left - len(piece)
                crcs.append(crc)
                starts.append(shared.value[file] + position)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(starts, pa.int64()), b.column(3), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return index.select("doc_id", "file", "position", "n_tokens").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", sequence: int = SEQUENCE, end_id: int | None = END_ID, file_rows: int = FILE_ROWS) -> DataFrame:
    spark = docs.sparkSession
    folder = workspace(spark) + "/tokens"
    index = write_token_files(docs, folder, tokenizer_file(tokenizer), sequence, end_id, file_rows)
    return read_documents(spark, folder, index)
