"""Byte-level BPE encoding and decoding (operator 11).

Pre-tokenisation finds the slices of the public pattern without a regular expression. Every code point has a class, read
from one table; a small automaton over the classes says where slices begin. Its transition functions form a finite monoid
(closed once, by composition), so a function is a number and two functions compose by one table lookup. That composition
is associative, so the automaton runs as a prefix scan: blocks of a batch's code points, all texts one after another, fold
their functions side by side, a scan of the blocks' functions (the same scan, on fewer numbers) gives the state before each
block, and a second sweep, again side by side, gives the state before each code point. States and classes then give
the boundaries by one more lookup. What lies up to two code points ahead (the letters of a contraction, the last of several
white-space characters) is settled by marking an earlier place, so nothing looks ahead.

The distinct slices of a batch feed pair merging by rank (lowest first, leftmost of equals; all new slices side by side)
through a memory of bounded size. The ids of a text come
with their offsets: the end of each id's bytes in the UTF-8 text. Decoding copies token bytes to these places, and any range
of ids decodes on its own.

The classes are those of the tiktoken library itself, asked once in each process which code points its pattern
syntax takes for letters, digits and white space, so that both use one version of Unicode.

Cases: a null or empty text has no ids and decodes to no bytes; a very long text is one value in one task, whole, and long
slices (a run of ideographs, say) merge by a heap in n log n steps; rows that repeat a doc_id, or are equal, are rows of their
own; an empty table gives an empty result; strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, mix64
from .token_files import tokenizer_file

#: Classes of code points. Letters that occur in contractions have classes of their own; END stands after each text.
CLASSES = ["SPACE", "WHITE", "LETTER", "DIGIT", "OTHER", "APOSTROPHE", "STMD", "R", "V", "E", "L", "END"]
SPACE, WHITE, LETTER, DIGIT, OTHER, APOSTROPHE, STMD, R, V, E, L, END = range(len(CLASSES))
#: States: what the last code points were. QUOTE is an apostrophe that begins a slice; AFTER_* follow it; DONE ends a contraction.
STATES = ["START", "IN_LETTERS", "IN_DIGITS", "IN_OTHER", "ONE_SPACE", "ONE_WHITE", "SPACE_LAST", "WHITE_LAST", "QUOTE", "AFTER_R", "AFTER_V", "AFTER_L", "DONE"]
#: Marks: a slice begins at this code point, or at the one before it.
HERE, BEFORE = 1, 2
#: What stands after each text of a batch; no UTF-8 text holds it.
SIGN = "\ud800"
#: Code points of a block of the scan.
BLOCK = 128
#: Characters of the texts that are scanned together.
TOGETHER = 1_000_000
#: Slices of each of the two generations of the memory, and characters of the longest that is remembered.
MEMORY, LONG = 600_000, 64


def step(state: str, c: int) -> tuple[str, int]:
    """The state after a code point of class c, and the marks that it sets."""
    if c == END:
        return "START", HERE | (BEFORE if state.startswith("AFTER") else 0)
    letter = c in (LETTER, STMD, R, V, E, L)
    if state == "QUOTE" and letter:
        if c == STMD:
            return "DONE", 0
        if c in (R, V, L):
            return {R: "AFTER_R", V: "AFTER_V", L: "AFTER_L"}[c], 0
    if state.startswith("AFTER"):
        if c == (L if state == "AFTER_L" else E):
            return "DONE", 0
        after, marks = step("IN_LETTERS", c)  # no contraction: the letter before begins a slice
        return after, marks | BEFORE
    white = state in ("ONE_SPACE", "ONE_WHITE", "SPACE_LAST", "WHITE_LAST")
    if c in (SPACE, WHITE):
        if white:
            return ("SPACE_LAST" if c == SPACE else "WHITE_LAST"), 0
        return ("ONE_SPACE" if c == SPACE else "ONE_WHITE"), HERE
    joins = state in ("ONE_SPACE", "SPACE_LAST")
    kind = "IN_LETTERS" if letter else "IN_DIGITS" if c == DIGIT else "IN_OTHER"
    goes_on = state == kind or state == "QUOTE" and kind == "IN_OTHER"
    marks = (0 if joins or goes_on else HERE) | (BEFORE if state in ("SPACE_LAST", "WHITE_LAST") else 0)
    if c == APOSTROPHE and marks & HERE:
        return "QUOTE", marks
    return kind, marks


class Automaton:
    """Tables of the automaton, and of the monoid of its transition functions."""

    def __init__(self) -> None:
        k = len(CLASSES)
        moves = [[step(s, c) for c in range(k)] for s in STATES]
        self.next = np.array([[STATES.index(s) for s, _ in row] for row in moves], np.uint8)
        self.marks = np.array([[m for _, m in row] for row in moves], np.uint8).ravel()
        number: dict[tuple[int, ...], int] = {}
        for c in range(k):
            number.setdefault(tuple(self.next[:, c].tolist()), len(number))
        generators = list(number)
        self.of_class = np.array([number[tuple(self.next[:, c].tolist())] for c in range(k)], np.int32)
        todo = list(generators)
        while todo:
            f = todo.pop()
            for g in generators:
                h = tuple(g[s] for s in f)
                if h not in number:
                    number[h] = len(number)
                    todo.append(h)
        functions = np.array(list(number), np.uint8)
        self.apply = functions
        self.size = len(number)
        self.then = np.array([[number[tuple(row)] for row in functions[:, f].tolist()] for f in functions], np.int32).ravel()  # [f * size + g]: f, then g

    def before(self, functions: np.ndarray) -> np.ndarray:
        """The state before each of a run of functions that starts in START."""
        n = len(functions)
        if n <= 4 * BLOCK:
            out, s = np.empty(n, np.uint8), 0
            for i, f in enumerate(functions.tolist()):
                out[i] = s
                s = self.apply[f, s]
            return out
        rows = -(-n // BLOCK)
        padded = np.zeros(rows * BLOCK, np.int32)
        padded[:n] = functions
        by_place = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
        whole = by_place[0]
        for g in by_place[1:]:
            whole = self.then[whole * self.size + g]
        state, table = self.before(whole), self.apply.ravel()
        out = np.empty((BLOCK, rows), np.uint8)
        for k, f in enumerate(by_place):
            out[k] = state
            state = table[f * len(STATES) + state]
        return out.T.ravel()[:n]


@functools.cache
def automaton() -> Automaton:
    return Automaton()


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, syntax in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (WHITE, r"\s+")):
        found = bytes(tiktoken.Encoding(f"class-{kind}", pat_str=syntax, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(every)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    for c, kind in ((" ", SPACE), ("'", APOSTROPHE), ("s", STMD), ("t", STMD), ("m", STMD), ("d", STMD), ("r", R), ("v", V), ("e", E), ("l", L)):
        table[ord(c)] = kind
    return table


class Slices:
    """The slices of a batch of texts: each text's, one after another, and then one of SIGN alone."""

    def __init__(self, texts: list[str]):
        self.joined = SIGN.join(texts) + SIGN
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        self.points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = classes()[self.points]
        kinds[ends] = END
        a = automaton()
        marks = a.marks[a.before(a.of_class[kinds]).astype(np.int32) * len(CLASSES) + kinds]
        begins = (marks & HERE) > 0
        begins[:-1] |= (marks[1:] & BEFORE) > 0
        self.at = np.flatnonzero(begins)
        self.lengths = np.diff(self.at, append=len(self.points))
        self.signs = np.searchsorted(self.at, ends)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Slices (by number) that stand for all, and which of them each slice equals. Slices with one hash are compared
        with the first of them, code point by code point; one that differs stands for itself."""
        place = np.arange(len(self.points))
        power = np.full(int(self.lengths.max(initial=0)), 0x9E3779B97F4A7C15, np.uint64).cumprod(dtype=np.uint64)
        hashes = mix64(np.add.reduceat((self.points + np.uint64(1)) * power[place - np.repeat(self.at, self.lengths)], self.at))
        _, first, like = np.unique(hashes, return_index=True, return_inverse=True)
        model = first[like]
        off = self.lengths[model] != self.lengths
        there = np.minimum(np.repeat(self.at[model] - self.at, self.lengths) + place, len(place) - 1)
        off |= np.logical_or.reduceat(self.points[there] != self.points, self.at)
        like[off] = len(first) + np.arange(off.sum())
        return np.concatenate([first, np.flatnonzero(off)]), like

    def strings(self, some: np.ndarray) -> list[str]:
        starts = self.at[some]
        return [self.joined[i:j] for i, j in zip(starts.tolist(), (starts + self.lengths[some]).tolist())]


def run_of_runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, run after run."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merger:
    """Pair merging of slices' bytes by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.never = ranks, 1 + max(ranks.values())
        # all pairs of tokens whose bytes together are a token, by (first << 32 | second), and that token
        pairs = sorted((i << 32 | j, r) for t, r in ranks.items() for k in range(1, len(t)) if (i := ranks.get(t[:k])) is not None and (j := ranks.get(t[k:])) is not None)
        self.pairs, self.made = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def _ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        wanted = first << 32 | second
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.made[at], self.never)

    def __call__(self, pieces: list[bytes]) -> list[list[int]]:
        """Merged ids of each piece; no piece is empty."""
        out: list[list[int] | None] = [[r] if (r := self.ranks.get(p)) is not None else self._long(p) if len(p) > LONG else None for p in pieces]
        some = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(some, self._short([pieces[k] for k in some])):
            out[k] = ids
        return out

    def _short(self, pieces: list[bytes]) -> list[list[int]]:
        """All pieces side by side: in each round every piece that still has a pair of tokens to merge merges its best one."""
        ids = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        sizes = np.array([len(p) for p in pieces], np.int64)
        out: list[list[int]] = [[]] * len(pieces)
        own = np.arange(len(pieces))
        starts = np.cumsum(sizes) - sizes
        pair = np.full(len(ids), self.never, np.int64)
        pair[:-1] = self._ranks(ids[:-1], ids[1:])
        pair[starts[1:] - 1] = self.never
        while len(own):
            place = np.arange(len(ids))
            best = np.minimum.reduceat(pair << 32 | place, starts)
            done = (best >> 32) == self.never
            if done.any():
                for k, i, n in zip(own[done].tolist(), starts[done].tolist(), sizes[done].tolist()):
                    out[k] = ids[i : i + n].tolist()
                stays = np.repeat(~done, sizes)
                moved = np.cumsum(stays) - 1
                ids, pair, own, sizes, best = ids[stays], pair[stays], own[~done], sizes[~done], best[~done]
                starts = np.cumsum(sizes) - sizes
                at = moved[best & 0xFFFFFFFF]
            else:
                at = best & 0xFFFFFFFF
            if not len(own):
                break
            ids[at] = best >> 32
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            at -= np.arange(len(at))
            ids, pair, sizes = ids[stays], pair[stays], sizes - 1
            starts = np.cumsum(sizes) - sizes
            left = at[at > starts] - 1
            pair[left] = self._ranks(ids[left], ids[left + 1])
            last = at + 1 == starts + sizes
            pair[at[last]] = self.never
            at = at[~last]
            pair[at] = self._ranks(ids[at], ids[at + 1])
        return out

    def _long(self, piece: bytes) -> list[int]:
        """The same with a heap of (rank, start): a pair is out of date if its bytes are no longer those of two neighbours."""
        rank, n = self.ranks.get, len(piece)
        end = list(range(1, n + 1))  # end of the part that starts here, or 0 where none starts any more
        start = list(range(-1, n))  # start of the part that ends here
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or j >= n or end[j] != k:
                continue
            end[i], end[j], start[k] = k, 0, i
            if i and (r := rank(piece[start[i] : k])) is not None:
                heapq.heappush(heap, (r, start[i], i, k))
            if k < n and (r := rank(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, k, end[k]))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out


class Encoder:
    """ids of whole texts. Two generations of remembered slices: when the young one is full it becomes the old one, and what
    is met again there moves on, so common slices stay and memory is bounded."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.merge, self.memory = Merger(read_ranks(path)), memory
        self.young: dict[str, bytes] = {SIGN: b""}
        self.old: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of slices that the young generation does not hold; those that are not too long are remembered."""
        if len(self.young) + len(new) > self.memory:
            self.old, self.young = self.young, {SIGN: b""}
        found = {s: ids for s in new if (ids := self.old.get(s)) is not None}
        rest = [s for s in new if s not in found]
        merged = self.merge([s.encode() for s in rest])
        sizes = np.array([len(m) for m in merged], np.int64)
        raw = np.fromiter(itertools.chain.from_iterable(merged), "<i4", int(sizes.sum())).tobytes()
        ends = (4 * np.cumsum(sizes)).tolist()
        found.update((s, raw[j - 4 * len(m) : j]) for s, m, j in zip(rest, merged, ends))
        self.young.update((s, ids) for s, ids in found.items() if len(s) <= LONG)
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the number of ids of each. Texts are taken some TOGETHER characters at
        a time, which bounds the arrays; a longer one is alone."""
        part = (np.cumsum([len(t) for t in texts]) - 1) // TOGETHER if texts else np.empty(0, np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        ids, counts = zip(*(self._encode(texts[i:j]) for i, j in zip(cuts, cuts[1:]) if i < j)) if texts else ([np.empty(0, "<i4")], [np.empty(0, np.int64)])
        return np.concatenate(ids), np.concatenate(counts)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        slices = Slices(texts)
        models, like = slices.distinct()
        names = slices.strings(models)
        known = [self.young.get(s) for s in names]
        missing = [k for k, x in enumerate(known) if x is None]
        if missing:
            new = self._learn(list({names[k] for k in missing}))
            for k in missing:
                known[k] = new[names[k]]
        sizes = np.array([len(x) // 4 for x in known], np.int64)
        counts = sizes[like]
        ids = np.frombuffer(b"".join(known), "<i4")[run_of_runs((np.cumsum(sizes) - sizes)[like], counts)]
        upto = np.cumsum(counts)[slices.signs]
        return ids, np.diff(upto, prepend=0)


@functools.lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.lru_cache(2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens, one after another, and where each id's begin; the last entry is the end."""
    ranks = read_ranks(path)
    by_id = [b""] * (1 + max(ranks.values()))
    for token, i in ranks.items():
        by_id[i] = token
    return np.frombuffer(b"".join(by_id), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in by_id])])


def encode_batch(b: pa.RecordBatch, path: str) -> pa.RecordBatch:
    ids, counts = _encoder(path).encode(b.column(1).to_pylist())
    offsets = np.concatenate([[0], np.cumsum(counts)])
    _, starts = token_bytes(path)
    ends = np.concatenate([[0], np.cumsum((starts[1:] - starts[:-1])[ids])])
    rows = pa.array(offsets.astype(np.int32))
    in_text = ends[1:] - np.repeat(ends[offsets[:-1]], counts)
    return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(rows, pa.array(ids)), pa.ListArray.from_arrays(rows, pa.array(in_text.astype(np.int32)))], names=["doc_id", "ids", "ends"])


def decode_batch(b: pa.RecordBatch, path: str) -> pa.RecordBatch:
    table, starts = token_bytes(path)
    ids, ends = (b.column(k).flatten().to_numpy() for k in (1, 2))
    counts = b.column(1).value_lengths().to_numpy()
    sizes = (starts[1:] - starts[:-1])[ids]
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    full = counts > 0
    base = np.zeros(len(counts), np.int64)  # where the range begins in its text
    base[full] = ends[first[full]] - sizes[first[full]]
    length = np.zeros(len(counts), np.int64)
    length[full] = ends[(first + counts - 1)[full]] - base[full]
    rows = np.concatenate([[0], np.cumsum(length)])
    to = ends - sizes + np.repeat(rows[:-1] - base, counts)
    out = np.zeros(rows[-1], np.uint8)
    for k in range(1, int(sizes.max(initial=0)) + 1):  # the k-th byte of every token that has one
        some = np.flatnonzero(sizes >= k)
        out[to[some] + (k - 1)] = table[starts[ids[some]] + (k - 1)]
    binary = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(rows.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])
    return pa.RecordBatch.from_arrays([*b.columns[:3], binary], names=["doc_id", "ids", "ends", "decoded"])


ENCODED = "doc_id long, ids array<int>, ends array<int>"


def encode(docs: DataFrame, tokenizer: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, ids, ends: where the bytes of each id end in the text's UTF-8."""
    path = tokenizer_file(tokenizer)
    return doc_texts(docs).mapInArrow(lambda batches: (encode_batch(b, path) for b in batches if b.num_rows), ENCODED)


def decode(encoded: DataFrame, tokenizer: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Rows of encode, or ranges of theirs with the ends to match, with their bytes as column decoded; a token's bytes are copied to where ends says."""
    path = tokenizer_file(tokenizer)
    return encoded.select("doc_id", "ids", "ends").mapInArrow(lambda batches: (decode_batch(b, path) for b in batches), ENCODED + ", decoded binary")


def digests(docs: DataFrame, tokenizer: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas), decoded_sha256. One worker of a task encodes a
    batch and decodes it again."""
    path = tokenizer_file(tokenizer)
    both = doc_texts(docs).mapInArrow(lambda batches: (decode_batch(encode_batch(b, path), path) for b in batches if b.num_rows), ENCODED + ", decoded binary")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
