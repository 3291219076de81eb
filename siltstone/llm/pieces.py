"""SentencePiece encoding and decoding with the n best segmentations (operator 4).

The pieces come from a model file; a piece's log-probability follows the Zipf-Mandelbrot law of its rank in the model.
A text is normalised as the model does (a leading space sign, spaces to the sign) and no piece runs from a word into
the next sign, so the lattice falls into chunks; a long chunk without signs falls apart further wherever no piece runs
across. Forward Viterbi scores of all new chunks of a batch are computed at
once in numpy, together with each chunk's loss for its second-best segmentation. Only the n - 1 chunks with the least
losses can differ from their best segmentation in one of the text's n best (any other change is beaten by n - 1
single changes); over the lattice of these chunks, backward A-star search takes the forward scores as its exact
heuristic and pops the n best paths in order.

Characters without a piece become byte pieces. Decoding joins pieces, turns signs and byte pieces back, and drops the
leading space, so that decode(encode(text)) is the text (a sign U+2581 in a text comes back as a space).

Cases: a null or empty text has no pieces, one segmentation of score 0 and round-trips; a text with fewer than n
segmentations returns all of them; equal scores keep a fixed order; a very long text is one value in one task, its work
in proportion to its length, spaces or not; repeated rows are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
import zlib
from functools import lru_cache
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, mix64

SIGN = "▁"
N_BEST = 4
#: Zipf-Mandelbrot offset, and the score of a byte piece.
OFFSET, BYTE_SCORE = 2.7, -16.0
#: Chunks of each of the two generations that are remembered (the young one takes a batch's more).
MEMORY = 400_000
#: Characters of the longest chunk that is remembered, or scored beside others of its length.
LONG = 64
_CHUNK = re.compile(f"{SIGN}+[^{SIGN}]*")
_BASE = 0x9E3779B97F4A7C15
_known: dict[str, tuple[dict[str, tuple[bytes, float, float]], dict[str, tuple[bytes, float, float]]]] = {}


def model_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.path = path
        total = math.log(sum(1 / (r + OFFSET) for r in range(size)))
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        self.raw = [b""] * size
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                rank = min(-sp.get_score(i), size)
                # multiples of 2**-20: sums are exact, so equal segmentations compare as equal
                self.id[piece], self.score[piece] = i, round((-math.log(rank + OFFSET) - total) * (1 << 20)) / (1 << 20)
                self.raw[i] = piece.replace(SIGN, " ").encode()
        self.longest = max(map(len, self.id))
        pieces = list(self.id)
        h = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(h)
        self.hashes = h[order]
        self.table_id = np.array([self.id[p] for p in pieces], np.int32)[order]
        self.table_score = np.array([self.score[p] for p in pieces])[order]
        # whether any piece's hash begins with these bits: small enough for a cache, it spares most searches
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.hashes >> np.uint64(42)).astype(np.int64)] = True
        self.known, self.old = _known.setdefault(path, ({}, {}))

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in mix64(np.frombuffer(piece.encode("utf-32-le"), "<u4").astype(np.uint64)).tolist():
            h = (h * _BASE + c) % (1 << 64)
        return h

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and their places in the table."""
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        fine = self.hashes[at] == hashes[some]
        return some[fine], at[fine]

    def edges(self, chunk: str) -> list[list[tuple[int, float, bytes]]]:
        """For each end position: (start, score, ids) of the lattice's edges into it, longest first."""
        out: list[list[tuple[int, float, bytes]]] = [[] for _ in range(len(chunk) + 1)]
        for j in range(1, len(chunk) + 1):
            for i in range(max(0, j - self.longest), j):
                s = self.score.get(chunk[i:j])
                if s is not None:
                    out[j].append((i, s, np.array([self.id[chunk[i:j]]], "<u2").tobytes()))
                elif j - i == 1:
                    raw = chunk[i:j].encode()
                    out[j].append((i, BYTE_SCORE * len(raw), np.array([self.byte[b] for b in raw], "<u2").tobytes()))
        return out

    def forward(self, edges: list[list[tuple[int, float, bytes]]]) -> list[float]:
        alpha = [0.0]
        for into in edges[1:]:
            alpha.append(max(alpha[i] + s for i, s, _ in into))
        return alpha

    def pieces_in(self, chunk: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, score, id) of all edges of a chunk's lattice, by size; -1 stands for byte pieces."""
        points = np.frombuffer(chunk.encode("utf-32-le"), "<u4")
        codes = mix64(points.astype(np.uint64))
        n, h = len(points), np.zeros(len(points), np.uint64)
        out = []
        for size in range(1, min(self.longest, n) + 1):
            h = h[: n - size + 1] * np.uint64(_BASE) + codes[size - 1 :]
            start, at = self.found(h)
            out.append((start, np.full(len(start), size), self.table_score[at], self.table_id[at]))
            if size == 1:
                miss = np.ones(n, bool)
                miss[start] = False
                rest = np.flatnonzero(miss)
                octets = 1 + (points[rest] >= 0x80) + (points[rest] >= 0x800) + (points[rest] >= 0x10000)
                out.append((rest, np.ones(len(rest), int), BYTE_SCORE * octets, np.full(len(rest), -1)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def fall_apart(self, chunk: str) -> list[str]:
        """The parts of a chunk across whose ends no piece runs: their lattices are independent."""
        if len(chunk) <= LONG:
            return [chunk]
        start, size, _, _ = self.pieces_in(chunk)
        inside = np.zeros(len(chunk) + 1, np.int64)
        np.add.at(inside, start + 1, 1)
        np.add.at(inside, start + size, -1)
        cuts = [0, *(np.flatnonzero(np.cumsum(inside)[1:-1] == 0) + 1).tolist(), len(chunk)]
        return [chunk[i:j] for i, j in zip(cuts, cuts[1:])]

    def _learn_long(self, chunk: str) -> tuple[bytes, float, float]:
        """What learn gives for one long chunk: edges come from numpy, the recursions go through them once."""
        start, size, score, ids = self.pieces_in(chunk)
        n = len(chunk)
        by = np.lexsort((-size, start + size))
        start, size, score, ids = start[by], size[by], score[by], ids[by]
        alpha, taken = np.full(n + 1, -np.inf).tolist(), [0] * (n + 1)
        alpha[0] = 0.0
        for k, (i, w, s) in enumerate(zip(start.tolist(), size.tolist(), score.tolist())):
            if alpha[i] + s > alpha[i + w]:
                alpha[i + w], taken[i + w] = alpha[i] + s, k
        beta = np.full(n + 1, -np.inf).tolist()
        beta[n] = 0.0
        back = np.argsort(-start, kind="stable")
        for i, w, s in zip(start[back].tolist(), size[back].tolist(), score[back].tolist()):
            beta[i] = max(beta[i], s + beta[i + w])
        path, j = [], n
        while j:
            path.append(taken[j])
            j = int(start[taken[j]])
        path.reverse()
        through = np.array(alpha)[start] + score + np.array(beta)[start + size]
        through[path] = -np.inf
        own = b"".join(np.array([ids[k]] if ids[k] >= 0 else [self.byte[b] for b in chunk[start[k]].encode()], "<u2").tobytes() for k in path)
        return own, alpha[n], alpha[n] - float(through.max())

    def learn(self, chunks: list[str]) -> dict[str, tuple[bytes, float, float]]:
        """Best ids, their score, and the loss of the second-best segmentation (infinite if there is none)."""
        out = {}
        by_length: dict[int, list[str]] = {}
        for c in chunks:
            by_length.setdefault(len(c), []).append(c)
        for n, some in by_length.items():
            if n > LONG:
                out.update({c: self._learn_long(c) for c in some})
                continue
            for k in range(0, len(some), step := max(1, 200_000 // n)):
                self._learn(some[k : k + step], n, out)
        return out

    def _learn(self, chunks: list[str], n: int, out: dict) -> None:
        m = len(chunks)
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4").reshape(m, n)
        codes = mix64(points.astype(np.uint64))
        width = min(self.longest, n)
        scores = np.full((n, width + 1, m), -np.inf)
        ids = np.full((n, width + 1, m), -1, np.int32)
        h = [np.zeros(m, np.uint64) for _ in range(n)]
        for size in range(1, width + 1):
            for i in range(n - size + 1):
                h[i] = h[i] * np.uint64(_BASE) + codes[:, i + size - 1]
                hit, at = self.found(h[i])
                scores[i, size, hit], ids[i, size, hit] = self.table_score[at], self.table_id[at]
                if size == 1 and len(hit) < m:
                    miss = np.ones(m, bool)
                    miss[hit] = False
                    rest = np.flatnonzero(miss)
                    p = points[rest, i]
                    scores[i, 1, rest] = BYTE_SCORE * (1 + (p >= 0x80).astype(int) + (p >= 0x800) + (p >= 0x10000))
        alpha, choice = np.full((n + 1, m), -np.inf), np.zeros((n + 1, m), np.int64)
        alpha[0] = 0
        for j in range(1, n + 1):
            for size in range(min(width, j), 0, -1):
                s = alpha[j - size] + scores[j - size, size]
                better = s > alpha[j]
                alpha[j, better], choice[j, better] = s[better], size
        beta = np.full((n + 1, m), -np.inf)
        beta[n] = 0
        for i in range(n - 1, -1, -1):
            for size in range(1, min(width, n - i) + 1):
                beta[i] = np.maximum(beta[i], scores[i, size] + beta[i + size])
        rows = np.arange(m)
        taken = np.zeros((n, width + 1, m), bool)
        path = np.full((n, m), -2, np.int32)
        at = np.full(m, n)
        while (at > 0).any():
            live = at > 0
            size = choice[at[live], rows[live]]
            at[live] -= size
            taken[at[live], size, rows[live]] = True
            path[at[live], rows[live]] = ids[at[live], size, rows[live]]
        second = np.full(m, -np.inf)
        for i in range(n):
            for size in range(1, min(width, n - i) + 1):
                s = alpha[i] + scores[i, size] + beta[i + size]
                s[taken[i, size]] = -np.inf
                second = np.maximum(second, s)
        loss = alpha[n] - second
        path = path.T
        whole = (path != -1).all(axis=1)
        flat = path[path > -1].astype("<u2").tobytes()
        ends = 2 * np.cumsum((path > -1).sum(axis=1))
        start = 0
        for c, p, fine, end, s, d in zip(chunks, path, whole.tolist(), ends.tolist(), alpha[n].tolist(), loss.tolist()):
            own = flat[start:end]
            start = end
            if not fine:  # byte pieces
                got = [np.array([self.byte[b] for b in c[i].encode()], "<u2").tobytes() if x == -1 else np.array([x], "<u2").tobytes() for i, x in enumerate(p.tolist()) if x != -2]
                own = b"".join(got)
            out[c] = (own, s, d)

    def lattice(self, chunk: str) -> tuple[list[list[tuple[int, float, bytes]]], list[float]]:
        edges = self.edges(chunk)
        return edges, self.forward(edges)

    def best_paths(self, chunks: list[str], n: int) -> list[tuple[float, list[bytes]]]:
        """The n best segmentations of the chunks one after another: (score, ids of each chunk), best first."""
        lattices = [_lattice(self, c) if len(c) <= LONG else self.lattice(c) for c in chunks]
        before = list(itertools.accumulate((a[-1] for _, a in lattices), initial=0.0))
        counter = itertools.count(0, -1)  # of equal nodes the latest goes first: ties don't widen the search
        # a node is (chunk, position); what is known of a path is the part behind it
        heap = [(-before[-1], next(counter), len(chunks), 0, 0.0, None)]
        out: list[tuple[float, list[bytes]]] = []
        while heap and len(out) < n:
            _, _, c, j, behind, path = heapq.heappop(heap)
            if j == 0:
                if c == 0:
                    ids: list[list[bytes]] = [[] for _ in chunks]
                    while path is not None:
                        k, piece, path = path
                        ids[k].append(piece)
                    out.append((behind, [b"".join(x) for x in ids]))
                    continue
                c, j = c - 1, len(chunks[c - 1])
            edges, alpha = lattices[c]
            for i, s, piece in edges[j]:
                heapq.heappush(heap, (-(behind + s + before[c] + alpha[i]), next(counter), c, i, behind + s, (c, piece, path)))
        return out

    def encode(self, texts: list[str], n: int) -> list[list[tuple[float, bytes]]]:
        """For each text its n best segmentations: (score, ids as little-endian uint16)."""
        split = [_CHUNK.findall(SIGN + t.replace(" ", SIGN)) if t else [] for t in texts]
        for k, chunks in enumerate(split):
            if chunks and max(map(len, chunks)) > LONG:
                split[k] = [p for c in chunks for p in self.fall_apart(c)]
        missing = set().union(*split) - self.known.keys()
        new = {c: x for c in missing if (x := self.old.get(c)) is not None}
        new.update(self.learn([c for c in missing if c not in new]))
        self.known.update((c, x) for c, x in new.items() if len(c) <= LONG)
        new = {c: x for c, x in new.items() if len(c) > LONG}
        known, out = self.known, []
        for chunks in split:
            got = [known.get(c) or new[c] for c in chunks] if new else list(map(known.__getitem__, chunks))
            ids = list(map(itemgetter(0), got))
            best = sum(map(itemgetter(1), got))
            if n == 1 or not chunks:
                out.append([(best, b"".join(ids))])
                continue
            loss = np.fromiter(map(itemgetter(2), got), float, len(got))
            free = np.flatnonzero(np.isfinite(loss))
            if len(free) > n - 1:
                free = np.sort(free[np.argsort(loss[free], kind="stable")[: n - 1]])
            rest = best - sum(got[k][1] for k in free)
            own = []
            for score, pieces in self.best_paths([chunks[k] for k in free], n):
                for k, p in zip(free, pieces):
                    ids[k] = p
                own.append((rest + score, b"".join(ids)))
            out.append(own)
        if len(known) > MEMORY:  # the young generation becomes the old one; what is met again there moves on
            self.old.clear()
            self.old.update(known)
            known.clear()
        return out

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u2").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=5_000)
def _lattice(model: PieceModel, chunk: str):
    return model.lattice(chunk)


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, model: str = "piece_bpe_32k.model", n_best: int = N_BEST) -> DataFrame:
    """doc_id and segmentations, best first: array of (score, ids)."""
    path = model_file(model)

    def make():
        m = load(path)

        def each(ids, texts):
            found = m.encode(texts, n_best)
            return {"doc_id": ids, "segmentations": [[{"score": s, "ids": np.frombuffer(x, "<u2").astype(np.int32)} for s, x in f] for f in found]}

        return each

    return map_texts(docs, make, "doc_id long, segmentations array<struct<score:double,ids:array<int>>>")


def decode_pieces(rows: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, text of rows with doc_id and ids (array of int)."""
    import pyarrow as pa

    path = model_file(model)

    def run(batches):
        m = load(path)
        for b in batches:
            texts = [m.decode(np.array(x if x is not None else [], "<u2").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, model: str = "piece_bpe_32k.model", n_best: int = N_BEST) -> DataFrame:
    """doc_id, n_pieces and score of the best segmentation, scores and CRC-32 (of little-endian uint16 ids) of the n
    best, and whether the best one decodes to the text."""
    path = model_file(model)

    def make():
        m = load(path)

        def each(ids, texts):
            found = m.encode(texts, n_best)
            return {
                "doc_id": ids, "n_pieces": [len(f[0][1]) // 2 for f in found], "score": [f[0][0] for f in found],
                "nbest_scores": [[s for s, _ in f] for f in found], "nbest_crc32": [[zlib.crc32(x) for _, x in f] for f in found],
                "round_trip": [m.decode(f[0][1]) == t.replace(SIGN, " ") for f, t in zip(found, texts)],
            }

        return each

    return map_texts(docs, make, "doc_id long, n_pieces long, score double, nbest_scores array<double>, nbest_crc32 array<long>, round_trip boolean")
