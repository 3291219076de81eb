"""Personal data by a semi-Markov conditional random field (operator 2).

Expressions find the base spans. Around every digit, at-sign and spelled-out "(at)", a region is cut into atoms (runs
of letters, runs of digits, single signs), and whole segments of a bounded number of atoms become candidates of each
kind that they could be. A candidate's score is a weighted sum of features of the whole span; dynamic programming
over the region picks the best set of disjoint segments, boundaries and kinds together, with weights for which kind
follows which. Base spans are forced; what else is picked with enough margin is added.

The weights are fitted by the model's log-likelihood on a bounded sample of regions (MAX_REGIONS), in which the base
spans are the reference. There the feature that gives a kind away (a plus sign, an at-sign) is hidden at random, so
that shape and context carry weight of their own.

Cases: a null or empty text has no spans; base matches that fail their check are dropped without another try; base
spans of different kinds may overlap, added ones overlap nothing; of equally good choices the one found first stands (the
shorter segment, then the kind as listed); a very long text is one value in one task, and its work is in proportion to
its length; repeated rows are found each; without any region in the table, or in an empty one, nothing is added.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize, workspace

KINDS = ["email", "ip", "card", "phone"]
#: Atoms of the longest segment, characters that a region reaches beyond a sign that starts it, regions of the fit.
MAX_ATOMS, REACH, MAX_REGIONS = 40, 64, 400
#: Characters of the longest region of the fit; this bounds the sample in bytes. Longer regions are searched all the same.
FIT_CHARS = 4 * REACH
#: Score that an added segment must have.
MARGIN = 1.0
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]+")
_ANCHOR = re.compile(r"[@0-9]+|\(at\)|\[at\]")
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
_SPACE = re.compile(r"\s")
#: What may stand before and after an at-sign with a space between, as far as a spelled-out address goes.
_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]+\x20?\Z")
_AFTER_AT = re.compile(r"\x20?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+|\x20?(?:\(dot\)|\[dot\])\x20?[A-Za-z0-9-]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int, str]]:
    """Each at-sign with the run of local characters before it; what an earlier match has used is not used again."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
        end = m.end() if m else at + 1
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then kind as listed."""
    out = _emails(text)
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def regions(text: str) -> list[tuple[int, int]]:
    """Disjoint stretches around what may be personal data; each is a bounded number of characters past its anchors."""
    out: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        if out and m.end() <= out[-1][1]:
            continue
        a = max(m.start() - REACH, out[-1][1] if out else 0)
        before = text[a : m.start()]
        space = max((i for i, c in enumerate(before) if c.isspace()), default=-1)
        a += space + 1
        after = _SPACE.search(text, m.end(), m.end() + REACH)
        b = after.start() if after else min(len(text), m.end() + REACH)
        if not m[0][0].isdigit():
            low = max(m.start() - REACH, out[-1][1] if out else 0)
            if wide := _BEFORE_AT.search(text[low : m.start()]):
                a = min(a, low + wide.start())
            if wide := _AFTER_AT.match(text, m.end(), m.end() + REACH):
                b = max(b, wide.end())
        if out and a - out[-1][1] <= 1:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


@dataclass
class Candidate:
    first: int  # atom
    last: int  # atom after the segment
    start: int
    end: int
    kind: int
    features: np.ndarray
    forced: bool = False


FEATURES = ["bias", "giveaway", "valid", "bounded", "digits_fit", "groups", "maximal", "letters"]
_NUMBER = re.compile(r"\+?\(?[0-9][0-9 ().-]*[0-9]|[0-9]")
_NUMBER_RUN = re.compile(r"\+?\(?[0-9][0-9 ().-]*")
_LOCAL_AT = re.compile(r"[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]+)+")


def features(kind: str, text: str, start: int, end: int) -> np.ndarray | None:
    """None if the span can't be of the kind."""
    s = text[start:end]
    left, right = text[start - 1 : start], text[end : end + 1]
    bounded = not (left.isalnum() or right.isalnum())
    groups = _DIGITS.findall(s)
    digits = "".join(groups)
    if kind == "email":
        if not _SPELLED.fullmatch(s):
            return None
        tail = re.split(r"\.|dot", s)[-1].strip(")] ")
        return np.array([1, "@" in s, tail.isalpha() and len(tail) >= 2, bounded, 0, 0, not (_LOCAL.match(left or " ") or _LOCAL.match(right or " ")), 1], float)
    if not _NUMBER.fullmatch(s):
        return None
    maximal = not (left[-1:].isdigit() or right[:1].isdigit() or (right[:1] in ".-" and text[end + 1 : end + 2].isdigit()))
    if kind == "ip":
        if len(groups) != 4 or len(s) != len(digits) + 3 or s.count(".") != 3:
            return None
        ok = all(len(g) <= 3 and int(g) <= 255 for g in groups)
        return np.array([1, 1, ok, bounded, 4 <= len(digits) <= 12, len(groups) == 4, maximal, 0], float)
    if kind == "card":
        if not 12 <= len(digits) <= 19 or not set(s) <= set("0123456789 -"):
            return None
        return np.array([1, len(digits) >= 14, luhn(digits), bounded, len(digits) in (15, 16), all(len(g) >= 4 for g in groups), maximal, 0], float)
    if not 7 <= len(digits) <= 15 or "." in s and s.count(".") == 3 and len(groups) == 4:
        return None
    return np.array([1, s[0] == "+", 10 <= len(digits) <= 15, bounded, 10 <= len(digits) <= 13, 2 <= len(groups) <= 5 and len(groups[-1]) == 4, maximal, 0], float)


def candidates(text: str, a: int, b: int, base: list[tuple[int, int, str]]) -> tuple[int, list[Candidate]]:
    """Atoms in the region, and its candidates by their end; base is in order of starts."""
    atoms = [(m.start(), m.end()) for m in _ATOM.finditer(text, a, b)]
    at = {s: i for i, (s, _) in enumerate(atoms)} | {b: len(atoms)}
    inside = base[bisect.bisect_left(base, (a,)) : bisect.bisect_left(base, (b + 1,))]
    forced = {(s, e, KINDS.index(k)) for s, e, k in inside if e <= b and s in at and (e in at)}
    out = {}
    for s, e, k in forced:
        f = features(KINDS[k], text, s, e)
        out[s, e, k] = Candidate(at[s], at[e], s, e, k, np.zeros(len(FEATURES)) if f is None else f, True)

    def propose(k: int, i: int, j: int) -> None:
        s, e = atoms[i][0], atoms[j][1]
        if (s, e, k) not in out and (f := features(KINDS[k], text, s, e)) is not None:
            out[s, e, k] = Candidate(i, j + 1, s, e, k, f)

    for i, (s, _) in enumerate(atoms):
        last = min(len(atoms), i + MAX_ATOMS)
        # a number goes as far as its signs do, and has digits of a kind's range; an address as far as its domain
        if number := _NUMBER_RUN.match(text, s, b):
            digits = dots = 0
            for j in range(i, last):
                first, e = atoms[j]
                if e > number.end() or digits > 19:
                    break
                dots += text[first] == "."
                if text[first] in "0123456789":
                    digits += e - first
                    for k, fits in ((1, dots == 3), (2, 12 <= digits <= 19), (3, 7 <= digits <= 15)):
                        if fits:
                            propose(k, i, j)
        if (text[s] == "+" or text[s].isalnum()) and (local := _LOCAL_AT.match(text, s, b)) and (domain := _AFTER_AT.match(text, local.end(), b)):
            for j in range(i, last):
                e = atoms[j][1]
                if e > domain.end():
                    break
                if e > local.end() and text[e - 1].isascii() and text[e - 1].isalnum():
                    propose(0, i, j)
    return len(atoms), sorted(out.values(), key=lambda c: (c.last, c.first, c.kind))


class SemiMarkov:
    """weights[kind] scores a segment's features; follows[p][k] scores kind k after kind p (the last row: after none)."""

    def __init__(self, weights: np.ndarray | None = None, follows: np.ndarray | None = None):
        k = len(KINDS)
        self.weights = np.zeros((k, len(FEATURES))) if weights is None else weights
        self.follows = np.zeros((k + 1, k)) if follows is None else follows

    def own(self, c: Candidate) -> float:
        return float(self.weights[c.kind] @ c.features)

    def best(self, atoms: int, cands: list[Candidate]) -> list[Candidate]:
        """The highest-scoring disjoint segments; states are (atom, kind of the last segment)."""
        none = len(KINDS)
        score = np.full((atoms + 1, none + 1), -np.inf)
        score[0, none] = 0
        back: dict[tuple[int, int], tuple[int, int, Candidate]] = {}
        i = 0
        for p in range(1, atoms + 1):
            score[p] = score[p - 1]
            for s in range(none + 1):
                if (p - 1, s) in back:
                    back[p, s] = back[p - 1, s]
            while i < len(cands) and cands[i].last == p:
                c = cands[i]
                i += 1
                own = 1e6 if c.forced else self.own(c)
                options = score[c.first] + self.follows[:, c.kind] + own
                s = int(options.argmax())
                if options[s] > score[p, c.kind]:
                    score[p, c.kind] = options[s]
                    back[p, c.kind] = (c.first, s, c)
        p, s = atoms, int(score[atoms].argmax())
        out = []
        while (p, s) in back:
            p, s, c = back[p, s]
            out.append(c)
        return out[::-1]

    def expectations(self, atoms: int, cands: list[Candidate]) -> tuple[float, np.ndarray, np.ndarray]:
        """log Z, and the expected features and successions, by the forward and backward recursions."""
        none = len(KINDS)
        own = [self.own(c) for c in cands]
        a = np.full((atoms + 1, none + 1), -np.inf)
        a[0, none] = 0
        i = 0
        for p in range(1, atoms + 1):
            a[p] = a[p - 1]
            while i < len(cands) and cands[i].last == p:
                c = cands[i]
                a[p, c.kind] = np.logaddexp(a[p, c.kind], np.logaddexp.reduce(a[c.first] + self.follows[:, c.kind]) + own[i])
                i += 1
        b = np.zeros((atoms + 1, none + 1))
        by_first: dict[int, list[int]] = {}
        for i, c in enumerate(cands):
            by_first.setdefault(c.first, []).append(i)
        for p in range(atoms - 1, -1, -1):
            b[p] = b[p + 1]
            for i in by_first.get(p, ()):
                c = cands[i]
                b[p] = np.logaddexp(b[p], self.follows[:, c.kind] + own[i] + b[c.last, c.kind])
        z = float(b[0, none])
        e, t = np.zeros_like(self.weights), np.zeros_like(self.follows)
        for i, c in enumerate(cands):
            p = np.exp(a[c.first] + self.follows[:, c.kind] + own[i] + b[c.last, c.kind] - z)
            e[c.kind] += p.sum() * c.features
            t[:, c.kind] += p
        return z, e, t

    def fit(self, samples: list[tuple[int, list[Candidate]]], rounds: int = 15, rate: float = 0.3, ridge: float = 0.02, seed: int = 7) -> SemiMarkov:
        """Adaptive gradient steps on the regularised log-likelihood; hides the giveaway feature now and then."""
        rng = np.random.default_rng(seed)
        gw, gt = np.full_like(self.weights, 1e-6), np.full_like(self.follows, 1e-6)
        for _ in range(rounds):
            for k in rng.permutation(len(samples)):
                atoms, cands = samples[k]
                if rng.random() < 0.3:
                    cands = [Candidate(c.first, c.last, c.start, c.end, c.kind, np.where(np.arange(len(FEATURES)) == 1, 0, c.features), c.forced) for c in cands]
                _, e, t = self.expectations(atoms, cands)
                last, end = len(KINDS), 0
                dw, dt = -e - ridge * self.weights / 10, -t - ridge * self.follows / 10
                for c in sorted((c for c in cands if c.forced), key=lambda c: (c.first, c.last)):
                    if c.first >= end:
                        dw[c.kind] += c.features
                        dt[last, c.kind] += 1
                        last, end = c.kind, c.last
                gw += dw**2
                gt += dt**2
                self.weights += rate * dw / np.sqrt(gw)
                self.follows += rate * dt / np.sqrt(gt)
        return self


def train(docs: DataFrame, max_regions: int = MAX_REGIONS) -> SemiMarkov:
    """Fits on at most max_regions regions, chosen by hash over all documents; only they reach the driver."""

    half = max_regions // 2

    def make():
        def each(ids, texts):
            # of each batch, the regions that can be among the chosen: the least hashes with and without a reference
            chosen: dict[bool, list[tuple]] = {True: [], False: []}
            for i, text in zip(ids, texts):
                found = regions(text)
                base = base_spans(text) if found else []
                for a, b in found:
                    if b - a <= FIT_CHARS:
                        left, right = max(0, a - 1), b + 2
                        inside = base[bisect.bisect_left(base, (a,)) : bisect.bisect_left(base, (b + 1,))]
                        gold = [{"start": s - left, "end": e - left, "kind": k} for s, e, k in inside if e <= b]
                        piece = text[left:right]
                        h = int.from_bytes(hashlib.blake2b(f"{i}:{piece}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                        chosen[not gold].append((h, i, piece, [a - left, b - left], gold))
            rows = [r for some in chosen.values() for r in heapq.nsmallest(half, some, key=lambda r: r[:3])]
            return {c: [r[k] for r in rows] for k, c in enumerate(("h", "doc_id", "piece", "at", "gold"))}

        return each

    rows = map_texts(docs, make, "h long, doc_id long, piece string, at array<int>, gold array<struct<start:int,end:int,kind:string>>")
    rows = materialize(rows, workspace(docs.sparkSession) + "/regions")
    # half of the sample are regions with a reference span, if there are as many
    got = [r for bare in (False, True) for r in rows.where((F.size("gold") == 0) == F.lit(bare)).orderBy("h", "doc_id", "piece").limit(half).collect()]
    samples = []
    for r in got:
        atoms, cands = candidates(r.piece, r.at[0], r.at[1], [(g.start, g.end, g.kind) for g in r.gold])
        if cands:
            samples.append((atoms, cands))
    return SemiMarkov().fit(samples)


def find(text: str, model: SemiMarkov) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans, each by start and kind."""
    base = base_spans(text)
    starts = [s for s, _, _ in base]
    reach = list(itertools.accumulate((e for _, e, _ in base), max))  # the greatest end so far
    added = []
    for a, b in regions(text):
        atoms, cands = candidates(text, a, b, base)
        if any(not c.forced for c in cands):
            for c in model.best(atoms, cands):
                before = bisect.bisect_left(starts, c.end)
                if not c.forced and model.own(c) >= MARGIN and not (before and reach[before - 1] > c.start):
                    added.append((c.start, c.end, KINDS[c.kind]))
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_pii(docs: DataFrame, max_regions: int = MAX_REGIONS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans (all)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, max_regions))

    def make():
        def each(ids, texts):
            found = [find(t, shared.value) for t in texts]
            out = {f"n_{k}": [sum(s[2] == k for s in base) for base, _ in found] for k in KINDS}
            out["base_sha256"] = [hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest() for base, _ in found]
            return out | {"doc_id": ids, "spans": [[{"start": a, "end": b, "kind": k} for a, b, k in every] for _, every in found]}

        return each

    return map_texts(docs, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans array<struct<start:int,end:int,kind:string>>")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of its first one in brackets."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, column: str = "text", max_regions: int = MAX_REGIONS) -> Column:
    """The column with personal data replaced, for docs; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, max_regions))

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else redact(t, find(t, shared.value)[1]))

    return rewrite(F.col(column))
