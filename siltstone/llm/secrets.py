"""Secret scans (operator 6): Aho-Corasick keywords, anchored expressions near hits, embedded checks.

The keywords of all rules go through a text in one pass over its ASCII-lower-cased copy. A rule's expression is tried
only at its keyword's hits, in order, and a hit inside an earlier match of the same rule is passed over: that equals
scanning for leftmost non-overlapping matches. Long hex runs have no keyword; every run of 24 or more covers a
position that is a multiple of 24 less one, so only those positions are looked at. What a match must hold then
decides: lengths for the base rules; for the method's own rules a checksum or a structure inside the secret
(base-62 CRC-32 of the tokens of code hosts and package registries, a JSON header in a web token). Private keys hold
nothing that a public reader could check; their armour alone shows them, and a key's span reaches to its END line (the
header alone without one).

Cases: a null or empty text has no spans; matches that fail are dropped without another try at a later start inside
them; spans of different rules may overlap, and those that start together follow each other as the kinds are listed; a
very long text is one value in one task, in proportion to its length; repeated rows are scanned each; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame

from .common import map_texts

#: Base kinds in their order, then the method's own.
KINDS = ["assign", "access", "hex", "hosttoken", "registry", "webtoken", "privatekey"]
BASE = KINDS[:3]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_LEAST = 24


def _crc_base62(secret: str) -> bool:
    """The last six characters are the base-62 CRC-32 of those after the prefix."""
    body = secret.split("_", 1)[1]
    value, digits = zlib.crc32(body[:-6].encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = _BASE62[d] + digits
    return digits == body[-6:]


def _json_header(secret: str) -> bool:
    head = secret.split(".", 1)[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (binascii.Error, ValueError, TypeError):
        return False


#: kind, keywords (lower case), expression anchored at the keyword, check of the match, and its span's group
RULES = [
    ("assign", ["password", "passwd", "secret", "token", "api_key", "apikey"], re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), lambda m: len(m[1]) >= 6),
    ("access", ["akia"], re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hosttoken", ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: _crc_base62(m[0])),
    ("registry", ["npm_"], re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: _crc_base62(m[0])),
    ("webtoken", ["eyj"], re.compile(r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"), lambda m: _json_header(m[0])),
    ("privatekey", ["-----begin "], re.compile(r"-----BEGIN ((?:[A-Z0-9]++ )*?PRIVATE KEY(?: BLOCK)?)-----(?:(?:(?!-----)[\s\S])*+-----END \1-----)?+"), lambda m: True),
]
_TOKEN_RUN = re.compile("[A-Za-z0-9_-]++")
_HEX_RUN = re.compile("[0-9a-f]+")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, (_, words, _, _) in enumerate(RULES):
        for w in words:
            a.add_word(w, (i, len(w)))
    a.make_automaton()
    return a


def hex_runs(text: str) -> list[tuple[int, int]]:
    """Maximal runs of hex digits of at least HEX_LEAST."""
    out, end = [], 0
    anchors = text[HEX_LEAST - 1 :: HEX_LEAST]
    for m in _HEX_RUN.finditer(anchors):
        for k in range(m.start(), m.end()):
            at = HEX_LEAST - 1 + HEX_LEAST * k
            if at < end:
                continue
            start = at
            while start > end and text[start - 1] in "0123456789abcdef":
                start -= 1
            end = _HEX_RUN.match(text, start).end()
            if end - start >= HEX_LEAST:
                out.append((start, end))
    return out


def scan(text: str, keywords: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then kind as listed."""
    lower = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    spans = [(a, b, "hex") for a, b in hex_runs(text)]
    ends = [0] * len(RULES)
    hits = sorted((at - n + 1, i) for at, (i, n) in keywords.iter(lower))
    for start, i in hits:
        if start >= ends[i]:
            kind, _, expression, holds = RULES[i]
            m = expression.match(text, start)
            if m:
                ends[i] = m.end()
                if holds(m):
                    spans.append((start, m.end(), kind))
            elif kind == "webtoken" and text.startswith("eyJ", start):
                # a later hit in the same run would fail in the same way; this keeps the scan linear
                ends[i] = _TOKEN_RUN.match(text, start).end()
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of structs), n_assign, n_access, n_hex, base_sha256."""

    def make():
        keywords = automaton()

        def each(ids, texts):
            found = [scan(t, keywords) for t in texts]
            out = {f"n_{k}": [sum(s[2] == k for s in f) for f in found] for k in BASE}
            out["base_sha256"] = [hashlib.sha256(written([s for s in f if s[2] in BASE]).encode()).hexdigest() for f in found]
            return out | {"doc_id": ids, "spans": [[{"start": a, "end": b, "kind": k} for a, b, k in f] for f in found]}

        return each

    return map_texts(docs, make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<start:int,end:int,kind:string>>")
