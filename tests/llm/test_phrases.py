"""Phrase mining against a plain count and its SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest

from siltstone.llm import phrases, registry


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 1, "x", 2) for i, t, g in rows], "doc_id long, text string, lang string, source string, size int, phrase string, a long")


def brute(rows, support=10, longest=3, contained=50, best=2_000):
    n, f = Counter(), Counter()
    for i, t, g in rows:
        g = "und" if g is None else g
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower if i is not None else ""):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[g] += len(w)
            f.update((g, tuple(w[k : k + s])) for s in range(1, longest + 1) for k in range(len(w) - s + 1))
    frequent = {(g, p): a for (g, p), a in f.items() if len(p) > 1 and a >= support}
    out = {}
    for (g, p), a in frequent.items():
        inside = any(h == g and len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q))) and 100 * b >= contained * a for (h, q), b in frequent.items())
        if not inside:
            score, k = min((1_000_000 * a * a // (f[g, p[:k]] * f[g, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(g, []).append((-score, -a, " ".join(p).encode(), a, f[g, p[:k]], f[g, p[k:]]))
    return sorted((g, r, p.decode(), a, left, right, n[g], -s) for g, rows in out.items() for r, (s, _, p, a, left, right) in enumerate(sorted(rows)[:best], 1))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    words = ["The", "of", "new", "york", "city", "São", "漢字", "a\x1cb", "x", "ÀB", "﻿", "😀"]
    signs = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "!?"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(signs) for _ in range(n))
    out = [(i, text(rng.randint(0, 40)), rng.choice(["en", "en", "de", None, "und", ""])) for i in range(200)]
    out += [(k, "tick tock " * 9 + "tick", "fr") for k in (1, 1, 7)] + [(8, None, "en"), (9, "", None), (None, "new york " * 50, "en"), (10, "only here now. " * 12, "xx"), (11, text(9_000), "de")]
    return out


@pytest.mark.parametrize("shards", [1, 4, 9])
def test_phrases(spark, rows, shards, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 300)
    monkeypatch.setattr(phrases, "BUCKET_WORDS", 1_000)
    got = phrases.collocations(docs_of(spark, rows), shards=shards).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    assert got[0].asDict().keys() == {"lang", "rank", "phrase", "a", "l", "r", "n", "score"}


def test_best_and_empty(spark, rows):
    assert sorted(tuple(r) for r in phrases.collocations(docs_of(spark, rows), best=7).collect()) == brute(rows, best=7)
    assert phrases.collocations(docs_of(spark, [])).collect() == []
    assert sorted(tuple(r) for r in phrases.collocations(docs_of(spark, rows), longest=4, support=6).collect()) == brute(rows, longest=4, support=6)


def test_equal_hashes_add_no_phrase(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "HASH_BITS", 6)
    assert sorted(tuple(r) for r in phrases.collocations(docs_of(spark, rows)).collect()) == brute(rows)


def test_sql_says_the_same(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [list(r) for r in rows])
    cursor = con.execute(registry.OP13_SQL)
    at = [[d[0] for d in cursor.description].index(c) for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")]
    assert sorted(tuple(r[k] for k in at) for r in cursor.fetchall()) == brute(rows)
