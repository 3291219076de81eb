"""Dense tiles, the text ladder, compression, section search and charsets against plain versions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import assembly, dense, retrieval, sparse
from siltstone.sources import records

VECTOR = "scope string, section string, v array<float>"


def plain_dense(queries, vectors, k, relax):
    out = []
    for q, scope, prefix, a in queries:
        found = {}
        for u, s, section, b in vectors:
            if a is None or b is None or len(a) != len(b) or None in b or not np.any(a) or not np.any(b):
                continue
            a64, b64 = np.float32(a).astype(float), np.float32(b).astype(float)
            score = float((a64 * b64).sum() / np.sqrt((a64 * a64).sum()) / np.sqrt((b64 * b64).sum()))
            inside = (scope is None or s == scope) if relax else s == scope
            below = not prefix or (section or "").startswith(prefix)
            level = (2 if inside and below else 1 if inside else 0) if relax else (2 if inside and below else -1)
            if level >= 0:
                found.setdefault(level, {}).setdefault(u, []).append(score)
        best = {u: max(x) for u, x in found[max(found)].items()} if found else {}
        out += [(q, u, round(s, 9)) for u, s in sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]]
    return sorted(out)


@pytest.mark.parametrize("relax", [True, False])
@pytest.mark.parametrize("sent", [32 << 20, 0])
def test_dense_tiles(spark, monkeypatch, relax, sent):
    monkeypatch.setattr(dense, "TILE_ROWS", 7)
    monkeypatch.setattr(dense, "PART_TILES", 2)
    monkeypatch.setattr(dense, "SENT_BYTES", sent)
    rng = np.random.default_rng(4)
    v = rng.standard_normal((120, 4)).round(1).tolist()
    vectors = [(k // 3, ["a", "b", None][k % 5 % 3], f"s{k % 4}/x", v[k]) for k in range(120)] + [(90, "a", None, None), (91, "a", "s1/", [0.0] * 4), (92, "a", "s1/", [1.0, None, 1.0, 1.0]), (93, "a", "s1/", [1.0] * 3), (5, "a", "s1/x", v[0]), (50, "a", "s1/x", v[0])]
    queries = [(k, [None, "a", "b", "nowhere"][k % 4], [None, "s1", "zz"][k % 3], v[k]) for k in range(24)] + [(70, "a", None, [0.0] * 4)]
    q, u = (spark.createDataFrame(x, f"{i} long, {VECTOR}") for x, i in ((queries, "query_id"), (vectors, "unit_id")))
    got = dense.blocked_top(q, u, 4, 5, relax)
    assert sorted((r.query_id, r.unit_id, round(r.score, 9)) for r in got.collect()) == plain_dense(queries, vectors, 5, relax)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert dense.blocked_top(q.limit(0), u, 4, 5, relax).count() == 0 and dense.blocked_top(q, u.limit(0), 4, 5, relax).count() == 0


def test_similar_texts_are_all_found(spark):
    rng = np.random.default_rng(5)
    words = ["ring", "rings", "widget", "wide", "bolt", "bold", "blue", "small"]
    texts = [(k, " ".join(rng.choice(words, rng.integers(0, 6)))) for k in range(80)] + [(99, None)]
    q, u = (spark.createDataFrame(x, f"{i} int, text string") for x, i in ((texts[:20], "query_id"), (texts, "unit_id")))
    sets = retrieval.trigram_sets(u)
    grams = {r.unit_id: set(r.g) for r in u.where("text IS NOT NULL").select("unit_id", T.trigrams(F.col("text")).alias("g")).collect()}
    for threshold in (0.3, 0.75, 1.0):
        want = sorted((a, b) for a in range(20) for b in grams if grams[a] and grams[b] and len(grams[a] & grams[b]) >= threshold * len(grams[a] | grams[b]))
        for index in (None, retrieval.trigram_index(sets)):
            got = retrieval.similar_texts(q, sets, threshold, index)
            assert sorted((r.query_id, r.unit_id) for r in got.collect()) == want


def test_ladder_takes_the_first_level_that_finds(spark):
    units = spark.createDataFrame([(1, "Manual", "rules", "the blue ring"), (2, "Guide", "ring", "small bolts"), (3, None, None, None)], "unit_id int, title string, search_text string, text string")
    q = spark.createDataFrame([(1, "ring manual"), (2, "smal bolt"), (3, "olt"), (4, "zzz"), (5, "")], "query_id int, text string")
    got = sorted((r.query_id, r.unit_id, r.level, round(r.score, 3)) for r in retrieval.full_text_ladder(q, units).collect())
    assert got == [(1, 1, 1, 0.6), (1, 2, 1, 0.2), (2, 2, 2, round(8 / 14, 3)), (3, 2, 3, 1.0)]


def plain_compress(items, asked, budget=12_000):
    import re

    bigrams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    if sum(len(t or "") for *_, t in items) <= budget:
        return [t for *_, t in items]
    seeds = sum(r == "seed" for _, r, _ in items)
    first = int(budget * 0.6)
    out = []
    for _, role, t in items:
        most = max(200, first // seeds) if role == "seed" else max(100, (budget - first) // (len(items) - seeds))
        if t is None or len(t) <= most:
            out.append(t)
            continue
        parts = [p.strip() for p in re.split(r"(?<=[。！？!?])\s*|\n+", t) if p.strip()]
        if role == "seed" or len(parts) <= 1 or not bigrams(asked):
            out.append(t[:most] + "...")
            continue
        ranked = sorted(range(len(parts)), key=lambda i: (-len(bigrams(parts[i]) & bigrams(asked)), i))
        chosen, used = [], 0
        for i in ranked:
            need = len(parts[i]) + bool(chosen)
            if used + need <= most:
                chosen.append(i)
                used += need
        out.append(" ".join(parts[i] for i in sorted(chosen)) if chosen else parts[ranked[0]][:most])
    return out


@pytest.mark.parametrize("asked", ["quick brown fox", "", "x"])
def test_compression(spark, asked):
    rng = np.random.default_rng(6)
    words = ["quick", "brown", "fox", "lazy", "dog", "狐狸"]
    text = lambda n: "".join(rng.choice(words) + str(rng.choice([" ", " ", "! ", "。", "\n\n", "?"])) for _ in range(n))
    packs = {1: [("seed", text(900)), ("context", text(900)), ("support", text(30)), ("context", "y" * 9_000), ("context", None)], 2: [("seed", "short"), ("context", text(20))], 3: [("context", text(4_000)), ("context", "a b! " * 2_000)]}
    rows = [(q, k, role, t) for q, items in packs.items() for k, (role, t) in enumerate(items)]
    found = spark.createDataFrame(rows, "query_id int, item_id int, role string, text string")
    queries = spark.createDataFrame([(q, asked, ["dog"] if asked == "x" else None) for q in packs], "query_id int, text string, keywords array<string>")
    got = {(r.query_id, r.item_id): r.text for r in assembly.compress(found, queries).collect()}
    for q, items in packs.items():
        want = plain_compress([(k, *x) for k, x in enumerate(items)], "x dog" if asked == "x" else asked)
        assert [got[q, k] for k in range(len(items))] == want


def test_section_search_counts_titles(spark):
    s = spark.createDataFrame([(1, "Slice slice", "text"), (2, "other", "slice " * 60), (3, "Change History", "slice"), (4, None, None)], "id int, title string, text string")
    assert [(r.id, r.score) for r in records.search_sections(s, ["SLICE"]).collect()] == [(1, 2000), (2, 50)]
    assert [r.id for r in records.search_sections(s, ["slice"], history=True).collect()] == [1, 2, 3]


def test_declared_charsets():
    page = "<meta charset='GBK'>㐀汉"
    assert records.decoded(page.encode("gb18030")) == page
    late = b" " * 4_000 + b"<meta charset=latin-1>" + b"\xe9"
    assert records.decoded(late).endswith("é") and records.decoded(b" " * 100 + late).endswith("�")
    assert records.decoded(b"charset=ascii \x80") == "charset=ascii �"


def test_terms_by_tiles(spark, monkeypatch):
    """Small tiles, blocks and slices, ties, nulls and equal queries give what the rule gives, by pairs and by products."""
    texts = {i: " ".join(w for j, w in enumerate(("alpha", "beta", "gamma", "delta", "eps")) for _ in range((i * (j + 2)) % 4)) for i in range(40)} | {40: None, 41: ""}
    asked = {1: "alpha beta", 2: "beta alpha", 3: "gamma eps zeta", 4: "nowhere", 5: "delta"}
    u = spark.createDataFrame(list(texts.items()), "unit_id long, text string")
    q = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    want = set()
    for a, words in asked.items():
        hits = [(-sum(min((t or "").split().count(w), 2) for w in words.split()) / len(words.split()), i) for i, t in texts.items()]
        want |= {(a, i, -s) for s, i in sorted(h for h in hits if h[0] < 0)[:3]}
    for name, value in (("UNIT_ROWS", 7), ("SLICE_BYTES", 40)):
        monkeypatch.setattr(sparse, name, value)
    assert {(r.query_id, r.unit_id, r.score) for r in retrieval.full_text(q, u, 3, 2).collect()} == want


def test_points_by_products_and_by_pairs(monkeypatch):
    """Both ways add up the same, in blocks of any size."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    lists = [sorted(set(rng.choice(words, rng.integers(1, 9)))) for _ in range(11)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 20))) for _ in range(17)]
    for rows, dense, pairs in ((2, 1, 5), (4, 10**9, 5), (100, 10**9, 10**6), (100, 6, 3)):
        for name, value in (("QUERY_ROWS", rows), ("DENSE", dense), ("PAIRS", pairs)):
            monkeypatch.setattr(sparse, name, value)
        q = sparse.Queries(pa.table({"id": list(range(11)), "terms": lists}))
        unit, term, value, _ = sparse.entries(pa.array(texts), sparse.tokens, q.vocabulary, 2)
        got = np.zeros((11, 17))
        for block in q.blocks:
            some, sums = sparse.points(block, 17, unit, term, value)
            got[block[0] + some] = sums
        assert (got == [[sum(min(t.split().count(w), 2) for w in own) for t in texts] for own in lists]).all()


def test_pieces_are_looked_up_by_word(monkeypatch):
    """Trigrams, sizes of their sets, and pieces of words as the plain rule gives them; a word of many texts is taken apart once."""
    texts = ["the blue ring the ring", None, "", "汉字 汉x a", "éé-a rings", "ring"]
    grams = [{f"  {w} "[i : i + 3] for w in set((t or "").replace("-", " ").replace("汉字", " ").replace("汉", " ").split()) for i in range(len(w) + 1)} for t in texts]
    words = [{"the", "blue", "ring"}, set(), set(), {"汉", "字", "x", "a"}, {"éé", "a", "rings"}, {"ring"}]
    pieces = [{w[i : i + n] for w in own for n in (1, 2, 4, 5) for i in range(len(w) - n + 1)} for own in words]
    seen = []
    look = sparse.Terms._pieces
    monkeypatch.setattr(sparse.Terms, "_pieces", lambda self, words, every: (seen.extend(words), look(self, words, every))[1])
    for split, every, sets in ((sparse.trigrams, True, grams), (sparse.parts([5, 1, 4, 2]), False, pieces)):
        vocabulary = [w for i, w in enumerate(sorted(set().union(*sets))) if i % 2] + ["~" * (3 if every else 5)]
        unit, term, hits, sizes = sparse.Terms(split, pa.array(vocabulary)).entries(pa.array(texts), 5, every)
        assert [*zip(term, unit)] == sorted((vocabulary.index(w), i) for i, own in enumerate(sets) for w in own if w in vocabulary) and set(hits) == {1}
        assert not every or list(sizes) == [len(own) for own in sets]
    assert seen.count("ring") == 2


def test_units_that_can_give_too_little_are_left_out():
    """Of two units one has the terms that a query needs to be among its best; the other has no term of the block at all."""
    q = sparse.Queries(pa.table({"id": [1, 2], "terms": [["a", "b"], ["b"]]}))
    unit, term, value, _ = sparse.entries(pa.array(["a a b", "b", "x"]), sparse.tokens, q.vocabulary, 5)
    live, *own = sparse.worth(q.blocks[0], 3, unit, term, value.astype(float), np.array([3.0, 2.0]))
    assert list(live) == [0] and sparse.points(q.blocks[0], 1, *own)[1].tolist() == [[3.0], [1.0]]
    assert sorted(sparse.alike(pa.table({"id": [1, 2, 3], "terms": [["a", "b"], ["b"], ["c"]]}))["id"].to_pylist()) == [1, 2, 3]


def test_sets_of_trigrams_are_compared_where_texts_are_read(spark):
    u = spark.createDataFrame([(1, "The blue ring"), (2, "blue"), (3, ""), (4, None), (5, "汉")], "unit_id int, text string")
    for asked, want in (("the ring", {1: 9 / 14, 2: 0.0, 3: 0.0, 4: None, 5: 0.0}), ("", {1: 0.0, 2: 0.0, 3: 1.0, 4: None, 5: 1.0})):
        q = spark.createDataFrame([(asked,)], "text string").select(T.trigrams(F.col("text")).alias("q"))
        got = sparse.set_similarity(u, q, sparse.trigrams)
        plain = u.join(q).select("unit_id", T.set_jaccard(T.trigrams(F.col("text")), F.col("q")).alias("s"))
        assert {r.unit_id: r.similarity for r in got.collect()} == want == {r.unit_id: r.s for r in plain.collect()}
        assert "ArrayTransform" not in got._jdf.queryExecution().toString() and "transform(" not in got._jdf.queryExecution().toString()


def test_compression_is_no_chain_of_lists(spark):
    """Sentences are ranked and taken in one pass over a text; no expression copies lists of them."""
    found = spark.createDataFrame([(1, 1, "context", "a b! " * 3_000)], "query_id int, item_id int, role string, text string")
    queries = spark.createDataFrame([(1, "a b", None)], "query_id int, text string, keywords array<string>")
    got = assembly.compress(found, queries)
    assert "aggregate(" not in got._jdf.queryExecution().toString()
    assert len(got.first().text) == 4_799
