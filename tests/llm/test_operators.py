"""Each operator against a brute-force version on small, odd tables."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from siltstone.llm import lines, ngram_join, nearest, packing, pieces, pii, quality, secrets, token_files
from siltstone.llm.licenses import LicenseScanner, scan_licenses
from siltstone.llm.lines import dedup_lines

from .conftest import make_docs


def sets_of(rows):
    out = []
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def components(rows):
    sets = sets_of(rows)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def test_ngram_join(spark, odd_rows):
    known = [r for r in odd_rows if r[0] is not None]
    got = sorted(tuple(r) for r in ngram_join.ngram_join(make_docs(spark, odd_rows)).collect())
    assert got == components(known)


def test_ngram_join_needs_hub_rounds(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(60):
        w = list(base)
        for p in rng.choice(90, 1 + i % 4, replace=False):
            w[p] = f"n{i}x{p}"
        rows.append((i, " ".join(w)))
    got = sorted(tuple(r) for r in ngram_join.ngram_join(make_docs(spark, rows)).collect())
    assert got == components(rows)


def test_runs_pack_and_unpack():
    v = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 999).astype(np.uint64))
    assert (ngram_join.unpack_run(ngram_join.pack_run(v)) == v).all()


def plain_lines(rows, least=40, docs=5):
    strip, seen, keeper = " \t\n\r\x0b\x0c", {}, {}
    lower = {c: c + 32 for c in range(65, 91)}
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = x.strip(strip).translate(lower)
            if len(k) >= least:
                seen.setdefault(k, set()).add(i)
    common = {k: max(v) for k, v in seen.items() if len(v) >= docs}
    out = []
    for i, t in rows:
        x = (t or "").split("\n")
        kept = [y for y in x if common.get(y.strip(strip).translate(lower), i) == i]
        out.append((i, "\n".join(kept), len(x), len(x) - len(kept)))
    return sorted(out)


@pytest.mark.parametrize("bits", [1 << 10, lines.FILTER_BITS])
def test_line_dedup(spark, odd_rows, bits):
    """With a filter far too small all lines are suspects, and the result is the same."""
    known = [r for r in odd_rows if r[0] is not None]
    got = sorted(tuple(r) for r in dedup_lines(make_docs(spark, odd_rows), bits=bits).collect())
    want = plain_lines(known)
    assert got == want and sum(r[3] for r in want) > 10


BASE_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def plain_spans(text, base, kinds):
    found = [(m.start(), m.end(), k) for k, (p, fine) in base.items() for m in re.finditer(p, text) if fine(m[0])]
    return sorted(found, key=lambda s: (s[0], kinds.index(s[2])))


def test_pii_base_spans():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("12 +-.@ab()é"), rng.integers(3, 60))) for _ in range(3000)]
    texts += ["4111 1111 1111 1111", "a@b.c@d.e.f@g", "1.2.3.4.5.6.7.8", "+1 (743) 555-3824 x@y.zz", "9" * 3000, "@" * 500, "a" * 5000]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t, BASE_PII, pii.KINDS), t


def test_pii_dynamic_programming_is_exact():
    rng = np.random.default_rng(4)
    model = pii.SemiMarkov(rng.normal(size=(4, len(pii.FEATURES))) * 2, rng.normal(size=(5, 4)))
    for _ in range(60):
        cands = sorted((pii.Candidate(a := int(rng.integers(0, 6)), a + int(rng.integers(1, 4)), 0, 0, int(rng.integers(0, 4)), rng.normal(size=len(pii.FEATURES))) for _ in range(7)), key=lambda c: (c.last, c.first, c.kind))

        def value(some):
            last, total = 4, 0.0
            for c in some:
                total += model.weights[c.kind] @ c.features + model.follows[last, c.kind]
                last = c.kind
            return total

        best = 0.0
        z = []
        for n in range(len(cands) + 1):
            for some in itertools.combinations(sorted(cands, key=lambda c: c.first), n):
                if all(x.last <= y.first for x, y in zip(some, some[1:])):
                    z.append(value(some))
                    best = max(best, z[-1])
        assert value(model.best(9, cands)) == pytest.approx(best)
        assert model.expectations(9, cands)[0] == pytest.approx(np.logaddexp.reduce(z))


@pytest.mark.parametrize("said", ["john (at) example.com", "john [at] example (dot) com", "john @ example.com", "john(at)example.com"])
def test_pii_regions_reach_spaced_addresses(said):
    text = f"write to {said} soon"
    start = text.index("john")
    inside = [c for a, b in pii.regions(text) for c in pii.candidates(text, a, b, [])[1]]
    assert (start, start + len(said), 0) in {(c.start, c.end, c.kind) for c in inside}
    assert not [c for a, b in pii.regions("meet @ noon. Then go") for c in pii.candidates("meet @ noon. Then go", a, b, [])[1]]


def test_pii_query(spark, odd_rows):
    rows = odd_rows + [(900 + k, f"call +1 (743) 555-38{k:02d} or x{k}@mail.example.com from 10.0.0.{k} card 4111 1111 1111 1111") for k in range(20)]
    rows += [(990, "call 743-555-3824 now")]
    got = {r.doc_id: r for r in pii.find_pii(make_docs(spark, [r for r in rows if r[0] != 12])).collect()}
    for i, t in rows:
        if i in got:
            base = plain_spans(t or "", BASE_PII, pii.KINDS)
            written = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
            assert got[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest()
            assert set(base) <= {(s.start, s.end, s.kind) for s in got[i].spans}
    assert got[905].n_phone == got[905].n_email == got[905].n_ip == got[905].n_card == 1
    assert [s.kind for s in got[990].spans] == ["phone"]  # added by the model
    assert not got[60].spans
    assert pii.redact("a 1.2.3.4 b", [(2, 9, "ip")]) == "a [IP] b"


def test_pieces_n_best_is_exact(spark):
    m = pieces.load(pieces.model_file("piece_bpe_32k.model"))
    rng = np.random.default_rng(1)
    texts = ["hello world", "a", "  two  spaces ", "né ü 你好 \t\n x", "aaaaaaaaaaaa", "☃ snow ☃☃", "x" * 400]
    texts += ["".join(rng.choice(list("aetnd oé"), rng.integers(1, 25))) for _ in range(150)]

    def n_best(text, n):
        x = pieces.SIGN + text.replace(" ", pieces.SIGN)
        into = m.edges(x)
        best = {0: [(0.0, b"")]}
        for j in range(1, len(x) + 1):
            best[j] = sorted(((s0 + s, p + ids) for i, s, ids in into[j] for s0, p in best[i]), key=lambda v: -v[0])[:n]
        return best[len(x)]

    for t, got in zip(texts, m.encode(texts, 4)):
        want = n_best(t, 4)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want])
        assert len({x for _, x in got}) == len(got)
        assert all(m.decode(x) == t for _, x in got)


def test_pieces_of_long_chunks():
    m = pieces.load(pieces.model_file("piece_bpe_32k.model"))
    rng = np.random.default_rng(8)
    for t in ["".join(rng.choice(list("aetnd"), 300)), "x" * 300, "".join(map(chr, rng.integers(0x4E00, 0x5000, 300))), "".join(rng.choice(list("你好吗a"), 300))]:
        parts = m.fall_apart(t)
        assert "".join(parts) == t
        best = [m.learn([p])[p] for p in parts]
        edges = m.edges(t)
        assert sum(b[1] for b in best) == pytest.approx(m.forward(edges)[-1])
        second = [s for s, _ in m.best_paths([t], 2)][1:]  # none if there is one segmentation only
        assert [sum(b[1] for b in best) - b for b in [min(b[2] for b in best)] if np.isfinite(b)] == pytest.approx(second)


def test_pieces_queries(spark, odd_rows):
    import sentencepiece

    docs = make_docs(spark, odd_rows)
    out = pieces.digest_documents(docs).collect()
    assert len(out) == sum(i is not None for i, _ in odd_rows) and all(r.round_trip for r in out)
    best = pieces.encode_documents(docs, n_best=1).selectExpr("doc_id", "segmentations[0].ids AS ids")
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_file("piece_bpe_32k.model"))
    texts = {(i, t or "") for i, t in odd_rows if i is not None}
    assert {(r.doc_id, r.text) for r in pieces.decode_pieces(best).collect()} == texts
    assert all(sp.decode(list(r.ids)) in {t for i, t in texts if i == r.doc_id} for r in best.collect())


def test_licenses(spark, odd_rows):
    notice = "Released under the MIT License."
    rows = odd_rows + [(700, f"abc {notice} {notice} x"), (701, "Licensed under the Apache License, Version 2.0."), (702, "CC BY-NC, cc by nc"), (703, "under the mit licence")]
    rows += [(704, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without any limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so")]
    got = {r.doc_id: r for r in scan_licenses(make_docs(spark, rows)).collect()}
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for i, t in rows:
        if i is None:
            continue
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, n) for p, n in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        ends = [k + len(next(p for p, l in phrases.items() if l == n).split()) - 1 for k, n in places]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert r.first_word == (min(k for k, _ in places) if places else None)
        assert set(r.base_labels.split(",")) - {""} == {n for _, n in places} and 0 <= r.score <= 1
    assert "MIT" in got[700].labels.split(",") and "MIT" in got[704].labels.split(",") and got[703].labels == "" and got[60].score == 0


def test_every_license_is_itself():
    """A template's own text has its label and no other's, though licences share most of their wording."""
    from siltstone.llm.licenses import TEMPLATES

    s = LicenseScanner()
    for key, text in TEMPLATES.items():
        own = key.split("#")[0]
        labels = set(s.scan(f"some words before {text} and some after")["labels"].split(",")) - {"mit", "apache-2", "cc-by-nc"}
        assert own in labels and labels <= {own, "BSD-2-Clause"}, (key, labels)
    both = s.scan(TEMPLATES["GPL-2.0-or-later#header"] + " and " + TEMPLATES["GPL-3.0-or-later#header"])["labels"]
    assert both == "GPL-2.0-or-later,GPL-3.0-or-later"


def test_suffix_automaton_statistics():
    rng = np.random.default_rng(6)
    templates = {f"t{k}": " ".join(rng.choice(list("abc"), 14)) for k in range(5)}
    s = LicenseScanner(templates, 1)
    factors = {tuple(w[i:j]) for w in (t.split() for t in templates.values()) for i in range(14) for j in range(i + 1, 15)}
    text = list(rng.choice(list("abc"), 200))
    ids = [s.vocabulary[w.encode()] for w in text]
    for e, (n, state) in enumerate(s.automaton.statistics(ids), 1):
        assert tuple(text[e - n : e]) in factors and tuple(text[e - n - 1 : e]) not in factors
        for template, ends in s.automaton.places[state].items():
            words = templates[f"t{template}"].split()
            assert all(words[x - n : x] == text[e - n : e] for x in ends)


BASE_SECRETS = {
    "assign": (r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def host_token(body):
    crc, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        digits = secrets._BASE62[d] + digits
    return f"ghp_{body}{digits}"


def test_secrets(spark, odd_rows):
    rng = np.random.default_rng(8)
    bits = ["password", "PassWd", "token", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "abcdef1", "AKIA", "ABCDEFGHIJ012345", "0a1b2c3d4e5f", "f", "é", "-"]
    rows = [(1000 + k, "".join(rng.choice(bits, rng.integers(2, 14)))) for k in range(400)]
    rows += [(5000, "x" + "a" * 47 + "g" + "b" * 30), (5001, "f" * 23), (5002, "f" * 24), (5003, host_token("A" * 30)), (5004, "ghp_" + "A" * 36)] + odd_rows
    got = {r.doc_id: r for r in secrets.scan_secrets(make_docs(spark, rows)).collect()}
    for i, t in rows:
        if i is None:
            continue
        base = sorted(((m.start(), m.end(), k) for k, (p, fine) in BASE_SECRETS.items() for m in re.finditer(p, t or "") if fine(m)), key=lambda s: (s[0], secrets.KINDS.index(s[2])))
        assert [(s.start, s.end, s.kind) for s in got[i].spans if s.kind in secrets.BASE] == base, t
        assert got[i].base_sha256 == hashlib.sha256(secrets.written(base).encode()).hexdigest()
    assert [s.kind for s in got[5003].spans] == ["hosttoken"] and not got[5004].spans


def test_secrets_of_any_length():
    import base64

    words = secrets.automaton()
    head = base64.urlsafe_b64encode(b'{"alg":"x","x5c":"' + b"a" * 9000 + b'"}').decode().rstrip("=")
    short = base64.urlsafe_b64encode(b'{"alg":"ML-DSA-87"}').decode().rstrip("=")
    for token in (f"{head}.{'b' * 50}.{'c' * 50}", f"{short}.{'b' * 200_000}.{'c' * 50}", f"{short}.{'b' * 50}.{'C' * 6200}"):
        assert (2, 2 + len(token), "webtoken") in secrets.scan(f"x {token} y", words)
    for name in ("RSA PRIVATE KEY", "PRIVATE KEY", "PGP PRIVATE KEY BLOCK"):
        key = f"-----BEGIN {name}-----\n" + "MIIEow+/=\n" * 300 + f"-----END {name}-----"
        assert [s for s in secrets.scan(f"k {key} {key} y", words) if s[2] == "privatekey"] == [(2, 2 + len(key), "privatekey"), (3 + len(key), 3 + 2 * len(key), "privatekey")]
    assert secrets.scan("eyJ" * 300_000, words) == []  # linear, or this takes hours
    assert secrets.scan("-----BEGIN PRIVATE KEY-----\nabc", words) == [(0, 27, "privatekey")]


@pytest.mark.parametrize("file_rows", [7, 10_000])
def test_token_files(spark, odd_rows, tmp_path, file_rows):
    from tokenizers import Tokenizer

    rows = [r for r in odd_rows if r[0] is not None and r[0] != 12] + [(6000, "don't <|endoftext|> → a→b Σ İ\x85 x"), (6001, None)]
    path = token_files.tokenizer_file("word_bpe_49k.json")
    index = token_files.write_token_files(make_docs(spark, rows), f"file://{tmp_path}/out", path, sequence=64, file_rows=file_rows)
    got = {r.doc_id: r for r in token_files.read_documents(spark, f"file://{tmp_path}/out", index).collect()}
    tokenizer, start, every = Tokenizer.from_file(path), 0, []
    for i, t in sorted(rows):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        every += ids.tolist()
    back = []
    for f in sorted(r.file for r in index.select("file").distinct().collect()):
        batches, firsts = token_files.read_sequences(f"file://{tmp_path}/out", f)
        for k in range(firsts[-1]):
            ids, mask = token_files.sequence_at(batches, firsts, k)
            assert len(ids) == 64
            back += ids.filter(mask).to_pylist()
    assert back == every


def test_hilbert_curve_visits_neighbours():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    k = nearest.hilbert_keys(g, 3)
    assert sorted(k.tolist()) == list(range(512))
    assert (np.abs(np.diff(g[np.argsort(k)], axis=0)).sum(axis=1) == 1).all()


def exact_nearest(rows, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in fine:
        if i % 20 == 0:
            s = sorted((-(q * v).sum(), j) for j, v in fine if j != i)[:k]
            out[i] = [(j, -d) for d, j in s]
    return out


def test_nearest(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.5, 2)).tolist()) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 330)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0] * 7 + [None]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "s") for i, v in rows], "vec_id long, embedding array<float>, v string")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = exact_nearest(rows, 20)
    got = {}
    for r in nearest.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [v for v, _ in x] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items()}
    assert all(a[1] == pytest.approx(b[1]) for q in got for a, b in zip(got[q], want[q]))


def test_nearest_windows_reach_recall(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(nearest, "TILE_ROWS", 100)
    rng = np.random.default_rng(10)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = exact_nearest(rows, 10)
    got = {}
    for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, 10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {v for v, _ in x}) / 10 for q, x in want.items()]) >= 0.9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_nearest_recall_on_given_vectors(spark, monkeypatch, sf):
    """The registered parameters on the given 64-dimensional vectors, with the windows of every size in use."""
    from pyspark.sql import functions as F

    from siltstone.llm.registry import queries

    asked = []
    whole = nearest.Curves.fit_cuts
    monkeypatch.setattr(nearest.Curves, "fit_cuts", lambda self, keys, ties, windows: asked.append(windows) or whole(self, keys, ties, windows))
    got = {}
    for r in queries()["op8_nearest"](spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").where(F.col("vec_id").isNotNull()).collect()
    want = exact_nearest([tuple(r) for r in rows], 20)
    recall = np.mean([len(got[q] & {v for v, _ in x}) / 20 for q, x in want.items()])
    print("recall", sf, recall)
    assert asked and set(asked) == {nearest.WINDOWS} and recall >= 0.95


def nearest_recall(spark, rows, of=lambda i: True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {q: x for q, x in exact_nearest(rows, 20).items() if of(q)}
    got = {}
    for r in nearest.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return np.mean([len(got.get(q, set()) & {v for v, _ in x}) / 20 for q, x in want.items()])


def unit_vectors(n, seed):
    v = np.random.default_rng(seed).normal(size=(n, 64))
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def test_nearest_of_very_common_vector(spark):
    v = unit_vectors(1500, 13)
    rows = [(i, (v[0] if i % 3 == 0 else v[i]).tolist()) for i in range(1500)]
    recall = nearest_recall(spark, rows, lambda i: i % 3 == 0)
    print("recall common", recall)
    assert recall == 1


def test_nearest_with_few_very_long_vectors(spark):
    v = unit_vectors(1500, 14)
    rows = [(i, (v[i] * (100 if i in (7, 500, 1001) else 1)).tolist()) for i in range(1500)]
    recall = nearest_recall(spark, rows)
    print("recall long", recall)
    assert recall >= 0.95


def test_boundaries_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        sizes = np.unique(rng.integers(0, 200, rng.integers(1, 11)))
        bins = [(int(n), int(c), int(n * c)) for n, c in zip(sizes, rng.integers(1, 50, len(sizes)))]
        k = int(rng.integers(1, 5))
        ends = packing.boundaries(bins, k)
        cost = lambda e: sum(c * (min(x for x in e if x >= n) - n) for n, c, _ in bins)
        inner = [int(x) for x in sizes[:-1]]
        assert len(ends) <= k and cost(ends) == min(cost([*s, int(sizes[-1])]) for q in range(min(k, len(sizes))) for s in itertools.combinations(inner, q))


def test_packing(spark, odd_rows):
    known = [r for r in odd_rows if r[0] is not None]
    docs = make_docs(spark, odd_rows)
    rows = packing.pack(docs.select("doc_id", packing.word_count(docs.text).alias("n_tokens")), 4, 500, cell_rows=5).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in known)
    batches = {}
    for r in rows:
        assert r.n_tokens <= r.bucket_len
        batches.setdefault(r.bucket, {}).setdefault(r.batch, []).append((r.place, r.bucket_len))
    for b in batches.values():
        capacity = max(1, 500 // max(1, next(iter(b.values()))[0][1]))
        assert sorted(b) == list(range(len(b)))
        assert all(sorted(p for p, _ in x) == list(range(len(x))) for x in b.values())
        assert all(len(b[k]) == capacity for k in sorted(b)[:-1]) and len(b[max(b)]) <= capacity


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 3)}
    lines_ = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return [len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines_) - len(set(lines_)), len(hit)]


def test_quality(spark, odd_rows):
    rows = [r for r in odd_rows if r[0] != 80]
    rows += [(2000 + k, " ".join(f"w{(k * 7 + j * j) % 97}$$$" for j in range(80))) for k in range(40)] + [(3000 + k, " ".join(f"v{(k * 7 + j * j) % 89}" for j in range(80))) for k in range(40)]
    docs = make_docs(spark, rows)
    labels = spark.createDataFrame([(2000 + k, 0, 0) for k in range(0, 40, 2)] + [(3000 + k, 1, 0) for k in range(0, 40, 2)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    for i, t in rows:
        if i is not None:
            c = plain_counts(t or "")
            assert [got[i][k] for k in quality.COUNTS] == c
            assert got[i].base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0]) and not (got[i].base_failed and got[i].kept)
    assert not any(got[2000 + k].kept for k in range(40)) and all(got[3000 + k].kept for k in range(40))  # half of them held out
    assert quality.train(docs, labels.where("false")) is None


def test_forest_is_monotone_and_learns():
    rng = np.random.default_rng(12)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(3000) < 0.05)).astype(float)
    forest = quality.fit_forest(x, y, np.array([-1, 0, 1]))
    test = rng.random((2000, 3))
    assert ((forest.score(test) >= 0.5) == (test[:, 0] < 0.5)).mean() > 0.95
    for j, sign in ((0, -1), (2, 1)):
        lo, hi = test.copy(), test.copy()
        lo[:, j], hi[:, j] = np.sort(rng.random((2000, 2)), axis=1).T
        assert (sign * (forest.score(hi) - forest.score(lo)) >= -1e-12).all()


def test_empty_tables(spark):
    docs = make_docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for out in (ngram_join.ngram_join(docs), dedup_lines(docs), pii.find_pii(docs), pieces.digest_documents(docs), scan_licenses(docs), secrets.scan_secrets(docs), token_files.token_files(docs), nearest.nearest(vectors, F.col("vec_id") % 20 == 0), packing.pack_documents(docs), quality.quality_rules(docs, labels)):
        assert out.collect() == []


def test_very_long_texts(spark):
    """Every operator takes whole texts of 200,000 characters and more, of any sort."""
    han = "".join(chr(0x4E00 + k * k % 5_000) for k in range(200_000))
    words = " ".join(f"w{k % 9_973}x{k // 7}" for k in range(150_000))
    mails = " ".join(f"user{k}@mail{k}.example.com" for k in range(8_000))
    rows = [(1, han), (2, words), (3, words + " tail"), (4, mails), (5, "q" * 300_000), (6, "9 " * 20_000)]
    docs = make_docs(spark, rows)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    by = lambda df: {r.doc_id: r for r in df.collect()}
    joined = by(ngram_join.ngram_join(docs))
    assert [joined[k].component_id for k in range(1, 7)] == [1, 2, 2, 4, 5, 6] and joined[2].n_shingles > 100_000
    assert all(r.n_lines == 1 and not r.n_dropped for r in by(dedup_lines(docs)).values())
    assert by(pii.find_pii(docs))[4].n_email == 8_000
    assert all(r.round_trip for r in by(pieces.digest_documents(docs)).values())
    assert by(scan_licenses(docs))[2].n_words == len(re.findall("[A-Za-z0-9]+", words))
    assert len(by(secrets.scan_secrets(docs))) == len(by(token_files.token_files(docs))) == 6
    assert by(packing.pack_documents(docs))[3].n_tokens == by(quality.quality_rules(docs, labels))[3].n_words == 150_001
