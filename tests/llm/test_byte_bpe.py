"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from siltstone.llm import byte_bpe

from .conftest import make_docs

FILE = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(public_tokenizers.path(FILE))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(encoder, texts):
    ids, counts = encoder.encode(texts)
    ends = np.cumsum(counts)
    return [ids[j - n : j].tolist() for j, n in zip(ends, counts)]


def odd_texts():
    rng = random.Random(11)
    signs = [*"astrevlmdRSTLD1²Ⅷ!.'\"-é漢ǅ́\t\n\x0b\x1c\x85  　😀\U0003134f", " ", " ", " ", "'", "'", "'"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(20_000)]


def test_slices_and_ids_of_odd_texts(library):
    texts = odd_texts()
    encoder = byte_bpe.Encoder(public_tokenizers.path(FILE), memory=5_000)  # small, so that generations change
    for k in range(0, len(texts), 997):
        assert ids_of(encoder, texts[k : k + 997]) == [library.encode_ordinary(t) for t in texts[k : k + 997]]
    assert len(encoder.young) <= 5_000 + 997 * 60


def test_very_long_slices_and_texts(library):
    rng = random.Random(12)
    texts = ["漢字仮名" * 20_000, "a" * 5_000, " " * 7_000, "\n " * 3_000 + "x", "".join(rng.choice("例文です漢字の") for _ in range(30_000)), "'re" * 4_000, " ".join(map(str, range(60_000)))]
    encoder = byte_bpe.Encoder(public_tokenizers.path(FILE))
    assert ids_of(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_scan_equals_one_step_at_a_time():
    a, rng = byte_bpe.automaton(), np.random.default_rng(1)
    kinds = rng.integers(0, len(byte_bpe.CLASSES), 200_000)
    state, states = 0, []
    for c in kinds.tolist():
        states.append(state)
        state = a.next[state, c]
    assert a.before(a.of_class[kinds]).tolist() == states
    f, g, h = rng.integers(0, a.size, (3, 1_000))
    then = lambda x, y: a.then[x * a.size + y]
    assert (then(then(f, g), h) == then(f, then(g, h))).all()


def test_equal_hashes_do_not_confuse_slices(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "mix64", lambda h: h % np.uint64(7))
    texts = odd_texts()[:500]
    assert ids_of(byte_bpe.Encoder(public_tokenizers.path(FILE)), texts) == [library.encode_ordinary(t) for t in texts]


def test_documents_and_ranges(spark, odd_rows, library):
    known = [(i, t or "") for i, t in odd_rows if i is not None]
    got = sorted(tuple(r) for r in byte_bpe.digests(make_docs(spark, odd_rows)).collect())
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for i, t in known:
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode())))
    assert got == sorted(want)
    assert byte_bpe.digests(make_docs(spark, [])).collect() == []
    encoded = byte_bpe.encode(make_docs(spark, odd_rows))
    for r in encoded.where("size(ids) > 4").limit(5).collect():
        assert dict(known)[r.doc_id].encode()[r.ends[1] : r.ends[3]] == b"".join(library.decode_single_token_bytes(k) for k in r.ids[2:4])
    part = byte_bpe.decode(encoded.selectExpr("doc_id", "slice(ids, 3, 2) ids", "slice(ends, 3, 2) ends")).where("doc_id = 80").first()
    assert part.decoded == b"".join(library.decode_single_token_bytes(k) for k in part.ids)
