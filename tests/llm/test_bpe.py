import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = bpe.coder(PATH, P.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n'stre1é \x1c日", max_size=80)))
def test_equals_the_library(text):
    ids = np.frombuffer(OURS.encode([text])[0], "<u4")
    assert ids.tolist() == THEIRS.encode_ordinary(text)
    assert OURS.decode(ids) == text.encode()


def test_long_pieces():
    texts = ["a" * 5000, " " * 3000, "ab" * 777, "=-" * 400, "x" * 192, "x" * 193, "é" * 300]
    for t, ids in zip(texts, OURS.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == THEIRS.encode_ordinary(t)


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    texts = [f"number {i} and word{i}" for i in range(200)]
    for t, ids in zip(texts, OURS.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == THEIRS.encode_ordinary(t)


def test_edge_cases(edge, empty):
    out = bpe.digests(edge, PATH, P.PATTERN).collect()
    texts = sorted(r.text or "" for r in edge.collect())
    assert sorted(r.decoded_sha256 for r in out) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    back = bpe.decode(bpe.encode(edge, PATH, P.PATTERN), PATH, P.PATTERN)
    assert sorted(bytes(r.decoded).decode() for r in back.collect()) == texts
    assert all(len(r.ids) == r.n_tokens for r in back.collect())
    assert bpe.digests(empty, PATH, P.PATTERN).count() == 0


def test_round_trip_in_one_pass(edge, empty):
    two = bpe.decode(bpe.encode(edge, PATH, P.PATTERN), PATH, P.PATTERN)
    key = lambda r: (str(r.doc_id), bytes(r.decoded), r.n_tokens, r.ids, r.score)
    one = bpe.round_trip(edge, PATH, P.PATTERN)
    assert one.columns == [*(c for c in edge.columns if c not in ("ids", "decoded")), "ids", "n_tokens", "decoded"]
    assert sorted(map(key, one.collect())) == sorted(map(key, two.collect()))
    assert bpe.round_trip(empty, PATH, P.PATTERN).count() == 0
