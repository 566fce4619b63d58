import random
from collections import Counter
import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm.suffix_array import _by_lists, permuted_lcp, suffix_array
from tracewell.llm.suffix_dedup import digest_columns, piece_hashes, suffix_dedup


def brute(texts, span):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + span] for b in texts for i in range(len(b) - span + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(values):
    s = values + [0]
    order = sorted(range(len(s)), key=lambda i: s[i:])
    assert suffix_array(np.array(s)).tolist() == order
    assert _by_lists(s, max(s) + 1) == order
    plcp, phi = permuted_lcp(np.array(s, np.int16), np.array(order))
    for a, b in zip(order[1:], order):
        n = next(k for k in range(len(s)) if max(a, b) + k >= len(s) or s[a + k] != s[b + k])
        assert plcp[a] == n and phi[a] == b


def texts():
    random.seed(5)
    word = lambda n: "".join(random.choice("abcdé") for _ in range(n))
    passages = [word(300) for _ in range(3)]
    out = [None, "", "a" * 1000, "ab" * 400, word(199)]
    for _ in range(40):
        t = word(random.randrange(300))
        for _ in range(random.randrange(3)):
            p, a = random.choice(passages), random.randrange(60)
            t += p[a : a + random.randrange(150, 300)] + word(random.randrange(200))
        out.append(t)
    return out + out[5:9] + [out[10]] * 3


def test_equals_brute_force(frame):
    given_texts = texts()
    docs = frame(list(enumerate(given_texts)))
    for hot in (1024, 1):  # all values by suffix arrays; all by tiles of hashes
        got = sorted(tuple(r)[1:] for r in digest_columns(suffix_dedup(docs, 200, hot)).collect())
        assert got == brute(given_texts, 200)


def test_hot_piece_at_several_places(frame):
    random.seed(6)
    word = lambda n: "".join(random.choice("abcdefgh") for _ in range(n))
    h = piece_hashes(np.frombuffer(word(300_000).encode(), np.uint8), 32)
    random.seed(6)
    piece = word(300_000)[h.argmin() :][:32]  # the least of every string that holds it
    given_texts = []
    for gap in (13, 45, 60):  # distances that are no multiple of 16
        shared = word(100) + piece + word(75)
        given_texts += [word(150) + piece + word(gap) + shared + word(150), word(150) + shared + word(150)]
        twice = word(60) + piece + word(115)
        given_texts += [word(99) + piece + word(gap) + twice + word(99), word(99) + piece + word(gap + 7) + twice + word(99)]
    got = sorted(tuple(r)[1:] for r in digest_columns(suffix_dedup(frame(list(enumerate(given_texts))), 200, 1)).collect())
    assert got == brute(given_texts, 200) and all(r[1] >= 207 for r in got)


def test_edge_cases(edge, empty):
    got = digest_columns(suffix_dedup(edge)).collect()
    assert sorted(tuple(r)[1:] for r in got) == brute([r.text for r in edge.select("text").collect()], 200)
    assert suffix_dedup(empty).count() == 0


def test_long_text_of_one_period(frame):
    """One context of many times the usual length goes the way of many contexts."""
    random.seed(7)
    given_texts = ["".join(random.choice("xyz") for _ in range(71)) * 6500, "short", "".join(random.choice("xyz") for _ in range(400))]
    got = sorted(tuple(r)[1:] for r in digest_columns(suffix_dedup(frame(list(enumerate(given_texts))))).collect())
    assert got == brute(given_texts, 200)
