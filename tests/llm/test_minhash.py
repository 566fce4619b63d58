import random

import numpy as np

from tracewell.llm import minhash


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().encode().split()
        k = min(5, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return {d: least[top(i)] for i, (d, _) in enumerate(rows)}


def chain(n, seed=1):
    """Texts in which each changes one word of the one before, so that only neighbours are similar."""
    random.seed(seed)
    words = [f"w{random.randrange(10**6)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(words)
        words[random.randrange(len(words))] = f"w{random.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_equals_brute_force(frame):
    texts = chain(40) + chain(3, 2) * 2 + ["a b c", "a b c", "x y", None, "", "the " * 50]
    rows = list(enumerate(texts))
    want = brute(rows)
    for limit in (minhash.LIMIT, 8):  # 8: meetings split by further bands
        got = {r.doc_id: r.class_id for r in minhash.near_classes(frame(rows), limit=limit).collect()}
        assert got == want


def test_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    h = rng.integers(1, 2**63, 900, dtype=np.uint64)
    same = []
    for k in range(40):
        salt = np.uint64(k * 7919 + 1)
        a, b = (minhash.mix(x + salt) for x in (h[:800], h[100:]))
        same.append((minhash.sketch(a, np.ones(800)) == minhash.sketch(b, np.ones(800))).mean())
    assert abs(np.mean(same) - 700 / 900) < 0.03


def test_weights_count(frame):
    h = np.array([11, 22], np.uint64)
    won = np.mean([(minhash.sketch(minhash.mix(h + np.uint64(k)), np.array([3.0, 1.0])) == minhash.mix(h + np.uint64(k))[0]).mean() for k in range(200)])
    assert abs(won - 0.75) < 0.05


def test_copies_with_a_line_repeated_many_times(frame):
    texts = []
    for text in chain(1, 7) + chain(1, 8) + chain(1, 9):
        texts += [text, text + " see our five word line" * 100]
    rows = list(enumerate(texts))
    want = brute(rows)
    assert set(want.values()) == {0, 2, 4}
    assert {r.doc_id: r.class_id for r in minhash.near_classes(frame(rows)).collect()} == want


def two_sides(n, seed):
    """Texts of two classes of n that only one pair links, at similarity 0.806; the other pairs lie at 0.77 to 0.79."""
    random.seed(seed)
    new = lambda: f"w{random.randrange(10**9)}"
    base = [new() for _ in range(200)]
    other = {k: new() for k in (0, 2, 20, 30, 198)}
    out = []
    for side in (0, 1):
        for i in range(n):
            own = list(base)
            own[40 + 5 * (i % 14) + 70 * side] = new()  # five shingles of its own
            for k in ((0, 20, 30, 198) if i == 0 else (0, 2, 20, 30, 198)) if side else ((198,) if i == 0 else ()):
                own[k] = other[k]
            out.append(" ".join(own))
    return out


def near_group(n, seed, words=120, changed=1):
    """n texts that each change some words of one text: at one word, any two have similarity 0.83 or more."""
    random.seed(seed)
    base = [f"w{random.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(changed):
            own[random.randrange(words)] = f"w{random.randrange(10**9)}"
        out.append(" ".join(own))
    return out


def test_large_group_of_near_copies(frame):
    rows = list(enumerate(near_group(5000, 11) + chain(3, 12) + near_group(1, 13)))
    got = [(r.class_id, r.class_size) for r in minhash.near_classes(frame(rows)).collect()]
    assert sorted(set(got)) == [(0, 5000), (5000, 3), (5003, 1)]


def test_large_group_is_split_without_multiplying(frame):
    from pyspark.sql import functions as F

    rows = frame(list(enumerate(near_group(30, 3, words=3000))))
    node = F.sha2("text", 256).cast("binary")
    nodes = rows.select(node.alias("node"), F.array(*[F.lit(k) for k in range(minhash.BANDS)]).alias("bands"), F.lit(8).alias("size"))
    met = minhash.meetings(nodes)
    assert met.count() == 30 * minhash.BANDS
    blocks = minhash.in_blocks(met, 8)
    assert blocks.count() <= (30 + 2 * 4) * minhash.BANDS and blocks.groupBy("key", "block").count().agg(F.max("count")).first()[0] <= 20


def test_group_in_which_few_pairs_are_linked(frame):
    rows = list(enumerate(near_group(150, 21, 185, 3) + near_group(90, 22, 165, 3)))
    want = brute(rows)
    assert 20 < len(set(want.values())) < 240
    for limit in (minhash.LIMIT, 16):
        assert {r.doc_id: r.class_id for r in minhash.near_classes(frame(rows), limit=limit).collect()} == want


def test_very_long_texts(frame):
    a = near_group(2, 31, words=60_000)
    rows = [(0, a[0]), (1, a[1]), (2, a[0][: len(a[0]) // 2]), (3, a[0])]
    assert {r.doc_id: r.class_id for r in minhash.near_classes(frame(rows)).collect()} == {0: 0, 1: 0, 2: 2, 3: 0}


def test_links_behind_many_pairs_that_fail(frame):
    rows = list(enumerate(t for seed in range(20) for t in two_sides(14, seed)))
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in minhash.near_classes(frame(rows)).collect()} == want


def test_one_of_each_group_stays(frame):
    texts = chain(6) + ["something else entirely with enough words in it"]
    kept = minhash.first_of_each(frame(list(enumerate(texts)) + [(0, texts[0])]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 6]


def test_edge_cases(edge, empty):
    out = minhash.near_classes(edge).collect()
    assert len(out) == edge.count()
    kept = minhash.first_of_each(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 5, 6, 7] and ids.count(None) == 1
    assert minhash.near_classes(empty).count() == 0 and minhash.first_of_each(empty).count() == 0
