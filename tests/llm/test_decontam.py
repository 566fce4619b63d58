import random
from collections import Counter

from tracewell.llm import decontam

ITEMS = [(i, " ".join(f"i{i}w{k}" for k in range(n))) for i, n in enumerate((3, 12, 20, 20, 37))] + [(5, None), (6, ""), (7, "i1w0 i1w1 i1w2 i1w3 i1w4 i1w5")]


def brute(text, items, threshold=0.8):
    w, out = (text or "").lower().split(), {}
    for i, x in items:
        v = (x or "").lower().split()
        if not v:
            continue
        k = min(5, len(v))
        bag, n = Counter(tuple(v[j : j + k]) for j in range(len(v) - k + 1)), len(v) - k + 1
        own = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
        best = max((sum((Counter(own[s : s + n]) & bag).values()) for s in range(len(own) - n + 1)), default=0)
        if best and best / (2 * n - best) >= threshold - 1e-9:
            out[i] = round(best / (2 * n - best), 9)
    return out


def test_equals_brute_force():
    random.seed(4)
    index = decontam.Index(ITEMS, 0.8)
    for _ in range(300):
        words = [f"f{random.randrange(50)}" for _ in range(40)]
        item = (random.choice(ITEMS[:5])[1]).split()
        for _ in range(random.randrange(3)):
            item[random.randrange(len(item))] = "other"
        at = random.randrange(40)
        text = " ".join(words[:at] + item + words[at:])
        assert {k: round(v, 9) for k, v in index.find(text).items()} == brute(text, ITEMS)


def test_documents_shorter_than_an_item():
    index = decontam.Index(ITEMS, 0.8)
    words = ITEMS[4][1].split()
    assert index.find(" ".join(words[:-1])) == {4: 32 / 33} and index.find(" ".join(words[2:-2])) == {4: 29 / 33}
    assert index.find(" ".join(words[:20])) == {}


def test_blocks_find_every_item_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    prints = rng.integers(0, 256, (300, 16), dtype=np.uint8)
    blocks = decontam.Blocks(prints)
    bits = np.unpackbits(prints, axis=1)
    for i in range(300):
        bits[i, rng.permutation(128)[: decontam.RADIUS]] ^= 1
    near = np.packbits(bits, axis=1)
    far = np.unpackbits(near[:, None, :] ^ prints[None, :, :], axis=2).sum(axis=2)
    assert {tuple(x) for x in blocks.within(near).tolist()} == set(zip(*(x.tolist() for x in np.nonzero(far <= decontam.RADIUS))))


def test_blocks_prune():
    import numpy as np

    rng = np.random.default_rng(2)
    blocks = decontam.Blocks(rng.integers(0, 256, (2000, 16), dtype=np.uint8))
    met = blocks.met(rng.integers(0, 256, (100, 16), dtype=np.uint8))
    assert sum(decontam.LIMITS) == decontam.RADIUS - decontam.BLOCKS + 1 and len(met) / 200_000 < 0.22


def test_recall_at_the_threshold():
    """Copies of long items with words changed in one place, at similarity 0.8 to 0.9, are found."""
    random.seed(6)
    items = [(i, " ".join(f"a{i}w{random.randrange(10**6)}" for _ in range(random.choice((60, 90))))) for i in range(40)]
    index, wanted, found = decontam.Index(items, 0.8), 0, 0
    for i, text in items * 5:
        words = text.split()
        at = random.randrange(len(words) - 6)
        words[at : at + random.randrange(1, 5)] = [f"x{random.randrange(10**6)}"] * random.randrange(1, 5)
        hidden = " ".join(["before"] * 30 + words + ["after"] * 30)
        want = brute(hidden, items)
        wanted, found = wanted + len(want), found + len(set(want) & set(index.find(hidden)))
    assert wanted > 100 and found == wanted


def test_very_long_text_and_ties():
    index = decontam.Index(ITEMS + [(8, ITEMS[2][1])], 0.8)
    words = [f"f{random.randrange(50)}" for _ in range(200_000)]
    assert index.find(" ".join(words[:100_000] + ITEMS[2][1].split() + words[100_000:])) == {2: 1.0, 8: 1.0}


def test_edge_cases(spark, edge, empty, frame):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontam.matches(edge, items)
    assert out.count() == edge.count() and out.filter("size(leaks) > 0").count() == 0
    hit = frame([(1, "before " + ITEMS[2][1].upper() + " after"), (2, "clean text of no item")])
    assert [(r.doc_id, r.item_id, r.similarity) for r in decontam.leaks(hit, items).collect()] == [(1, 2, 1.0)]
    assert decontam.leaks(hit, items.filter("item_id < 0")).count() == 0
    assert decontam.matches(empty, items).count() == 0


def test_items_in_groups(spark, frame, monkeypatch):
    monkeypatch.setattr(decontam, "GROUP", 2)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    hit = frame([(1, " ".join(x for _, x in ITEMS[1:5]))])
    assert sorted(r.item_id for r in decontam.leaks(hit, items).collect()) == [1, 2, 3, 4, 7]
