import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import both  # noqa: E402

from tracewell.llm import hard_negatives as hn  # noqa: E402
from tracewell.llm import queries  # noqa: E402

COLUMNS = "vec_id long, embedding array<float>, label int, a long, cell string, q string, d int, lo int"


def rows(vectors, labels, ids=None):
    return [(i if ids is None else ids[i], None if v is None else [None if x is None else float(x) for x in v], y, 1, "c", "q", 2, 3) for i, (v, y) in enumerate(zip(vectors, labels))]


def brute(table):
    kept = []
    for i, v, y, *_ in table:
        if i is None or v is None or y is None or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        kept.append((i, (y + 1) % 10 if i % 7 == 0 else y, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)))
    wide = max((len(v) for *_, v in kept), default=0)
    kept = [(i, y, np.pad(v, (0, wide - len(v)))) for i, y, v in kept]
    out = []
    for i, y, v in {(i, y, v.tobytes()): (i, y, v) for i, y, v in kept if i % 50 == 0}.values():
        scored = sorted((-int(v @ w), j, z) for j, z, w in kept if j != i)
        for p, j, z in [s for s in scored if s[2] == y][:5]:
            negatives = [(s, k) for s, k, x in scored if x != y and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(negatives)]
    return sorted(out)


def run(spark, table):
    return sorted(map(tuple, hn.hard_negatives(spark.createDataFrame(table, COLUMNS)).collect()))


def clustered(n, seed, dims=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims))
    return centres[r.integers(0, 6, n)] + 0.4 * r.normal(size=(n, dims)), [int(x) for x in r.integers(0, 10, n)]


def test_equals_sql(spark):
    ours, theirs = both(spark, queries.QUERIES["op11_hard_negatives"], queries.ORACLES["op11_hard_negatives"], "/root/testdata/sf0.001")
    assert ours == theirs and ours


@pytest.mark.parametrize("broadcast", [0, 1 << 30])
def test_equals_brute_force_in_small_blocks(spark, monkeypatch, broadcast):
    for name, value in (("ROWS", 16), ("ANCHORS", 3), ("HELD", 2), ("BROADCAST", broadcast)):
        monkeypatch.setattr(hn, name, value)
    vectors, labels = clustered(700, 1)
    table = rows(vectors, labels)
    assert run(spark, table) == brute(table) != []


def test_ties_repeats_and_one_vector_of_a_third(spark):
    vectors, labels = clustered(600, 2)
    vectors[::3] = [1, 0, 0.5, 0, 0, 0, 0, 0, 0, 0, 0, 0.25]
    vectors[1::3] = np.round(vectors[1::3])
    table = rows(vectors, labels)
    table += table[50:60] + table[100:101] * 3  # anchors and others that repeat
    assert run(spark, table) == brute(table) != []


def test_rows_that_take_no_part(spark):
    vectors, labels = clustered(200, 3)
    table = rows(vectors, labels)
    bad = [[None] + [0.1] * 11, [float("nan")] * 12, [float("inf")] + [0.0] * 11, None, [1e30] * 12]
    table += [(1000 + 50 * k, v, 3, 1, "c", "q", 2, 3) for k, v in enumerate(bad)]
    table += [(1, [0.5] * 12, None, 1, "c", "q", 2, 3), (None, [0.5] * 12, 2, 1, "c", "q", 2, 3), (2000, [], 1, 1, "c", "q", 2, 3), (2001, [1.0, 2.0], 1, 1, "c", "q", 2, 3)]
    assert run(spark, table) == brute([r for r in table if r[1] is None or 1e30 not in r[1]])


def test_edges(spark):
    assert run(spark, []) == []
    alone = rows([[1.0, 0.0]], [1])
    assert run(spark, alone) == []
    zeros = rows([[0.0, 0.0]] * 8, [1, 1, 2, 2, 1, 2, 3, 3])  # scores of 0: the band is 0 itself
    assert run(spark, zeros) == brute(zeros) != []
    few = rows([[1, 0], [-1, 0], [-0.6, 0]], [1, 2, 2], [50, 57, 58])  # no positive, or a negative score
    assert run(spark, few) == brute(few)


def test_brackets_hold_every_score():
    r = np.random.default_rng(4)
    q, x = np.floor(256 * r.normal(size=(20, 9))), np.floor(256 * r.normal(size=(300, 9)))
    norm = (x * x).sum(1).max()
    p = hn.Pivots(x, norm)
    d_rows, d_anchors = p.distances(p.augmented(x)), p.distances(np.hstack([q, np.zeros((20, 1))]))
    s = q @ x.T
    keep = hn.survivors(d_rows, d_anchors, (q * q).sum(1), s.max(1), s.max(1), norm, p.slack)
    assert keep[np.arange(20), s.argmax(1)].all()
    near = np.vstack([x[:5] * 0.999])
    keep = hn.survivors(d_rows, p.distances(np.hstack([near, np.zeros((5, 1))])), (near * near).sum(1), (near @ x.T).max(1), np.full(5, np.inf), norm, p.slack)
    assert keep.mean() < 1  # the table does bound some out
