import pytest
from oracle import both

import __spark_entry__
from tracewell.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    ours, theirs = both(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)
    assert ours == theirs


def test_queries_without_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"word2vec_vectors", "edge_type_losses", "reconstruction_losses", "node_memory", "unseen_word_vectors", "subword_vectors", "inferred_documents"}


def test_word_vectors_of_every_name(spark):
    """Trained vectors: one a node, of the asked size, of unit length, equal for equal names."""
    part = spark.read.parquet(f"{SF}/part.parquet")
    out = catalog.QUERIES["word2vec_vectors"](spark, SF).collect()
    assert len(out) == part.count() and {r.n for r in out} == {8}


def test_vectors_of_every_part(spark):
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    for name in ("subword_vectors", "inferred_documents"):
        out = catalog.QUERIES[name](spark, SF).collect()
        assert len(out) == n and {r.n for r in out} == {8}


def test_reconstruction_learns(spark):
    losses = [r.loss for r in catalog.QUERIES["reconstruction_losses"](spark, SF).collect()]
    v = [[x or 0 for x in r.embedding] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert len(losses) == len(v) and sum(losses) / len(losses) < sum(sum(x * x for x in u) / len(u) for u in v) / len(v)  # better than zeros


def test_unseen_words_by_numpy(spark):
    """Least squares over mean contexts, word by word."""
    import numpy as np

    texts = [r.p_name.split(" ") for r in spark.read.parquet(f"{SF}/part.parquet").collect() if r.p_name is not None]
    vec = {w: np.array([len(w), len(w) % 3 + 1.0]) for t in texts for w in t if w < "n"}
    contexts = {}
    for t in texts:
        for i, w in enumerate(t):
            near = [vec[t[j]] for j in range(max(0, i - 2), min(len(t), i + 3)) if j != i and t[j] in vec]
            if near:
                contexts.setdefault(w, []).append(sum(near))
    mean = {w: np.mean(c, 0) for w, c in contexts.items()}
    fit = [w for w in mean if w in vec]
    matrix = np.linalg.lstsq(np.array([mean[w] for w in fit]), np.array([vec[w] for w in fit]), rcond=None)[0]
    got = {r.word: (r.x0, r.x1) for r in catalog.QUERIES["unseen_word_vectors"](spark, SF).collect()}
    assert set(got) == set(mean) - set(vec)
    for w, x in got.items():
        assert x == pytest.approx((mean[w] @ matrix).tolist(), abs=1e-3)


def test_memory_by_loops(spark):
    import datetime

    from test_walks_memory import memory_by_loops

    from tracewell.plans import model
    from tracewell.plans.learned import rule

    w = {"w": rule(12, 11, 1) / 4, "u": rule(12, 4, 2) / 4, "b": rule(1, 12, 3)[0] / 4, "c": rule(1, 12, 4)[0] / 4, "rate": [1.0, 0.1], "phase": [0.0, 0.0]}
    import numpy as np

    w = {k: np.array(v) for k, v in w.items()}
    events = [((datetime.date.fromisoformat(r.day) - datetime.date(2024, 1, 1)).days, r.event_id, r.t, r.src, r.dst, [r.loss / 100]) for r in model.events(spark, SF).collect()]
    want = {(b, n): h for b, n, h, _ in memory_by_loops(events, w, "last", 3_600_000_000_000)}
    got = {(r.batch, r.node): (r.m0, r.m1, r.m2, r.m3) for r in catalog.QUERIES["node_memory"](spark, SF).collect()}
    assert set(got) == set(want)
    for k, h in want.items():
        assert got[k] == pytest.approx(h.tolist(), abs=2e-6)


def test_edge_type_losses_beat_chance(spark):
    """A trained scorer gives each test edge a loss, on average no worse than that of equal odds."""
    import math

    out = [r.loss for r in catalog.QUERIES["edge_type_losses"](spark, SF).collect()]
    events = spark.read.parquet(f"{SF}/events.parquet").filter("ts >= timestamp'2024-01-21'").count()
    assert len(out) == events and min(out) > 0 and sum(out) / len(out) < math.log(5) * 1.1


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
