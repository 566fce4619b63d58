"""Word and document vectors on small corpora, and induced vectors against numpy."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tracewell.operators import embed


def cosine(a, b):
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


TOPICS = [["process", "thread", "kernel", "signal", "memory"], ["apple", "orange", "banana", "cherry", "melon"], ["violin", "trumpet", "guitar", "piano", "cello"]]


def sentences(spark, n=300, seed=1):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(i, [str(w) for w in r.choice(TOPICS[i % 3], 8)]) for i in range(n)], "node long, tokens array<string>").repartition(3, "node")


@pytest.fixture(scope="module")
def subwords(spark):
    return embed.train_subwords(sentences(spark), size=12, buckets=2048, window=3, epochs=6, rate=0.1, seed=3)


def test_an_unknown_word_lies_near_its_misspelling(spark, subwords):
    words = [w for t in TOPICS for w in t]
    asked = spark.createDataFrame([(w,) for w in [*words, "trumpett", "proces", "bananas", None, ""]], "word string")
    got = {r.word: r.vec for r in asked.select("word", embed.word_vectors(subwords, "word").alias("vec")).collect()}
    for wrong, right in (("trumpett", "trumpet"), ("proces", "process"), ("bananas", "banana")):
        topic = next(t for t in TOPICS if right in t)  # words of a topic end close together
        assert max(words, key=lambda w: cosine(got[wrong], got[w])) in topic and cosine(got[wrong], got[right]) > 0.8
        assert cosine(got[wrong], got[right]) > max(cosine(got[wrong], got[w]) for w in words if w not in topic) + 0.3
    inside = np.mean([cosine(got[a], got[b]) for t in TOPICS for a in t for b in t if a < b])
    across = np.mean([cosine(got[a], got[b]) for a in TOPICS[0] for b in TOPICS[1]])
    assert inside > across + 0.5 and got[None] is None and len(got[""]) == 12


def test_training_is_repeatable_and_labels_average(spark, subwords):
    again = embed.train_subwords(sentences(spark), size=12, buckets=2048, window=3, epochs=6, rate=0.1, seed=3)
    assert np.allclose(again.inputs, subwords.inputs)
    t = spark.createDataFrame([(1, ["apple", "melon"]), (2, []), (3, None), (4, ["apple", None])], "node long, tokens array<string>")
    got = {r.node: np.array(r.vec) for r in embed.mean_unit_vectors(t, subwords).collect()}
    one = lambda w: (v := subwords.inputs[subwords.rows(w)].mean(0)) / np.linalg.norm(v)
    assert np.allclose(got[1], (one("apple") + one("melon")) / 2) and not got[2].any() and not got[3].any() and np.allclose(got[4], one("apple"))


def test_grams_of_a_word():
    assert set(embed.grams("ab", 10**9)) == {embed.bucket(x, 10**9) for x in ("<ab>", "<ab", "ab>")}
    assert embed.grams("word", 10**9, high=0) == [embed.bucket("<word>", 10**9)]


@pytest.mark.parametrize(("window", "least"), [(0, 0.95), (2, 0.75)])
def test_documents_and_held_out_ones(spark, window, least):
    """Documents of a topic lie together, also those that training has not seen; words around take over a part of what they say."""
    model, vectors = embed.train_documents(sentences(spark, 240), size=10, buckets=512, window=window, epochs=8, rate=0.2, seed=2)
    v = {r.node: np.array(r.vec) for r in vectors.collect()}
    assert len(v) == 240
    centre = [np.mean([v[i] for i in v if i % 3 == k], axis=0) for k in range(3)]
    held = {r.node: np.array(r.vec) for r in embed.infer_documents(sentences(spark, 60, seed=9), model, window, epochs=8, rate=0.2, seed=2).collect()}
    for found in (v, held):
        right = [max(range(3), key=lambda k: cosine(x, centre[k])) == i % 3 for i, x in found.items()]
        assert np.mean(right) > least
    odd = spark.createDataFrame([(1, None), (2, []), (3, ["apple"])], "node long, tokens array<string>")
    assert {r.node: len(r.vec) for r in embed.infer_documents(odd, model).collect()} == {1: 10, 2: 10, 3: 10}
    assert embed.train_documents(odd.filter("node > 8"), 4, 16, epochs=1)[1].collect() == []


def test_contexts_and_induced_vectors(spark):
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    texts = [(i, [str(w) for w in r.choice(words, 12)]) for i in range(60)]
    tokens = spark.createDataFrame(texts, "node long, tokens array<string>").repartition(4)
    have = {w: r.normal(size=3) for w in words[:25]}
    vectors = spark.createDataFrame([(w, v.tolist()) for w, v in have.items()], "word string, vec array<double>")
    contexts = {}
    for _, t in texts:
        for i, w in enumerate(t):
            near = [have[t[j]] for j in range(max(0, i - 2), min(len(t), i + 3)) if j != i and t[j] in have]
            if near:
                contexts.setdefault(w, []).append(sum(near))
    got = {x.word: x for x in embed.context_means(tokens, vectors, 2).collect()}
    assert set(got) == set(contexts)
    for w, c in contexts.items():
        assert got[w].n == len(c) and np.allclose(got[w].vec, np.mean(c, 0))
    c, y = np.array([np.mean(contexts[w], 0) for w in have]), np.array(list(have.values()))
    a, b = embed.induction_sums(embed.context_means(tokens, vectors, 2), vectors)
    assert np.allclose(a, c.T @ c) and np.allclose(b, c.T @ y)
    matrix = np.linalg.lstsq(c, y, rcond=None)[0]
    new = {x.word: x.vec for x in embed.unseen_vectors(tokens, tokens, vectors, 2).collect()}
    assert set(new) == set(words[25:]) & set(contexts)
    for w, v in new.items():
        assert np.allclose(v, np.mean(contexts[w], 0) @ matrix)
    none = embed.induction_sums(embed.context_means(tokens.filter("node > 99"), vectors, 2), vectors)
    assert none[0].shape == (3, 3) and not none[0].any()


def test_contexts_join_no_places(spark):
    """Lists that a small file holds may be many rows: none of them may be joined, by broadcast or otherwise."""
    rows = [(1, ["a", None, "b", "a"]), (2, ["a", "b"]), (3, None), (4, []), (None, ["a", "b"]), (5, ["b"]), (6, ["a", None, "b", "a"])]
    tokens = spark.createDataFrame(rows, "node long, tokens array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 10.0]), ("b", [2.0, 20.0])], "word string, vec array<double>")
    out = embed.context_means(tokens, vectors, 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "node#" in line]
    assert {r.word: (r.n, r.vec) for r in out.collect()} == {"a": (5, [2.0, 20.0]), "b": (3, [5 / 3, 50 / 3])}


def test_texts_of_one_file_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(embed, "TEXTS", 10)
    tokens = spark.createDataFrame([(i, [f"w{i % 7}", "x"]) for i in range(95)], "node long, tokens array<string>").coalesce(1)
    model = embed.new_vectors(tokens, 4, 64, 1)
    for out in (embed.infer_documents(tokens, model, epochs=1), embed.mean_unit_vectors(tokens, model)):
        assert out.select(F.spark_partition_id()).distinct().count() > 5
        assert sorted(r.node for r in out.select("node").collect()) == list(range(95))
