import math

import numpy as np
import pytest

from tracewell.llm import lmscore, support


def test_target_like_documents_score_lower(spark, frame):
    good, bad = "the cat sat on the mat and the dog sat too", "zzz qqq xxx yyy zzz qqq vvv"
    docs = frame([(i, f"{good} {i}") for i in range(40)] + [(100 + i, f"{bad} {i}") for i in range(40)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(35)] + [(100, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.difference for r in lmscore.cross_entropy_difference(docs, labels).collect()}
    assert all(got[i] < 0 < got[100 + i] for i in range(40))  # labelled or not
    assert max(got[i] for i in range(35)) > min(got[i] for i in range(35, 40))  # and alike


def test_a_text_is_no_evidence_for_itself(spark, frame):
    """One labelled document that shares nothing with others: its own counts do not draw it to the target."""
    own = "words that occur in this text alone and nowhere else"
    docs = frame([(i, f"common text number {i} of many") for i in range(60)] + [(100, own), (101, own)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(100, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.difference for r in lmscore.cross_entropy_difference(docs, labels).collect()}
    assert got[100] == got[101] and abs(got[100]) < 0.2


def ahead(scores, positive):
    """Share of pairs in which a positive has the lower score."""
    s, y = np.array(scores), np.array(positive)
    a, b = s[y][:, None], s[~y]
    return ((a < b) + (a == b) / 2).mean()


def test_random_labels_do_not_separate(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"])
    labels = docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    got = [r for r in lmscore.cross_entropy_difference(docs, labels).collect() if r.n_tokens > 20]
    assert abs(ahead([r.difference for r in got], [r.doc_id in good for r in got]) - 0.5) < 0.05


def test_held_out_labels_separate(spark):
    """Labels of half of the labelled documents tell the other half apart."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality is not null and toxic is not null")
    known = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.collect()}
    used = labels.filter("crc32(cast(doc_id as string)) % 2 = 0")
    seen = {r.doc_id for r in used.collect()}
    rest = [r for r in lmscore.cross_entropy_difference(spark.read.parquet(f"{sf}/documents.parquet"), used).collect() if r.doc_id in known and r.doc_id not in seen and r.n_tokens > 20]
    assert ahead([r.difference for r in rest], [known[r.doc_id] for r in rest]) > 0.7


def test_edge_cases(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(3, None, 0), (3, 1, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        out = lmscore.cross_entropy_difference(edge, labels).collect()
        assert len(out) == edge.count()
        assert all((r.difference is None) == (r.n_tokens == 0) for r in out)
        assert all(r.difference is None or math.isfinite(r.difference) for r in out)
    assert lmscore.cross_entropy_difference(empty, none).count() == 0


def brute(spark, texts, good):
    """Losses by counting every bigram of the other folds in dictionaries."""
    from collections import Counter

    def grams(t):
        w = (t or "").lower().split()
        return list(zip([None, *w], w))

    table = spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "i int, text string")
    folds = dict(map(tuple, table.select("i", lmscore.fold("text")).collect()))
    words = {w for t in texts for _, w in grams(t)}
    tokens = [len(grams(t)) for t in texts]
    share = sum(tokens[i] for i in good) / sum(tokens) or 1.0
    losses = []
    for use, scale in ((list(good), 1.0), (range(len(texts)), share)):
        own = []
        for i, t in enumerate(texts):
            two = Counter(g for j in use if folds[j] != folds[i] for g in grams(texts[j]))
            one, before, kinds = Counter(), Counter(), Counter()
            for (v, w), n in two.items():
                one[w] += n * scale
                before[v] += n * scale
                kinds[v] += 1 - (1 - scale) ** n
            p = lambda v, w: (two[v, w] * scale + max(kinds[v], 1) * (one[w] + 1) / (sum(one.values()) + len(words))) / (before[v] + max(kinds[v], 1))  # noqa: E731, B023
            own.append(-sum(math.log(p(*g)) for g in grams(t)) / len(grams(t)) if grams(t) else None)
        losses.append(own)
    return losses


def test_every_word_and_context_counts(spark, frame, monkeypatch):
    import random

    random.seed(2)
    texts = [" ".join(f"w{int(random.paretovariate(0.6))}" for _ in range(random.randrange(120))) for _ in range(60)] + [None, "", "one"]
    texts.append(texts[3])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 3)], "doc_id long, quality int, toxic int")
    target, background = brute(spark, texts, range(0, 60, 3))
    for hot in (lmscore.HOT, 50):  # every bigram in each task; most by the join
        monkeypatch.setattr(lmscore, "HOT", hot)
        for r in lmscore.cross_entropy_difference(frame(list(enumerate(texts))), labels).collect():
            assert (r.loss_target, r.loss_background) == (pytest.approx(target[r.doc_id]), pytest.approx(background[r.doc_id]))


def test_ties_and_a_very_long_text(spark, frame):
    long = "many words of a text that goes on " * 30_000
    docs = frame([(0, long), (1, "a b"), (2, "b a"), (3, "a b"), (4, "a b")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lmscore.cross_entropy_difference(docs, labels).collect()}
    assert got[0].n_tokens == 240_000 and got[1].difference == got[3].difference == got[4].difference
    target, background = brute(spark, [long, "a b", "b a", "a b", "a b"], [1, 2])
    assert [got[i].loss_background for i in range(5)] == [pytest.approx(x) for x in background]
    assert [got[i].loss_target for i in range(5)] == [pytest.approx(x) for x in target]


def test_disk_stays_a_few_times_the_texts(spark):
    """Scratch tables and shuffle files that a run leaves, against the Parquet file of the texts."""
    import os
    from pathlib import Path

    path = "/root/testdata/sf0.01"

    def used():
        shuffles = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        local = sum(shuffles.apply(i).length() for i in range(shuffles.size()))
        return local + sum(p.stat().st_size for t in support.tables() for p in Path(t.removeprefix("file://").removeprefix("file:")).rglob("*.parquet"))

    before = used()
    lmscore.cross_entropy_difference(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    assert used() - before < 3 * os.path.getsize(f"{path}/documents.parquet")


def test_a_chunk_takes_little_memory(monkeypatch):
    """Arrays that a worker holds at once while it packs chunks, and what it returns at a time."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(lmscore, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, rng.zipf(1.3, 1000) % 50_000)) for _ in range(1700)]
    n = np.arange(len(texts))
    rows = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(n), pa.array(n), pa.array(n % 4)], ["text", "k1", "k2", "class"])
    tracemalloc.start()
    sizes = [b.nbytes for b in lmscore._spread(np.array([lmscore.BEGIN], np.uint64), np.zeros(0, np.int64), 300)(iter([rows]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6 and max(sizes) < 4e6
