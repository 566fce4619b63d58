import hashlib

import public_tokenizers as P

import corpus_pipeline
from tracewell.llm import bpe, support

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n, texts = docs.columns, docs.count(), {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = support.stored(stage(spark, docs, SF), name)
        assert set(columns) <= set(docs.columns)
        if name != "byte_bpe":
            assert docs.columns == columns
        assert 0.8 * n < docs.count() <= n
        n = docs.count()
    coder = bpe.coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for r in docs.collect():
        assert coder.encode([r.text])[0] == b"".join(i.to_bytes(4, "little") for i in r.ids)
        lines = texts[r.doc_id].split("\n")
        assert all(x in lines for x in r.text.split("\n"))
    a = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect())
    b = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in corpus_pipeline.run(spark, SF).collect())
    assert a == b


def test_odd_rows(spark, edge, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    docs = edge
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = support.stored(stage(spark, docs, SF), name)
        assert docs.columns == edge.columns
    assert docs.count() > 0


def test_a_result_that_is_not_written_keeps_its_scratch_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lazy = corpus_pipeline.near_dedup(spark, docs, SF)
    assert corpus_pipeline.decontaminate(spark, lazy, SF).count() > 100


def test_equals_stages_done_by_brute_force(spark, frame):
    """Line dedup, near duplicates, benchmark items and ids of run()'s stages, from plain loops over a few documents."""
    from collections import Counter

    import tiktoken

    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(80).collect()
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    now = {n: support.stored(f(spark, docs, SF), n) for n, f in corpus_pipeline.STAGES[:1]}["language_id"]
    kept = sorted((r.doc_id, r.text) for r in now.collect())

    seen, cut = set(), {}
    for i, text in kept:  # every run of lines of 50 words or more that an earlier place holds goes
        lines = text.split("\n")
        unit = [k for k, x in enumerate(lines) if x.encode().strip()]
        size = [len(lines[k].encode().split()) for k in unit]
        gone, new = set(), set()
        for s in range(len(unit)):
            for e in range(s + 1, min(len(unit), s + 60) + 1):
                if sum(size[s:e]) >= 50:
                    run = tuple(lines[k] for k in unit[s:e])
                    if run in seen or run in new:
                        gone |= set(range(unit[s], unit[e - 1] + 1))
                    new.add(run)
                    if sum(size[s : e - 1]) >= 50 and sum(size[s + 1 : e]) >= 50:
                        break
        seen |= new
        if len(gone & set(unit)) < len(unit) or not gone:
            cut[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    now = support.stored(corpus_pipeline.drop_repeated_lines(spark, now, SF), "lines")
    assert {r.doc_id: r.text for r in now.collect()} == cut

    def shingles(t):
        w = t.lower().encode().split()
        k = min(5, len(w))
        return [tuple(w[j : j + k]) for j in range(len(w) - k + 1)] if w else []

    sets, up = {i: set(shingles(t)) for i, t in cut.items()}, {i: i for i in cut}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in cut:
        for b in cut:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    now = support.stored(corpus_pipeline.near_dedup(spark, now, SF), "near")
    assert sorted(r.doc_id for r in now.collect()) == sorted(i for i in cut if top(i) == i)

    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(t):
        own = shingles(t)
        for item in filter(None, items):
            bag, n = Counter(item), len(item)
            for s in range(max(1, len(own) - n + 1)):
                window = Counter(own[s : s + n])
                both = sum((window & bag).values())
                if both and both >= 0.8 * (sum(window.values()) + n - both) - 1e-9:
                    return True
        return False

    texts = {r.doc_id: r.text for r in now.collect()}
    now = support.stored(corpus_pipeline.decontaminate(spark, now, SF), "clean")
    assert {r.doc_id for r in now.collect()} == {i for i, t in texts.items() if not leaks(t)}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in corpus_pipeline.byte_bpe(spark, now, SF).collect():
        assert list(r.ids) == theirs.encode_ordinary(texts[r.doc_id]) and r.text == texts[r.doc_id]


def test_the_session_keeps_its_own_bounds_on_batches(spark):
    own = dict(zip(corpus_pipeline.BATCHES, ("3m", "777")))
    for name, bound in own.items():
        spark.conf.set(name, bound)
    try:
        assert corpus_pipeline.run(spark, SF).count() > 0
        assert {name: spark.conf.get(name) for name in own} == own
    finally:
        for name in own:
            spark.conf.unset(name)
