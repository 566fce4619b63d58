import random
import re
import sys
from collections import Counter
from itertools import permutations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import both  # noqa: E402

from tracewell.llm import filter_audit as fa  # noqa: E402
from tracewell.llm import queries  # noqa: E402

LABELS = "doc_id long, quality int, toxic int, part string, n long"


def brute(docs, labels):
    good = {d for d, q, *_ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t, *_ in labels if t == 1 and d is not None}
    rows = []
    for r in docs:
        text, part = r[1] or "", r[3] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {f for f, bad in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), r[0] is not None and any(o[0] is not None and o[0] < r[0] and (o[1] or "") == text for o in docs))) if bad}
        rows.append((part, fails, r[0] in good, r[0] in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, total, part_rows = [r for r in rows if r[0] == part], Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                part_rows.append([part, order, step, len(left) - len(gone), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)])
                total[f] += len(gone)
                left = [r for r in left if f not in r[1]]
        out += [(*r, total[r[1][r[2] - 1]]) for r in part_rows]
    return sorted(out)


def run(docs, labels):
    return sorted(map(tuple, fa.audit(docs, labels).collect()))


def test_equals_sql(spark):
    ours, theirs = both(spark, queries.QUERIES["op12_filter_audit"], queries.ORACLES["op12_filter_audit"], "/root/testdata/sf0.001")
    assert ours == theirs and ours


def test_equals_brute_force(spark, edge, frame):
    labels = [(0, 1, 1, "x", 1), (1, None, 1, "x", 1), (5, 1, 0, "x", 1), (5, 0, None, "x", 1), (None, 1, 1, "x", 1), (99, 1, 1, "x", 1), (4, 1, 1, "x", 1)]
    table = list(map(tuple, edge.collect()))
    assert run(edge, spark.createDataFrame(labels, LABELS)) == brute(table, labels)
    r = random.Random(1)
    docs = []
    for i in range(300):
        text = " ".join(r.choice(["a", "B", "cc", "ÄÖ", "DDDD", "e|f", "g"] + [f"w{k}" for k in range(r.choice([3, 200]))]) for _ in range(r.choice([0, 40, 80])))
        docs.append((r.choice([i, i, None, i // 2]), text if i % 3 else "one text of a third of the rows", "de", r.choice(["s", "t", None, ""]), 1, *"abcdefg"))
    labels = [(r.randrange(300), r.choice([0, 1, None]), r.choice([0, 1, None]), "x", 1) for _ in range(200)]
    assert run(spark.createDataFrame(docs, edge.schema), spark.createDataFrame(labels, LABELS)) == brute(docs, labels)


def test_empty_tables(spark, edge, empty):
    labels = spark.createDataFrame([], LABELS)
    assert run(empty, labels) == []
    assert run(edge, labels) == brute(list(map(tuple, edge.collect())), [])


def expected(texts):
    return [[len(w := re.findall(r"[^\x20\x09-\x0D]+", t)), len(set(w)), len(re.findall("[A-Z]", t)), len(re.findall(r"[#$%&*|]", t)), len(t)] for t in texts]


def texts(seed=2):
    r = random.Random(seed)
    out = ["", " ", "x", "\x85a b a", "aa a aa", "A\x1cB \x0b\x0c", "word " * 70, "ends", "ends", "\U0001f600 é" * 9]
    return out + ["".join(r.choice("aab BZ#|é\t\n　") for _ in range(r.randrange(400))) for _ in range(60)] + ["q" * 300 + " " + "q" * 300 + " " + "q" * 299 + "r"]


@pytest.mark.parametrize("size", [1, 64, 1 << 20])
def test_counts(monkeypatch, size):
    """Slices of one text, of some, of all; a text longer than a slice goes piece by piece."""
    monkeypatch.setattr(fa, "SLICE", size)
    column = pa.array(["left out", *texts()]).slice(1)
    assert fa.text_counts(column, fa.Scanner())[0].tolist() == expected(texts())


def test_false_matches_of_hashes_are_counted_exactly():
    class Weak(fa.Scanner):
        def hashes(self, data, starts, ends):
            return (ends - starts).astype(np.uint64) % np.uint64(3)

    assert fa.text_counts(pa.array(texts()), Weak())[0].tolist() == expected(texts())
