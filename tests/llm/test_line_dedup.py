from pathlib import Path
import sys

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import both  # noqa: E402

from tracewell.llm import queries  # noqa: E402
from tracewell.llm.line_dedup import line_dedup, line_hashes, windows  # noqa: E402

PASSAGE = " ".join(f"word{i}" for i in range(60))


def test_equals_sql(spark):
    ours, theirs = both(spark, queries.QUERIES["op1_line_dedup"], queries.ORACLES["op1_line_dedup"], "/root/testdata/sf0.001")
    assert ours == theirs


def test_first_passage_stays(frame):
    docs = frame([(1, f"a\n{PASSAGE}\nb"), (2, f"c\n{PASSAGE}"), (3, f"{PASSAGE}\n\n{PASSAGE}"), (4, "short\nshort")])
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup(docs).collect()}
    assert got == {1: (f"a\n{PASSAGE}\nb", 0), 2: ("c", 1), 3: ("", 2), 4: ("short\nshort", 0)}


def test_matches_extend_both_ways(frame):
    run = "\n".join(f"line number {i} of a long run" for i in range(20))
    docs = frame([(1, f"x\n{run}\ny"), (2, f"p\n{run}\nq")])
    assert {r.doc_id: r.text for r in line_dedup(docs).collect()}[2] == "p\nq"


def test_every_repeated_run_holds_a_fingerprint():
    run = "\n".join(f"line {i} has several words" for i in range(30))
    found = []
    for x, y in (("one two", "three"), ("four", "five six")):
        hashes, words = line_hashes(f"{x}\n{run}\n{y}".encode())
        found.append({tuple(hashes[s:e]): hashes[unit] for unit, s, e in windows(hashes, words, 50)})
    inside = set(found[0]) & set(found[1])
    assert len(inside) > 10 and all(found[0][w] == found[1][w] for w in inside)


def test_only_minima_are_kept():
    hashes, words = line_hashes("\n".join(f"line {i} has several words" for i in range(400)).encode())
    assert len({w[0] for w in windows(hashes, words, 50)}) < 100


def test_repeated_passage_without_an_id(frame):
    docs = frame([(None, f"a\n{PASSAGE}"), (2, f"b\n{PASSAGE}"), (None, f"c\n{PASSAGE}"), (None, f"a\n{PASSAGE}")])
    got = sorted(((r.doc_id, r.text) for r in line_dedup(docs).collect()), key=str)
    assert sum(PASSAGE in t for _, t in got) in (1, 2) and len(got) == 4  # rows without an id come first; equal rows are one document
    assert (2, "b") in got


def test_edge_cases(edge, empty):
    out = line_dedup(edge)
    assert out.columns == edge.columns + ["n_lines", "n_removed"]
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == edge.count() and (0, None) in got and (1, "") in got and (2, " \n\t ") in got
    fives = [t for i, t in got if i == 5]
    assert fives[0] == fives[1]  # rows that repeat in full are one document
    assert line_dedup(empty).count() == 0
