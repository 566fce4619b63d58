from pathlib import Path
import sys

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import both  # noqa: E402

from tracewell.llm import queries  # noqa: E402
from tracewell.llm.quality import Limits, quality_cascade, rule_order, rules  # noqa: E402


def test_equals_sql(spark):
    ours, theirs = both(spark, queries.QUERIES["op8_quality_cascade"], queries.ORACLES["op8_quality_cascade"], "/root/testdata/sf0.001")
    assert ours == theirs


def test_repeats(frame):
    docs = frame([(1, "a b c x a b c y"), (2, "a a a a a"), (3, "l\nl\n\nl\nm")])
    got = {r.doc_id: r for r in quality_cascade(docs).collect()}
    assert (got[1].n_repeat_words, got[2].n_repeat_words, got[3].n_dup_lines) == (6, 5, 2)


def test_order_holds_every_rule(edge, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    order = rule_order(docs, Limits())
    assert sorted(order) == sorted(rules(Limits())) and order[0] in ("symbols", "letters")


def test_edge_cases(edge, empty):
    out = quality_cascade(edge).collect()
    assert len(out) == edge.count()
    assert all(r.base_failed and not r.kept for r in out if r.n_words < 50)
    assert quality_cascade(empty).count() == 0


def test_no_python_in_the_plan(edge):
    plan = quality_cascade(edge)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
