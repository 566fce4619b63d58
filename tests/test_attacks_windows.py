"""Made-up attacks in every graph, 2-means inside windows, documents of hubs, losses under dropout."""

import random

import numpy as np
import pytest

from tracewell.operators import detect, features, train, transform


def kind(n):
    return "subject" if n < 100 else "file" if n < 200 else "netflow"


def test_attacks_in_every_graph_of_an_actor(spark):
    r = random.Random(3)
    rows = [(tw, r.randrange(6), r.choice([*range(100, 112), *range(200, 204)]), "x", tw * 10**12 + r.randrange(10**11), tw * 100 + k) for tw in range(4) for k in range(40)]
    rows += [(9, 0, 1, "x", 9 * 10**12, 999), (9, 5, 1, "x", 9 * 10**12 + 50, 1000)]  # a graph without files
    edges = spark.createDataFrame(rows, "tw long, src long, dst long, op string, t long, event_id long")
    nodes = spark.createDataFrame([(n, kind(n)) for n in {x for row in rows for x in row[1:3]}], "node long, node_type string")
    actors = spark.createDataFrame([(0,), (3,), (3,), (77,)], "actor long")
    got = transform.window_attacks(edges, ["tw"], nodes, actors, 2).collect()
    assert got and {g.src for g in got} <= {0, 3} and all(g.y == 1 for g in got)
    touched = {(s, d) for _, s, d, *_ in rows}
    for tw in (0, 1, 2, 3, 9):
        times = [row[4] for row in rows if row[0] == tw]
        gap = (max(times) - min(times)) / (len(times) - 1)
        here = {x for row in rows if row[0] == tw for x in row[1:3]}
        for actor in (0, 3):
            own = sorted((g for g in got if (g.tw, g.src) == (tw, actor)), key=lambda g: (g.t, g.op != "EVENT_WRITE"))
            free = [f for f in here if kind(f) == "file" and (actor, f) not in touched]
            if actor not in here or not free:
                assert own == []
                continue
            n = min(2, len(free))
            files = [g.dst for g in own if g.op == "EVENT_OPEN"]
            assert len(set(files)) == n and set(files) <= set(free)
            assert [g.op for g in own] == ["EVENT_OPEN", "EVENT_READ", "EVENT_WRITE"] * n + ["EVENT_CONNECT"] and kind(own[-1].dst) == "netflow" and own[-1].dst in here
            assert min(times) <= own[0].t <= max(times)
            steps = [round((g.t - own[0].t) / int(gap), 3) for g in own]
            assert steps == [x + 2 * k for k in range(n) for x in (0, 1, 2)] + [2 * n + 1]
    again = transform.window_attacks(edges.repartition(7), ["tw"], nodes, actors, 2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def best_cut(scores):
    """The split of ascending scores with the least sum of squares inside the two parts; the first of equals."""
    inside = lambda x: sum((v - sum(x) / len(x)) ** 2 for v in x)
    return min(range(1, len(scores)), key=lambda i: (round(inside(scores[:i]) + inside(scores[i:]), 9), i))


def test_two_means_inside_windows(spark):
    r = random.Random(1)
    rows = [(tw, tw * 100 + i, float(r.choice([1, 2, 3, 20, 22]) + r.random()) if tw % 3 else 1.0 + i / 10) for tw in range(9) for i in range(r.randrange(1, 15))]
    got = {(x.tw, x.node): x.y_hat for x in detect.relabel_windows_by_two_means(spark.createDataFrame(rows, "tw long, node long, score double"), spark.createDataFrame([(15.0,)], "t double"), 6).collect()}
    assert len(got) == len(rows)
    for tw in range(9):
        own = sorted((x for x in rows if x[0] == tw), key=lambda x: (-x[2], x[1]))[:6][::-1]
        up = set()
        if any(x[2] > 15 for x in own) and len(own) > 1:
            up = {x[1] for x in own[best_cut([x[2] for x in own]) :]}
        assert {n for (w, n), y in got.items() if w == tw and y} == up


def test_documents_of_hubs_come_in_parts(spark):
    edges = spark.createDataFrame([(g, 0, i) for g, n in ((2, 9), (1, 7)) for i in range(1, n)] + [(2, 8, 0), (3, 8, 1)], "g long, src long, dst long")
    tokens = spark.createDataFrame([(i, [f"t{i}", "x"]) for i in range(9)], "node long, tokens array<string>")
    got = {(r.node, r.part): r.tokens for r in features.neighbour_corpus(edges, tokens, "g", 4).collect()}
    near = lambda *ids: [w for i in ids for w in (f"t{i}", "x")]
    assert got[0, 0] == near(0, 1, 2, 3, 4) and got[0, 1] == near(5, 6) and got[8, 0] == near(8, 0) and got[1, 0] == near(1)
    assert len(got) == 10


def test_losses_under_dropout(spark):
    r = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, r.normal(size=4).tolist(), i % 2) for i in range(40)] + [(None, [1.0] * 4, 1), (50, None, 1)], "id long, x array<double>, target int")
    model = train.train(rows, "linear(16) | relu | dropout(0.3) | linear(2)", "classes", 3, 0.05)
    runs = {x.id: (x.loss_mean, x.loss_deviation) for x in train.uncertain_losses(rows, model, 30, "id").collect()}
    again = {x.id: (x.loss_mean, x.loss_deviation) for x in train.uncertain_losses(rows.repartition(5), model, 30, "id").collect()}
    assert set(runs) == set(again) and runs[50] == runs[None] == again[50] == (None, None)
    assert all(runs[i] == pytest.approx(again[i]) for i in range(40))
    plain = {x.id: x.loss for x in train.with_losses(rows, model).collect()}
    known = [i for i in runs if runs[i][0] is not None]
    assert len(known) == 40 and all(runs[i][1] > 0 for i in known)
    assert np.mean([runs[i][0] for i in known]) == pytest.approx(np.mean([plain[i] for i in known]), rel=0.3)
    still = train.Model("linear(16) | relu | dropout(0) | linear(2)", "classes", model.weights)
    for x in train.uncertain_losses(rows.filter("id < 40"), still, 3, "id").collect():
        assert x.loss_mean == pytest.approx(plain[x.id]) and x.loss_deviation == pytest.approx(0, abs=1e-9)


def test_window_attacks_go_on_only_where_places_do_not_suffice(spark, monkeypatch):
    """Actor 1 touches 37 of a graph's 40 files elsewhere, actor 2 none: only the first is asked for again."""
    asked, keep = [], transform.stored

    def noted(df, name):
        out = keep(df, name)
        if name == "tries":
            asked.append({r.actor for r in out.collect()})
        return out

    rows = [(0, 3, f) for f in range(100, 140)] + [(0, a, 100) for a in (1, 2)] + [(1, 1, f) for f in range(100, 137)]
    edges = spark.createDataFrame([(i, tw, i * 10**9, s, d) for i, (tw, s, d) in enumerate(rows)], "event_id long, tw long, t long, src long, dst long")
    nodes = spark.createDataFrame([(n, "subject" if n < 100 else "file") for n in (1, 2, 3, *range(100, 140))], "node long, node_type string")
    actors = spark.createDataFrame([(1,), (2,)], "actor long")
    monkeypatch.setattr(transform, "stored", noted)
    got = transform.window_attacks(edges, ["tw"], nodes, actors, 2).filter("op = 'EVENT_OPEN'").collect()
    opened = {(r.tw, r.src): set() for r in got}
    for r in got:
        opened[r.tw, r.src].add(r.dst)
    assert set(opened) == {(0, 1), (0, 2)} and len(opened[0, 1]) == len(opened[0, 2]) == 2
    assert opened[0, 1] <= {137, 138, 139} and 100 not in opened[0, 2]
    assert asked[0] == {1, 2} and asked[-1] == set() and any(x == {1} for x in asked)
