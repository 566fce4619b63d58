"""Queries on encoders, training, memory, walks and vectors, with the SQL of those that SQL can follow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tracewell.functions.taxonomy import STREAM_OPS
from tracewell.operators import embed, encoders, features, memory, neighbours, train
from tracewell.session import table

from . import model as m


def rule(rows: int, columns: int, k: int) -> np.ndarray:
    """Weights that any engine can write down."""
    i, j = np.mgrid[:rows, :columns]
    return ((i * 3 + j * 5 + k) % 7 - 3) / 4


def _dot(names: list[str], matrix: np.ndarray, bias: np.ndarray | None = None) -> list[str]:
    """SQL of a row vector times a matrix, an expression a column."""
    return [" + ".join([f"{n} * {float(w)}" for n, w in zip(names, c)] + ([str(float(bias[j]))] if bias is not None else [])) for j, c in enumerate(matrix.T)]


def _both_ways(s, d):
    """Events of four-hour graphs in both directions, with two attributes."""
    e = m.slotted(s, d).select("tw", "event_id", "src", "dst", F.array(F.col("loss") / 100, (F.col("op") == "purchase").cast("double")).alias("e"))
    return e.unionByName(e.select("tw", "event_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "e"))


def _node_vectors(e):
    n = e.select("tw", F.col("src").alias("node")).distinct()
    return n.select("tw", "node", F.array((F.col("node") < 1_000_000).cast("double"), (F.col("node") % 7) / 7, (F.col("node") % 5) / 5).alias("x"))


_BOTH = m.SL + """, bo AS (SELECT tw, src, dst, loss / 100 AS a0, CAST(op = 'purchase' AS INT)::DOUBLE AS a1 FROM sl UNION ALL SELECT tw, dst, src, loss / 100, CAST(op = 'purchase' AS INT)::DOUBLE FROM sl),
nv AS (SELECT DISTINCT tw, src AS node, CAST(src < 1000000 AS INT)::DOUBLE AS x0, (src % 7) / 7 AS x1, (src % 5) / 5 AS x2 FROM bo)"""
_X = ["x0", "x1", "x2"]

_ATTENTION = {"query": (rule(3, 4, 0), rule(1, 4, 1)[0]), "key": (rule(3, 4, 2), rule(1, 4, 3)[0]), "value": (rule(3, 4, 4), rule(1, 4, 5)[0]), "skip": (rule(3, 2, 6), rule(1, 2, 0)[0]), "edge": (rule(2, 4, 1), None)}


def attention_encoder(s, d):
    e = _both_ways(s, d)
    out = encoders.attention_layer(e, _node_vectors(e), ["tw"], _ATTENTION, heads=2, edge="e")
    return out.select("tw", "node", *[F.round(F.col("x")[i], 9).alias(f"x{i}") for i in range(2)])


def _attention_sql() -> str:
    columns = ", ".join(f"{x} AS {n}{j}" for n, (w, b) in (("q", _ATTENTION["query"]), ("k", _ATTENTION["key"]), ("v", _ATTENTION["value"]), ("s", _ATTENTION["skip"])) for j, x in enumerate(_dot(_X, w, b)))
    edge = ", ".join(f"{x} AS e{j}" for j, x in enumerate(_dot(["a0", "a1"], _ATTENTION["edge"][0])))
    logit = [f"(q.q{2 * h} * (k.k{2 * h} + e.e{2 * h}) + q.q{2 * h + 1} * (k.k{2 * h + 1} + e.e{2 * h + 1})) / sqrt(2) AS l{h}" for h in range(2)]
    message = [f"k.v{j} + e.e{j} AS m{j}" for j in range(4)]
    mean = [f"(sum(exp(l0) * m{j}) / sum(exp(l0)) + sum(exp(l1) * m{j + 2}) / sum(exp(l1))) / 2 AS h{j}" for j in range(2)]
    return f"""WITH {_BOTH}, p AS (SELECT tw, node, {columns} FROM nv), ed AS (SELECT tw, src, dst, {edge} FROM bo),
me AS (SELECT e.tw, e.dst, {", ".join(logit + message)} FROM ed e JOIN p k ON k.tw = e.tw AND k.node = e.src JOIN p q ON q.tw = e.tw AND q.node = e.dst),
su AS (SELECT tw, dst, {", ".join(mean)} FROM me GROUP BY tw, dst)
SELECT p.tw, p.node, round(coalesce(h0, 0) + s0, 9) AS x0, round(coalesce(h1, 0) + s1, 9) AS x1 FROM p LEFT JOIN su ON su.tw = p.tw AND su.dst = p.node"""


_GAT = {"linear": rule(3, 4, 2), "source": rule(2, 2, 0), "target": rule(2, 2, 3)}


def gat_encoder(s, d):
    """Rectified attention by a vector, two heads side by side, each node with an edge to itself."""
    e = _both_ways(s, d)
    out = encoders.gat_layer(e, _node_vectors(e), ["tw"], _GAT, heads=2, self_loops=True)
    return out.select("tw", "node", *[F.round(F.col("x")[i], 9).alias(f"x{i}") for i in range(4)])


def _gat_sql() -> str:
    v = _dot(_X, _GAT["linear"])
    ends = [f"v{2 * h} * {float(_GAT[k][h, 0])} + v{2 * h + 1} * {float(_GAT[k][h, 1])} AS {c}{h}" for k, c in (("source", "s"), ("target", "t")) for h in range(2)]
    logit = [f"CASE WHEN a.s{h} + b.t{h} > 0 THEN a.s{h} + b.t{h} ELSE 0.2 * (a.s{h} + b.t{h}) END AS l{h}" for h in range(2)]
    out = [f"round(sum(exp(l{j // 2}) * v{j}) / sum(exp(l{j // 2})), 9) AS x{j}" for j in range(4)]
    return f"""WITH {_BOTH}, p0 AS (SELECT tw, node, {", ".join(f"{x} AS v{j}" for j, x in enumerate(v))} FROM nv), p AS (SELECT *, {", ".join(ends)} FROM p0),
ed AS (SELECT tw, src, dst FROM bo WHERE src <> dst UNION ALL SELECT tw, node, node FROM nv),
me AS (SELECT e.tw, e.dst AS node, {", ".join(logit)}, {", ".join(f"a.v{j}" for j in range(4))} FROM ed e JOIN p a ON a.tw = e.tw AND a.node = e.src JOIN p b ON b.tw = e.tw AND b.node = e.dst)
SELECT tw, node, {", ".join(out)} FROM me GROUP BY tw, node"""


def gine_messages(s, d):
    """The sum of rectified source vectors plus edge attributes, and 1.5 times a node's own."""
    e = _both_ways(s, d)
    padded = e.withColumn("e3", F.concat("e", F.array(F.lit(-0.1))))
    out = encoders.aggregate(padded, _node_vectors(e), ["tw"], "sum", self_weight=0.5, edge="e3")
    return out.select("tw", "node", *[F.round(F.col("x")[i], 9).alias(f"x{i}") for i in range(3)])


def _gine_sql() -> str:
    parts = [f"sum(greatest(n.x{i} + {a}, 0)) AS s{i}" for i, a in enumerate(("a0", "a1", "-0.1"))]
    return f"""WITH {_BOTH}, su AS (SELECT b.tw, dst, {", ".join(parts)} FROM bo b JOIN nv n ON n.tw = b.tw AND n.node = b.src GROUP BY b.tw, dst)
SELECT nv.tw, nv.node, {", ".join(f"round(1.5 * x{i} + coalesce(s{i}, 0), 9) AS x{i}" for i in range(3))} FROM nv LEFT JOIN su ON su.tw = nv.tw AND su.dst = nv.node"""


def outlier_factors(s, d):
    """How sparse each vector lies, against its ten nearest."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return neighbours.outlier_factors(v, 10).select("id", F.round("lof", 6).alias("lof"))


_FACTORS = """WITH p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
nb AS (SELECT a.id, b.id AS nb, list_distance(a.v, b.v) AS d FROM p a JOIN p b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY d, b.id) <= 10),
kt AS (SELECT id, max(d) AS kth FROM nb GROUP BY id),
de AS (SELECT nb.id, 1 / greatest(avg(greatest(d, kth)), 1e-10) AS density FROM nb JOIN kt ON kt.id = nb.nb GROUP BY nb.id)
SELECT nb.id, round(avg(o.density) / any_value(w.density), 6) AS lof FROM nb JOIN de o ON o.id = nb.nb JOIN de w ON w.id = nb.id GROUP BY nb.id"""


_OPS = STREAM_OPS
_START = [(rule(3, 5, 1), rule(1, 5, 2)[0])]
_EPOCHS, _RATE = 3, 0.05


def _typed_events(s, d):
    x = F.array(F.hour(F.timestamp_micros(F.floor(F.col("t") / 1000))) / 24, (F.col("src") % 7) / 7, (F.col("dst") % 5) / 5)
    return m.events(s, d).select("event_id", "day", x.alias("x"), (F.array_position(F.array(*map(F.lit, _OPS)), F.col("op")) - 1).cast("int").alias("target")).filter("target >= 0")


def trained_edge_types(s, d):
    """A linear scorer of operations, trained by Adam on the training days; losses of the test days' events."""
    e = _typed_events(s, d)
    model = train.train(e.filter("day <= '2024-01-15'"), "linear(5)", "classes", _EPOCHS, _RATE, start=_START)
    return train.with_losses(e.filter("day > '2024-01-20'"), model).select("event_id", F.round("loss", 6).alias("loss"), "predicted", "correct")


def _trained_sql() -> str:
    """Adam unrolled: one row of weights and moments an epoch, gradients from counts of equal training rows."""
    names = [f"w{i}{j}" for i in range(3) for j in range(5)] + [f"b{j}" for j in range(5)]
    first = [float(_START[0][0][i, j]) for i in range(3) for j in range(5)] + [float(b) for b in _START[0][1]]
    score = [f"x0 * w0{j} + x1 * w1{j} + x2 * w2{j} + b{j}" for j in range(5)]
    soft = lambda source, weights, keep: f"(SELECT {keep}, {', '.join(f'exp(z{j} - top) / (' + ' + '.join(f'exp(z{k} - top)' for k in range(5)) + f') AS p{j}' for j in range(5))} FROM (SELECT *, greatest({', '.join(f'z{j}' for j in range(5))}) AS top FROM (SELECT {source}.*, {', '.join(f'{x} AS z{j}' for j, x in enumerate(score))} FROM {source}, {weights})))"
    parts = [f"""ty AS (SELECT event_id, day, hour(make_timestamp(t // 1000)) / 24 AS x0, (src % 7) / 7 AS x1, (dst % 5) / 5 AS x2, list_position({list(_OPS)}, op) - 1 AS y FROM ev WHERE op IN {_OPS}),
tr AS (SELECT x0, x1, x2, y, count(*) AS c FROM ty WHERE day <= '2024-01-15' GROUP BY ALL), te AS (SELECT * FROM ty WHERE day > '2024-01-20'),
a0 AS (SELECT {", ".join(f"{v}::DOUBLE AS {n}, 0.0::DOUBLE AS m_{n}, 0.0::DOUBLE AS v_{n}" for n, v in zip(names, first))})"""]
    slope = {f"w{i}{j}": f"sum(c * (p{j} - CAST(y = {j} AS INT)) * x{i}) / sum(c)" for i in range(3) for j in range(5)} | {f"b{j}": f"sum(c * (p{j} - CAST(y = {j} AS INT))) / sum(c)" for j in range(5)}
    for t in range(1, _EPOCHS + 1):
        parts.append(f"g{t} AS (SELECT {', '.join(f'{slope[n]} AS g_{n}' for n in names)} FROM {soft('tr', f'a{t - 1}', 'x0, x1, x2, y, c')})")
        moments = [f"0.9 * m_{n} + 0.1 * g_{n} AS m_{n}, 0.999 * v_{n} + 0.001 * g_{n} * g_{n} AS v_{n}" for n in names]
        parts.append(f"o{t} AS (SELECT {', '.join(names)}, {', '.join(moments)} FROM a{t - 1}, g{t})")
        parts.append(f"a{t} AS (SELECT {', '.join(f'{n} - {_RATE} * (m_{n} / {1 - 0.9**t}) / (sqrt(v_{n} / {1 - 0.999**t}) + 1e-8) AS {n}, m_{n}, v_{n}' for n in names)} FROM o{t})")
    best = "CASE " + " ".join(f"WHEN p{j} = greatest(p0, p1, p2, p3, p4) THEN {j}" for j in range(5)) + " END"
    own = "CASE y " + " ".join(f"WHEN {j} THEN p{j}" for j in range(5)) + " END"
    return f"WITH {m.EV}, {', '.join(parts)} SELECT event_id, round(-ln({own}), 6) AS loss, {best} AS predicted, {best} = y AS correct FROM {soft('te', f'a{_EPOCHS}', 'event_id, y')}"


def reconstruction_losses(s, d):
    """Every vector through a narrow network that was trained to give it back."""
    v = table(s, d, "embeddings").filter("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.col("embedding").alias("target"))
    model = train.train(v, "linear(16) | tanh | linear(64)", "mse", epochs=3, rate=0.01, steps=2, key="id", seed=1)
    return train.with_losses(v, model).select("id", F.round("loss", 6).alias("loss"))


def node_memory(s, d):
    """Memories of four numbers, a batch a day, from the last message of each node."""
    e = m.events(s, d).withColumn("batch", F.datediff(F.col("day").cast("date"), F.lit("2024-01-01").cast("date"))).withColumn("msg", F.array(F.col("loss") / 100))
    weights = {"w": rule(12, 11, 1) / 4, "u": rule(12, 4, 2) / 4, "b": rule(1, 12, 3)[0] / 4, "c": rule(1, 12, 4)[0] / 4, "rate": np.array([1.0, 0.1]), "phase": np.zeros(2)}
    out = memory.node_memory(e, weights, "last", unit=3_600_000_000_000)
    return out.select("batch", "node", *[F.round(F.col("memory")[i], 6).alias(f"m{i}") for i in range(4)])


_HALF = 3 * 24 * 3_600_000_000_000


def decayed_walks(s, d):
    """Two walks of four nodes from every node, later edges drawn with a half-life of three days."""
    e = m.meshed(s, d)
    starts = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct()
    return features.decayed_walks(e, starts, 4, 2, float(_HALF)).select("node", "walk", F.array_join("path", ">").alias("path"))


def _decayed_sql() -> str:
    steps = []
    for k in range(1, 4):
        u = f"(CAST('0x' || md5('0|' || node || '|' || walk || '|{k}')[1:8] AS BIGINT) + 0.5) / 4294967296"
        steps.append(f"""c{k} AS (SELECT node, walk, path, no, b, tb.t AS nt, level, min(level) OVER (PARTITION BY node, walk) AS l0 FROM w{k - 1} JOIN tb ON tb.a = cur AND tb.t > since),
w{k} AS (SELECT node, walk, path || '>' || arg_max(b, no) AS path, arg_max(b, no) AS cur, arg_max(nt, no) AS since FROM c{k} WHERE level <= l0 - ln({u}) GROUP BY node, walk, path
  UNION ALL SELECT node, walk, path, NULL, NULL FROM w{k - 1} WHERE NOT EXISTS (SELECT 1 FROM c{k} WHERE c{k}.node = w{k - 1}.node AND c{k}.walk = w{k - 1}.walk))""")
    return f"""WITH {m.ME}, t0 AS (SELECT *, min(t) OVER (PARTITION BY src) AS first FROM me),
tb AS (SELECT src AS a, dst AS b, t, row_number() OVER (PARTITION BY src ORDER BY t, event_id) AS no, -ln(sum(exp(-(t - first) / {float(_HALF)})) OVER (PARTITION BY src ORDER BY t DESC, event_id DESC ROWS UNBOUNDED PRECEDING)) AS level FROM t0),
w0 AS (SELECT node, CAST(walk AS INT) AS walk, CAST(node AS VARCHAR) AS path, node AS cur, -1 AS since FROM (SELECT src AS node FROM me UNION SELECT dst FROM me), (SELECT unnest([0, 1]) AS walk)),
{", ".join(steps)} SELECT node, walk, path FROM w3"""


def _names(s, d):
    return table(s, d, "part").filter("p_name is not null").select(F.col("p_partkey").alias("node"), F.split("p_name", " ").alias("tokens"))


def _known_words(tokens):
    """Vectors of the words whose first letter is in the first half of the alphabet."""
    n = F.length("word")
    return tokens.select(F.explode("tokens").alias("word")).distinct().filter("word < 'n'").select("word", F.array(n.cast("double"), (n % 3 + 1).cast("double")).alias("vec"))


def induction_sums(s, d):
    """The sums that take contexts to vectors, over the words that have one."""
    tokens = _names(s, d)
    known = _known_words(tokens)
    a, b = embed.induction_sums(embed.context_means(tokens, known, 2), known)
    return s.createDataFrame([(i, j, float(round(a[i, j], 4)), float(round(b[i, j], 4))) for i in range(2) for j in range(2)], "i int, j int, context double, target double")


_INDUCTION = """WITH w AS (SELECT p_partkey AS node, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part WHERE p_name IS NOT NULL),
o AS (SELECT a.word, a.node, a.i, sum(length(b.word)) AS c0, sum(length(b.word) % 3 + 1) AS c1 FROM w a JOIN w b ON a.node = b.node AND abs(a.i - b.i) IN (1, 2) WHERE b.word < 'n' GROUP BY ALL),
m AS (SELECT word, [avg(c0), avg(c1)] AS c, [length(word), length(word) % 3 + 1] AS v FROM o WHERE word < 'n' GROUP BY word)
SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(sum(c[i + 1] * c[j + 1]), 4) AS context, round(sum(c[i + 1] * v[j + 1]), 4) AS target FROM m, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j) GROUP BY ALL"""


def unseen_word_vectors(s, d):
    """Vectors that contexts induce for the words without one."""
    tokens = _names(s, d)
    out = embed.unseen_vectors(tokens, tokens, _known_words(tokens), 2)
    return out.select("word", *[F.round(F.col("vec")[i], 4).alias(f"x{i}") for i in range(2)])


def subword_vectors(s, d):
    """Every part's label by vectors of words and character n-grams."""
    tokens = _names(s, d)
    model = embed.train_subwords(tokens, size=8, buckets=4096, window=2, epochs=2, seed=1)
    return embed.mean_unit_vectors(tokens, model).select("node", F.size("vec").alias("n"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x), 1).alias("length"))


def inferred_documents(s, d):
    """Documents of one half of the parts, by words that were trained on the other half."""
    tokens = _names(s, d)
    model, trained = embed.train_documents(tokens.filter("node % 2 = 0"), size=8, buckets=1024, window=2, epochs=2, seed=1)
    held = embed.infer_documents(tokens.filter("node % 2 = 1"), model, window=2, epochs=2, seed=1)
    return trained.unionByName(held).select("node", F.size("vec").alias("n"))


ORACLES = {
    "decayed_walks": _decayed_sql(),
    "induction_sums": _INDUCTION,
    "trained_edge_types": _trained_sql(),
    "attention_encoder": _attention_sql(),
    "gat_encoder": _gat_sql(),
    "gine_messages": _gine_sql(),
    "outlier_factors": _FACTORS,
}
QUERIES = {name: globals()[name] for name in (*ORACLES, "reconstruction_losses", "node_memory", "unseen_word_vectors", "subword_vectors", "inferred_documents")}
