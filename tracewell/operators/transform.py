"""Graph transformations on edge tables; `by` names the columns of a graph's key."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.ordinal import HOUR, with_ordinal, with_running
from tracewell.functions.tables import stored


def undirected(edges: DataFrame, by: list[str]) -> DataFrame:
    """Adds the reverse of every edge whose reverse pair is not in the graph."""
    pairs = edges.select(*by, F.col("src").alias("dst"), F.col("dst").alias("src")).distinct()
    back = edges.join(pairs, [*by, "src", "dst"], "left_anti")
    swapped = back.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionByName(swapped)


def strong_components(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, component) for nodes that may lie on a cycle; a component's name is one of its nodes.

    Edges at nodes without a way in or a way out drop out first, round by round. Of the rest each
    node takes the greatest node that reaches it as its colour; the nodes of a colour that
    reach the one it is named by are a component. What is left goes through the same again.
    All state is in tables of the size of the graph; no pairs of nodes are listed.
    """
    e = stored(edges.filter("src != dst").select(*by, "src", "dst").distinct(), "scc-edges")
    out = None
    while True:
        n = e.count()
        while n:
            into, from_ = e.select(*by, F.col("dst").alias("src")).distinct(), e.select(*by, F.col("src").alias("dst")).distinct()
            e = stored(e.join(into, [*by, "src"], "left_semi").join(from_, [*by, "dst"], "left_semi"), "scc-edges")
            n, had = e.count(), n
            if n == had:
                break
        if not n:
            break
        colour = stored(e.select(*by, F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")), "scc-colours")
        while True:
            sent = e.join(colour.withColumnRenamed("node", "src"), [*by, "src"]).groupBy(*by, F.col("dst").alias("node")).agg(F.max("colour").alias("_in"))
            moved = stored(colour.join(sent, [*by, "node"], "left").select(*by, "node", F.col("colour").alias("_old"), F.greatest("colour", "_in").alias("colour")), "scc-colours")
            colour = moved.drop("_old")
            if not moved.filter("colour != _old").head(1):
                break
        inside = e.join(colour.select(*by, F.col("node").alias("src"), F.col("colour")), [*by, "src"]).join(colour.select(*by, F.col("node").alias("dst"), "colour"), [*by, "dst", "colour"]).select(*by, F.col("dst").alias("node"), F.col("src").alias("next"))
        found = front = stored(colour.filter("node = colour"), "scc-found")
        while front.head(1):
            more = front.join(inside, [*by, "node"]).select(*by, F.col("next").alias("node"), "colour").distinct()
            front = stored(more.join(found.select(*by, "node"), [*by, "node"], "left_anti"), "scc-found")
            found = found.unionByName(front)
        part = found.withColumnRenamed("colour", "component")
        out = part if out is None else out.unionByName(part)
        done = found.select(*by, "node")
        e = stored(e.join(done.withColumnRenamed("node", "src"), [*by, "src"], "left_anti").join(done.withColumnRenamed("node", "dst"), [*by, "dst"], "left_anti"), "scc-edges")
    if out is None:
        return e.select(*by, F.col("src").alias("node"), F.col("dst").alias("component"))
    return out


def acyclic(edges: DataFrame, by: list[str]) -> DataFrame:
    """Collapses pairs, drops self loops, and removes all edges within strongly connected components.

    Every edge of a cycle goes, which is what removing found cycles until none is
    left comes to when every cycle counts.
    """
    e = edges.filter("src != dst").select(*by, "src", "dst").distinct()
    c = strong_components(edges, by)
    inner = e.join(c.select(*by, F.col("node").alias("src"), "component"), [*by, "src"]).join(c.select(*by, F.col("node").alias("dst"), "component"), [*by, "dst", "component"])
    return e.join(inner.select(*by, "src", "dst"), [*by, "src", "dst"], "left_anti")


def roots(edges: DataFrame, by: list[str]) -> DataFrame:
    """Nodes with an outgoing edge and no incoming edge before (or at) their first outgoing one."""
    out = edges.groupBy(*by, F.col("src").alias("node")).agg(F.min("t").alias("first_out"))
    into = edges.groupBy(*by, F.col("dst").alias("node")).agg(F.min("t").alias("first_in"))
    return out.join(into, [*by, "node"], "left").filter("first_in is null or first_out < first_in").select(*by, "node")


MOST_WAYS = 4  # ways are doubled for all nodes while they are at most so many a pair of the graph


def doubled(edges: DataFrame, by: list[str], paths: bool = False) -> tuple[DataFrame, int, bool]:
    """(by, src, dst, hops) of all ways of up to m edges, m, and whether no pair is further apart.

    hops is the least number of edges, path (if asked for) the nodes of the least such way by ids. A round joins the
    pairs that lie m apart with all pairs, which doubles m, so a graph of short ways takes few rounds. Ways are counted
    before they are joined: rounds end where the pairs would outgrow the graph by MOST_WAYS.
    """
    e = edges.select(*by, "src", "dst").distinct().withColumn("hops", F.lit(1))
    found = stored(e.withColumn("path", F.array("src", "dst")) if paths else e, "ways")
    m, n = 1, found.count()
    most, held = MOST_WAYS * n, n
    while True:
        ends = found.filter(F.col("hops") == m).groupBy(*by, F.col("dst").alias("node")).agg(F.count("*").alias("_a"))
        starts = found.groupBy(*by, F.col("src").alias("node")).agg(F.count("*").alias("_b"))
        ways = ends.join(starts, [*by, "node"]).agg(F.sum(F.col("_a").cast("double") * F.col("_b"))).first()[0] or 0
        if not ways or held + ways > most:
            return found, m, not ways
        new = stored(longer(found.filter(F.col("hops") == m), found, found, by, paths), "ways")
        found, m, held = found.unionByName(new), 2 * m, held + new.count()


def longer(front: DataFrame, step: DataFrame, found: DataFrame, by: list[str], paths: bool) -> DataFrame:
    """Ways of front followed by one of step, the least for each pair that is not found yet."""
    tail = step.select(*by, F.col("src").alias("dst"), F.col("dst").alias("_next"), F.col("hops").alias("_more"), *([F.col("path").alias("_rest")] if paths else []))
    met = front.join(tail, [*by, "dst"])
    hops = F.col("hops") + F.col("_more")
    if not paths:
        least = met.groupBy(*by, "src", F.col("_next").alias("dst")).agg(F.min(hops).alias("hops"))
        return least.join(found, [*by, "src", "dst"], "left_anti")
    way = F.struct(hops.alias("hops"), F.concat("path", F.slice("_rest", F.lit(2), F.size("_rest"))).alias("path"))
    least = met.filter("src != _next").groupBy(*by, "src", F.col("_next").alias("dst")).agg(F.min(way).alias("_w"))
    return least.join(found, [*by, "src", "dst"], "left_anti").select(*by, "src", "dst", "_w.hops", "_w.path")


def ways_from(sources: DataFrame, step: DataFrame, m: int, whole: bool, by: list[str], paths: bool = False) -> DataFrame:
    """The pairs of `doubled` that begin at sources(by, node), and those further apart: the frontier moves m hops a round."""
    found = stored(step.join(sources.select(*by, F.col("node").alias("src")).distinct(), [*by, "src"], "left_semi").select(step.columns), "reach")
    front, far = found, m
    while not whole:
        front = stored(longer(front.filter(F.col("hops") == far), step, found, by, paths).select(step.columns), "reach")
        if not front.head(1):
            break
        found, far = found.unionByName(front), far + m
    return found


def closure(edges: DataFrame, by: list[str], sources: DataFrame | None = None) -> DataFrame:
    """(by, src, dst) for every dst that src reaches by one or more edges; each round's state is a stored table."""
    step, m, whole = doubled(edges, by)
    if sources is None:
        if whole:
            return step.drop("hops")
        sources = step.select(*by, F.col("src").alias("node"))
    return ways_from(sources, step, m, whole, by).drop("hops")


def pseudo_edges(edges: DataFrame, by: list[str]) -> DataFrame:
    """An edge from each root to every node it reaches."""
    return closure(edges, by, roots(edges, by)).filter("src != dst")


def prune_roots(pseudo: DataFrame, edges: DataFrame, by: list[str], share: float = 0.5) -> DataFrame:
    """Drops pseudo edges of roots that point to more than a share of the graph's nodes."""
    ends = edges.select(*by, F.col("src").alias("node")).unionByName(edges.select(*by, F.col("dst").alias("node"))).distinct()
    size = ends.groupBy(*by).agg(F.count("*").alias("n_nodes"))
    wide = pseudo.groupBy(*by, "src").agg(F.count("*").alias("n_out")).join(size, by).filter(F.col("n_out") > F.col("n_nodes") * share)
    return pseudo.join(wide.select(*by, "src"), [*by, "src"], "left_anti")


def merged_pseudo(edges: DataFrame, pseudo: DataFrame, by: list[str]) -> DataFrame:
    """(by, src, dst): distinct pairs of the graph and of its pseudo edges, whose roots are the nodes they stand for."""
    return edges.select(*by, "src", "dst").unionByName(pseudo.select(*by, "src", "dst")).distinct()


def digest(*parts: str | Column, hex_digits: int = 8) -> Column:
    """A number from the md5 of parts, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, hex_digits), 16, 10).cast("long")


def random_times(edges: DataFrame, by: list[str], span: DataFrame, seed: int = 0) -> DataFrame:
    """Times in [low, high) of each graph, drawn by a hash of the edge, so that retries agree."""
    draw = F.pmod(digest(F.lit(seed), *by, "src", "dst"), F.col("high") - F.col("low"))
    return edges.join(span, by).withColumn("t", F.col("low") + draw).drop("low", "high")


def versioned(edges: DataFrame, by: list[str], self_loops: bool = False) -> DataFrame:
    """Edges between node versions: an edge into a node met before makes its next version.

    A node's version is the number of its incoming edges so far, less one if it
    was first met as a destination. Adds src_version, dst_version and, where a
    version follows another, bumped.
    """
    e = edges if self_loops else edges.filter("src != dst")
    seen = e.select(*by, "t", "event_id", F.col("src").alias("node"), F.lit(0).cast("long").alias("role")).unionByName(e.select(*by, "t", "event_id", F.col("dst").alias("node"), F.lit(1).cast("long").alias("role")))
    first = seen.groupBy(*by, "node").agg(F.min_by("role", F.struct("t", "event_id", "role")).alias("_first"))
    run = with_running(seen, [*by, "node"], ["t", "event_id", "role"], HOUR, {"_in": ("sum", "role"), "_met": ("sum", F.lit(1).cast("long"))})
    counted = run.join(first, [*by, "node"]).withColumn("version", F.col("_in") - F.col("_first"))
    both = counted.groupBy(*by, "event_id").agg(F.max(F.when(F.col("role") == 0, F.col("version"))).alias("src_version"), F.max(F.when(F.col("role") == 1, F.col("version"))).alias("dst_version"), F.bool_or((F.col("role") == 1) & (F.col("_met") > 1)).alias("bumped"))
    return e.join(both, [*by, "event_id"])


def version_edges(dag: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, from_version, to_version, t): the edge from each version of a node to its next, of versioned edges."""
    return dag.filter("bumped").select(*by, F.col("dst").alias("node"), (F.col("dst_version") - 1).alias("from_version"), F.col("dst_version").alias("to_version"), "t")


def latest_versions(dag: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, version): the last version of each node of versioned edges."""
    ends = dag.select(*by, F.col("src").alias("node"), F.col("src_version").alias("v")).unionByName(dag.select(*by, F.col("dst").alias("node"), F.col("dst_version").alias("v")))
    return ends.groupBy(*by, "node").agg(F.max("v").alias("version"))


def time_gaps(edges: DataFrame, by: list[str]) -> DataFrame:
    """Mean gap in seconds between neighbouring events, and first and last time, per graph."""
    n = F.count("*")
    mean = F.when(n > 1, (F.max("t") - F.min("t")) / 1e9 / (n - 1))
    return edges.groupBy(*by).agg(mean.alias("mean_gap"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def unauthorised_pairs(edges: DataFrame, actors: DataFrame, targets: DataFrame, n_targets: int, seed: int = 0) -> DataFrame:
    """(actor, target, r): for each actor, up to n_targets targets it never touched.

    Targets stand on a ring in order of a seeded hash; an actor takes the first it never
    touched from a place of its own on. Among the n_targets + k next ones, k being
    the targets it touched, that many are free, so rows grow with the edges, not with
    actors times targets.
    """
    order = digest(F.lit(seed), "target", hex_digits=15)
    ring = stored(with_ordinal(targets.distinct().withColumn("_h", order), [], ["_h", "target"], 1 << 50, "place").select("target", "place"), "ring")
    touched = edges.select(F.col("src").alias("actor"), F.col("dst").alias("target")).distinct()
    degree = touched.groupBy("actor").agg(F.count("*").alias("_k"))
    size = ring.agg(F.count("*").alias("_n"))
    tries = actors.distinct().join(degree, "actor", "left").crossJoin(F.broadcast(size)).filter("_n > 0")
    last = F.least(F.coalesce("_k", F.lit(0)) + n_targets, F.col("_n")) - 1
    tries = tries.select("actor", "_n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("step"))
    tries = tries.withColumn("place", F.pmod(digest(F.lit(seed), "actor") + F.col("step"), F.col("_n")))
    free = tries.join(ring, "place").join(touched, ["actor", "target"], "left_anti")
    return with_ordinal(free.select("actor", "target", "step"), ["actor"], ["step"], 1 << 12, "r").filter(F.col("r") < n_targets).select("actor", "target", (F.col("r") + 1).cast("int").alias("r"))


def attack_events(pairs: DataFrame, start: int, gap: int, ops: tuple[str, ...] = ("EVENT_OPEN", "EVENT_READ", "EVENT_WRITE")) -> DataFrame:
    """Events of an attack, gap apart: each pair runs through ops; y marks them."""
    steps = pairs.select("actor", "target", "r", F.posexplode(F.array(*map(F.lit, ops))).alias("k", "op"))
    at = F.row_number().over(W.partitionBy("actor").orderBy("r", "k"))
    return steps.select(F.col("actor").alias("src"), F.col("target").alias("dst"), "op", (F.lit(start) + at * gap).alias("t"), F.lit(1).alias("y"))


def window_attacks(edges: DataFrame, by: list[str], nodes: DataFrame, actors: DataFrame, n_targets: int, seed: int = 0) -> DataFrame:
    """Events (by, src, dst, op, t, y) of made-up attacks, in every graph in which an actor of actors(actor) occurs.

    In each such graph the actor opens, reads and writes up to n_targets files of the graph that it touches in
    no graph, then connects to one of the graph's netflows if there is one; without such a file it does nothing.
    It begins at a drawn time of the graph; each step takes the graph's mean gap between events, but a file is
    opened at the time of the write before it. nodes(node, node_type) tell files and netflows. Files and
    netflows of a graph stand on rings in hashed order, so rows grow with edges, not with actors times files.
    """
    end = lambda c: edges.select(*by, F.col(c).alias("node"))
    met = stored(end("src").unionByName(end("dst")).distinct().join(nodes.select("node", "node_type"), "node"), "met")
    span = time_gaps(edges, by).select(*by, (F.coalesce("mean_gap", F.lit(0.0)) * 1e9).cast("long").alias("_gap"), F.col("first_t").alias("_low"), F.col("last_t").alias("_high"))

    def ring(kind: str, salt: str) -> DataFrame:
        own = met.filter(F.col("node_type") == kind).select(*by, F.col("node").alias("target")).withColumn("_h", digest(F.lit(seed), F.lit(salt), *by, "target", hex_digits=15))
        return stored(with_ordinal(own, by, ["_h", "target"], 1 << 50, "place").select(*by, "target", "place"), "ring")

    files, netflows = ring("file", "file"), ring("netflow", "netflow")
    count_of = lambda r: r.groupBy(*by).agg(F.count("*").alias("_n"))
    here = met.select(*by, F.col("node").alias("actor")).join(actors.select("actor").distinct(), "actor", "left_semi")
    touched = stored(edges.select(F.col("src").alias("actor"), F.col("dst").alias("target")).distinct(), "touched")
    degree = touched.groupBy("actor").agg(F.count("*").alias("_k"))
    last = F.least(F.coalesce("_k", F.lit(0)) + n_targets, F.col("_n")) - 1
    left = here.join(degree, "actor", "left").join(count_of(files), by).select(*by, "actor", "_n", last.alias("_last"), F.pmod(digest(F.lit(seed), *by, "actor"), F.col("_n")).alias("_from"), F.lit(0).cast("long").alias("_have"))
    left, low, width, parts = stored(left, "tries"), 0, 2 * n_targets, []
    while left.head(1):
        # a few places at a time, twice as many for those that these are not enough for
        steps = left.withColumn("step", F.explode(F.sequence(F.lit(low).cast("long"), F.least(F.col("_last"), F.lit(low + width - 1).cast("long")))))
        steps = steps.select(*by, "actor", "_have", "step", F.pmod(F.col("_from") + F.col("step"), F.col("_n")).alias("place"))
        free = steps.join(files, [*by, "place"]).join(touched, ["actor", "target"], "left_anti")
        place = F.row_number().over(W.partitionBy(*by, "actor").orderBy("step"))
        parts.append(stored(free.withColumn("_place", place).filter(F.col("_place") <= n_targets).withColumn("r", (F.col("_have") + F.col("_place") - 1).cast("long")).filter(F.col("r") < n_targets).select(*by, "actor", "target", "r"), "taken"))
        low, width = low + width, 2 * width
        more = parts[-1].groupBy(*by, "actor").agg(F.count("*").alias("_new"))
        left = left.filter(F.col("_last") >= low).join(more, [*by, "actor"], "left").withColumn("_have", F.col("_have") + F.coalesce("_new", F.lit(0))).drop("_new").filter(F.col("_have") < n_targets)
        left = stored(left, "tries")
    taken = reduce(DataFrame.unionByName, parts) if parts else left.select(*by, "actor", F.lit(None).cast(files.schema["target"].dataType).alias("target"), F.lit(0).cast("long").alias("r"))
    begin = F.col("_low") + F.pmod(digest(F.lit(seed), F.lit("begin"), *by, "actor"), F.col("_high") - F.col("_low") + 1)
    at = lambda k: (begin + k * F.col("_gap")).alias("t")
    steps = taken.join(span, by).select("*", F.posexplode(F.array(*map(F.lit, ("EVENT_OPEN", "EVENT_READ", "EVENT_WRITE")))).alias("k", "op"))
    done = steps.select(*by, F.col("actor").alias("src"), F.col("target").alias("dst"), "op", at(2 * F.col("r") + F.col("k")))
    ends = taken.groupBy(*by, "actor").agg((2 * F.count("*") + 1).alias("_k")).join(span, by).join(count_of(netflows), by)
    ends = ends.withColumn("place", F.pmod(digest(F.lit(seed), F.lit("netflow"), *by, "actor"), F.col("_n"))).join(netflows, [*by, "place"])
    connects = ends.select(*by, F.col("actor").alias("src"), F.col("target").alias("dst"), F.lit("EVENT_CONNECT").alias("op"), at(F.col("_k")))
    return done.unionByName(connects).withColumn("y", F.lit(1))


# The runs of operations, by a subject on a file, of imitated benign activity.
TEMPLATES = (
    ("EVENT_OPEN", "EVENT_READ"),
    ("EVENT_OPEN", "EVENT_WRITE"),
    ("EVENT_OPEN", "EVENT_READ", "EVENT_WRITE"),
    ("EVENT_OPEN", "EVENT_WRITE", "EVENT_READ"),
    ("EVENT_OPEN", "EVENT_READ", "EVENT_WRITE", "EVENT_READ", "EVENT_WRITE"),
    ("EVENT_OPEN", "EVENT_WRITE", "EVENT_READ", "EVENT_WRITE", "EVENT_READ"),
    ("EVENT_OPEN", "EVENT_READ", "EVENT_WRITE", "EVENT_WRITE", "EVENT_READ"),
    ("EVENT_OPEN", "EVENT_WRITE", "EVENT_READ", "EVENT_WRITE", "EVENT_WRITE"),
    ("EVENT_OPEN", "EVENT_READ", "EVENT_WRITE", "EVENT_READ", "EVENT_WRITE", "EVENT_WRITE", "EVENT_WRITE"),
    ("EVENT_OPEN", "EVENT_WRITE", "EVENT_READ", "EVENT_READ", "EVENT_READ", "EVENT_WRITE", "EVENT_READ"),
    ("EVENT_OPEN", "EVENT_READ", "EVENT_READ", "EVENT_READ", "EVENT_WRITE", "EVENT_WRITE", "EVENT_READ"),
    ("EVENT_OPEN", "EVENT_WRITE", "EVENT_WRITE", "EVENT_WRITE", "EVENT_READ", "EVENT_WRITE", "EVENT_WRITE"),
    ("EVENT_OPEN", "EVENT_READ", "EVENT_READ", "EVENT_READ", "EVENT_READ"),
    ("EVENT_OPEN", "EVENT_WRITE", "EVENT_WRITE", "EVENT_WRITE", "EVENT_WRITE"),
)


def imitation_actors(edges: DataFrame, bad: DataFrame, subjects: DataFrame) -> DataFrame:
    """(node,): subjects among the roots of the attack's own graph and what follows from them in time.

    edges are those of the attack's window. A root of the graph between bad nodes is first met as a source there; what
    follows it are the nodes its edges reach in growing order of time.
    """
    inside = edges.withColumn("_g", F.lit(0))
    own = inside.filter("src != dst").join(bad.select(F.col("node").alias("src")).distinct(), "src", "left_semi").join(bad.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
    ends = own.select("t", "event_id", F.col("src").alias("node"), F.lit(0).alias("role")).unionByName(own.select("t", "event_id", F.col("dst").alias("node"), F.lit(1).alias("role")))
    top = ends.groupBy("node").agg(F.min_by("role", F.struct("t", "event_id", "role")).alias("_first")).filter("_first = 0").select("node")
    from .trace import time_respecting

    start = top.select(F.lit(0).alias("_g"), F.col("node").alias("poi"), F.lit(-1).cast("long").alias("t"))
    reached = time_respecting(inside, ["_g"], start, True).select("node")
    return reached.unionByName(top).distinct().join(subjects.select("node").distinct(), "node", "left_semi")


def imitations(edges: DataFrame, bad: DataFrame, subjects: DataFrame, files: DataFrame, start: int, end: int, n: int, seed: int = 0) -> DataFrame:
    """(src, dst, op, t, run, step, event_id, y): imitated benign activity of an attack, whole runs until n events are reached.

    A run is one of TEMPLATES by a subject of imitation_actors on a file, both
    picked by seeded hashes; it begins within 3 seconds of one of the subject's own events in
    the window, its steps lie up to 3 seconds apart, and it reads from file to subject.
    """
    inside = stored(edges.filter(F.col("t").between(start, end)).select("src", "dst", "t", "event_id"), "inside")
    number = lambda d: stored(with_ordinal(d.select("node").distinct().withColumn("_h", digest(F.lit(seed), "node", hex_digits=15)), [], ["_h", "node"], 1 << 50, "no"), "numbered")
    actors, objects = number(imitation_actors(inside, bad, subjects)), number(files)
    n_actors, n_objects = actors.count(), objects.count()
    if not n_actors or not n_objects or n <= 0:
        return edges.select("src", "dst", "op", "t", F.lit(0).alias("run"), F.lit(0).alias("step"), F.lit("").alias("event_id"), F.lit(1).alias("y")).limit(0)
    names = F.array(*[F.array(*map(F.lit, t)) for t in TEMPLATES])
    draw = lambda what, of: F.pmod(digest(F.lit(seed), F.lit(what), "run"), F.lit(of))
    runs = edges.sparkSession.range(-(-n // 2)).select(F.col("id").cast("int").alias("run"))
    runs = runs.withColumn("ops", F.element_at(names, (draw("template", len(TEMPLATES)) + 1).cast("int")))
    runs = with_running(runs.withColumn("_r", F.col("run").cast("long")), [], ["_r"], 1 << 12, {"_before": ("sum", F.size("ops").cast("long"))}, before=True).filter(F.coalesce("_before", F.lit(0)) < n)
    runs = runs.withColumn("_a", draw("subject", n_actors)).withColumn("_f", draw("file", n_objects))
    runs = runs.join(actors.select(F.col("no").alias("_a"), F.col("node").alias("actor")), "_a").join(objects.select(F.col("no").alias("_f"), F.col("node").alias("file")), "_f").select("run", "ops", "actor", "file")
    ends = inside.select("t", "event_id", F.col("src").alias("actor"), F.lit(0).alias("side")).unionByName(inside.select("t", "event_id", F.col("dst").alias("actor"), F.lit(1).alias("side")))
    ends = ends.join(runs.select("actor").distinct(), "actor", "left_semi")
    own = with_ordinal(ends, ["actor"], ["t", "event_id", "side"], HOUR, "no").select("actor", "no", F.col("t").alias("begin"))
    sizes = ends.groupBy("actor").agg(F.count("*").alias("_n"))
    timed = runs.join(sizes, "actor").withColumn("no", F.pmod(digest(F.lit(seed), F.lit("time"), "run"), F.col("_n"))).join(own, ["actor", "no"])
    steps = timed.select("run", "actor", "file", "begin", F.posexplode("ops").alias("step", "op"))
    gap = F.pmod(digest(F.lit(seed), F.lit("gap"), "run", "step"), F.lit(3_000_000_001))
    at = F.col("begin") + F.sum(gap).over(W.partitionBy("run").orderBy("step"))
    read = F.col("op") == "EVENT_READ"
    return steps.select(F.when(read, F.col("file")).otherwise(F.col("actor")).alias("src"), F.when(read, F.col("actor")).otherwise(F.col("file")).alias("dst"), "op", at.alias("t"), "run", "step", F.concat_ws("-", F.lit("imitation"), "run", "step").alias("event_id"), F.lit(1).alias("y"))


def chain(edges: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Transformations from left to right."""
    for step in steps:
        edges = edges.transform(step)
    return edges
