"""Corpora and vectors from node labels and event neighbourhoods."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.ordinal import HOUR, with_ordinal, with_running
from tracewell.functions.scalar import any_tokens, positional, prefixes, word_weights
from tracewell.functions.tables import stored
from tracewell.functions.vectors import combined


def corpus(nodes: DataFrame, members: DataFrame, splits: tuple[str, ...]) -> DataFrame:
    """(node, label, tokens) of distinct labels in the splits; the least node id stands for a label."""
    used = nodes.join(members.filter(F.col("split").isin(*splits)), "node", "left_semi")
    return used.groupBy("label").agg(F.min("node").alias("node")).select("node", "label", any_tokens(F.col("label")).alias("tokens"))


def neighbour_corpus(edges: DataFrame, tokens: DataFrame, graph: str | None = None, part: int = 10_000) -> DataFrame:
    """(node, part, tokens): own tokens, then those of out-neighbours in order of id, at most `part` neighbours a row.

    With graph, a column that orders several graphs, a node's neighbours are those of the first graph it occurs in.
    A hub's document is several rows, so no task holds all of a hub's neighbours.
    """
    own = edges.select(F.col(graph).alias("_g") if graph else F.lit(0).alias("_g"), "src", "dst")
    pairs = own.distinct()
    if graph:
        met = own.select("_g", F.col("src").alias("node")).unionByName(own.select("_g", F.col("dst").alias("node")))
        first = met.groupBy("node").agg(F.min("_g").alias("_g"))
        pairs = pairs.join(first.withColumnRenamed("node", "src"), ["src", "_g"])
    placed = with_ordinal(pairs.select("src", "dst"), ["src"], ["dst"], 1 << 16, "_no").withColumn("part", F.floor(F.col("_no") / part).cast("int"))
    near = placed.join(tokens.withColumnsRenamed({"node": "dst", "tokens": "_t"}), "dst").groupBy(F.col("src").alias("node"), "part")
    near = near.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_no", "_t"))), lambda s: s["_t"])).alias("_n"))
    none = F.array().cast("array<string>")
    begin = tokens.select("node", F.lit(0).alias("part"), "tokens").join(near, ["node", "part"], "left")
    rest = near.filter("part > 0").join(tokens.select("node"), "node", "left_semi").select("node", "part", F.col("_n").alias("tokens"))
    return begin.select("node", "part", F.concat("tokens", F.coalesce("_n", none)).alias("tokens")).unionByName(rest)


def event_sentences(edges: DataFrame, by: list[str], most: int = 100) -> DataFrame:
    """(by, node, words): (source, operation, destination) of a node's first `most` events in time order.

    The method ends a sentence list at 300 words, hence 100 events.
    """
    ends = edges.withColumn("node", F.explode(F.array_distinct(F.array("src", "dst"))))
    kept = with_ordinal(ends, [*by, "node"], ["t", "event_id"], HOUR, "_r").filter(F.col("_r") < most)
    words = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.array(F.col("src").cast("string"), "op", F.col("dst").cast("string")).alias("w")))), lambda s: s["w"]))
    return kept.groupBy(*by, "node").agg(words.alias("words"))


def hash_cell(word: Column, size: int) -> tuple[Column, Column]:
    """(cell, sign) of a word by md5, the same in any engine."""
    h = F.md5(word)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % size, F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def hierarchical_hash(paths: DataFrame, size: int, separator: str = "/") -> DataFrame:
    """(id, cell, value): signed hashing of all prefixes of a path, scaled to unit length; zero cells are left out."""
    cell, sign = hash_cell(F.col("prefix"), size)
    counts = paths.select("id", F.explode(prefixes(F.col("path"), separator)).alias("prefix")).groupBy("id", cell.alias("cell")).agg(F.sum(sign).alias("v")).filter("v != 0")
    length = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_l"))
    return counts.join(length, "id").select("id", "cell", (F.col("v") / F.col("_l")).alias("value"))


def weighted_mean(tokens: DataFrame, vectors: DataFrame, size: int, percent: float = 30.0) -> DataFrame:
    """(node, vec): word vectors averaged with falling weights, unknown words zero, scaled to unit length."""
    t = tokens.select("node", F.posexplode("tokens").alias("i", "word"), word_weights(F.size("tokens"), percent).alias("w"))
    parts = t.join(vectors.select("word", "vec"), "word").select("node", F.element_at("w", F.col("i") + 1).alias("w"), "vec")
    sums = combined(parts, ["node"], "vec", size, weight="w")
    dense = tokens.select("node").join(sums, "node", "left").select("node", F.coalesce("vec", F.array_repeat(F.lit(0.0), size)).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)) + 1e-12
    return dense.select("node", F.transform("v", lambda x: x / norm).alias("vec"))


def train_word2vec(tokens: DataFrame, size: int, window: int = 5, min_count: int = 1, seed: int = 0, epochs: int = 1) -> DataFrame:
    """(word, vec) by the library's Word2Vec."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, seed=seed, maxIter=epochs, inputCol="tokens", outputCol="v").fit(tokens)
    return model.getVectors().select("word", vector_to_array("vector").alias("vec"))


def char_ngrams(word: Column, low: int = 3, high: int = 6) -> Column:
    """Character n-grams of a word in angle brackets."""
    w = F.concat(F.lit("<"), word, F.lit(">"))
    of = lambda n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[of(n) for n in range(low, high + 1)])


def _drawn(seed: int, k: int, of: Column) -> Column:
    """A number below `of` from the walk's name and step, so that retries agree and any engine can follow."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "node", "walk", F.lit(k))), 1, 8), 16, 10).cast("long"), of)


def walk_table(edges: DataFrame, forward: bool = True) -> DataFrame:
    """(at, no, next, ahead, out): a node's edges in walking order (backward: latest first) numbered from 0.

    ahead is the number of the first edge of next that lies strictly later (backward: earlier); out is how
    many next has. A walk's choices are then a range of numbers, and a step is one lookup.
    """
    a, b = ("src", "dst") if forward else ("dst", "src")
    t = F.col("t") if forward else -F.col("t")
    e = edges.select(F.col(a).alias("at"), F.col(b).alias("next"), t.alias("w"), "event_id")
    no = with_ordinal(e, ["at"], ["w", "event_id"], HOUR, "no")
    # at each node: its own edges count, arrivals ask how many lie at or before them
    seen = e.select(F.col("at").alias("v"), "w", F.lit(0).alias("kind"), "event_id", F.lit(1).cast("long").alias("one")).unionByName(e.select(F.col("next").alias("v"), "w", F.lit(1).alias("kind"), "event_id", F.lit(0).cast("long").alias("one")))
    ahead = with_running(seen, ["v"], ["w", "kind", "event_id"], HOUR, {"ahead": ("sum", "one")}).filter("kind = 1").select("event_id", "ahead")
    out = e.groupBy(F.col("at").alias("next")).agg(F.count("*").alias("out"))
    return no.join(ahead, "event_id").join(out, "next", "left").select("at", "no", "next", "w", "ahead", F.coalesce("out", F.lit(0)).alias("out"))


def temporal_walks(edges: DataFrame, starts: DataFrame, length: int, n_walks: int, seed: int = 0, forward: bool = True) -> DataFrame:
    """(node, walk, path): walks along strictly later (backward: earlier) edges, each next edge equally likely.

    A walk ends where no edge is left. Edges are picked by number, so each step is one equality join
    that finds at most one edge a walk, however many a node has.
    """
    table = stored(walk_table(edges, forward), "walk-table")
    first = table.groupBy(F.col("at").alias("node")).agg(F.count("*").alias("out"))
    walks = starts.distinct().join(first, "node", "left").fillna(0, ["out"]).select("node", F.explode(F.sequence(F.lit(0), F.lit(n_walks - 1))).alias("walk"), "out")
    walks = walks.select("node", "walk", F.col("node").alias("at"), F.lit(0).cast("long").alias("ahead"), "out", F.array("node").alias("path"))
    edge = table.select("at", "no", F.col("next").alias("_next"), F.col("ahead").alias("_ahead"), F.col("out").alias("_out"))
    for k in range(1, length):
        left = F.col("out") - F.col("ahead")
        asked = walks.withColumn("no", F.when(left > 0, F.col("ahead") + _drawn(seed, k, F.when(left > 0, left).otherwise(1))))
        moved = asked.join(edge, ["at", "no"], "left")
        on = F.col("_next").isNotNull()
        walks = moved.select("node", "walk", F.coalesce("_next", "at").alias("at"), F.when(on, F.col("_ahead")).otherwise(F.col("out")).alias("ahead"), F.when(on, F.col("_out")).otherwise(F.col("out")).alias("out"), F.when(on, F.concat("path", F.array("_next"))).otherwise(F.col("path")).alias("path"))
        walks = stored(walks, "walks")
    return walks.select("node", "walk", "path")


def walks_either_way(edges: DataFrame, starts: DataFrame, length: int = 30, n_walks: int = 10, seed: int = 0, half_life: float | None = None) -> DataFrame:
    """(node, walk, path): forward walks from nodes with an edge out, backward ones from the others.

    Later edges are equally likely, or decay with their gap where a half-life is given.
    """
    out = edges.select(F.col("src").alias("node")).distinct()
    ahead, back = starts.join(out, "node", "left_semi"), starts.join(out, "node", "left_anti")
    if half_life is not None:
        return decayed_walks(edges, ahead, length, n_walks, half_life, seed).unionByName(decayed_walks(edges, back, length, n_walks, half_life, seed, False))
    return temporal_walks(edges, ahead, length, n_walks, seed).unionByName(temporal_walks(edges, back, length, n_walks, seed, False))


def decayed_table(edges: DataFrame, half_life: float, forward: bool = True) -> DataFrame:
    """(at, no, next, out, level, ahead_level): a node's edges in walking order with what it takes to draw one by decayed weight.

    An edge weighs exp(-w / half_life) at walking time w. level is minus the logarithm of the weight of the
    edge and all after it at the node, and ahead_level that of the edges of next that lie strictly later, null
    without one. An edge among those from `no` on, in proportion to weight, is then the last whose level is
    at most level(no) plus an exponential draw. Weights are added in spans of 100 half-lives, each on its own
    scale, so nothing underflows; what lies two spans later weighs less than a double can tell.
    """
    span = 100.0
    table = walk_table(edges, forward)
    first = table.groupBy("at").agg(F.min("w").alias("_w0"))
    age = (F.col("w") - F.col("_w0")) / F.lit(float(half_life))
    aged = table.join(first, "at").withColumn("_span", F.floor(age / span)).withColumn("_x", F.exp(F.col("_span") * span - age)).drop("_w0")
    totals = aged.groupBy("at", "_span").agg(F.sum("_x").alias("_total")).select("at", (F.col("_span") - 1).alias("_span"), (F.col("_total") * math.exp(-span)).alias("_later"))
    back = aged.withColumn("_back", -F.col("w")).withColumn("_order", -F.col("no"))
    summed = with_running(back, ["at", "_span"], ["_back", "_order"], HOUR, {"_sum": ("sum", "_x")}).join(totals, ["at", "_span"], "left")
    level = F.col("_span") * span - F.ln(F.col("_sum") + F.coalesce("_later", F.lit(0.0)))
    levels = stored(summed.select("at", "no", "next", "ahead", "out", level.alias("level")), "levels")
    later = levels.select(F.col("at").alias("next"), F.col("no").alias("ahead"), F.col("level").alias("ahead_level"))
    return levels.join(later, ["next", "ahead"], "left").select("at", "no", "next", "out", "level", "ahead_level")


def decayed_walks(edges: DataFrame, starts: DataFrame, length: int, n_walks: int, half_life: float, seed: int = 0, forward: bool = True) -> DataFrame:
    """(node, walk, path): as temporal_walks, but an edge is drawn in proportion to exp(-gap / half_life).

    A step puts the walks' draws among the levels of their nodes' edges and takes for each the last edge before
    it: one sorted pass over slices, whatever a node's degree.
    """
    table = stored(decayed_table(edges, half_life, forward), "decayed")
    first = table.filter("no = 0").select(F.col("at").alias("node"), F.col("level").alias("from"))
    walks = starts.distinct().join(first, "node", "left").select("node", F.explode(F.sequence(F.lit(0), F.lit(n_walks - 1))).alias("walk"), "from")
    walks = walks.select("node", "walk", F.col("node").alias("at"), "from", F.array("node").alias("path"))
    fine = 1 << 20  # levels as whole numbers for slices, finer order by the level itself
    whole = lambda c: F.floor(c * fine).cast("long")
    edge = table.select("at", whole(F.col("level")).alias("_key"), "level", F.lit(0).alias("kind"), F.col("no").alias("_no"), F.struct("no", "next", "ahead_level").alias("edge"))
    for k in range(1, length):
        going = walks.filter(F.col("from").isNotNull())
        drawn = F.col("from") - F.ln((_drawn(seed, k, F.lit(1 << 32)).cast("double") + 0.5) / float(1 << 32))
        asked = going.withColumn("level", drawn)
        asks = asked.select("at", whole(F.col("level")).alias("_key"), "level", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("_no"), F.lit(None).cast(edge.schema["edge"].dataType).alias("edge"), F.struct("node", "walk", "path").alias("who"))
        met = with_running(edge.unionByName(asks, allowMissingColumns=True), ["at"], ["_key", "level", "kind", "_no"], fine, {"found": ("max", "edge")}).filter("kind = 1")
        moved = met.select("who.node", "who.walk", F.col("found.next").alias("at"), F.col("found.ahead_level").alias("from"), F.concat("who.path", F.array("found.next")).alias("path"))
        walks = stored(moved.unionByName(walks.filter(F.col("from").isNull())), "walks")
    return walks.select("node", "walk", "path")


def static_walks(edges: DataFrame, length: int, walks_per_degree: int, seed: int = 0) -> DataFrame:
    """(node, walk, path): walks over both directions of distinct pairs, degree times walks_per_degree from each node.

    A path alternates nodes and an operation between them. Neighbours of a node are numbered; each comes with the
    pair's operations in order and its own degree, so a step is one lookup. Walks start from the rows of neighbours,
    a hub's in many tasks. Joins are by shuffle: Spark judges walks and ways by files they outgrow many times, and the
    driver could not hold the broadcast.
    """
    both = edges.select(F.col("src").alias("at"), "op", F.col("dst").alias("next")).unionByName(edges.select(F.col("dst").alias("at"), "op", F.col("src").alias("next"))).distinct()
    pairs = both.groupBy("at", "next").agg(F.sort_array(F.collect_list(F.struct("op"))).alias("ops"))
    near = stored(with_ordinal(pairs, ["at"], ["next"], 1 << 16, "no"), "near")
    degree = stored(near.groupBy("at").agg(F.count("*").alias("d")), "degree")
    ways = stored(near.join(degree.select(F.col("at").alias("next"), F.col("d").alias("ahead")).hint("merge"), "next").select("at", "no", "next", "ops", "ahead"), "ways")
    no = F.col("no").cast("int")
    walks = near.join(degree.hint("merge"), "at").select(F.col("at").alias("node"), F.explode(F.sequence(no * walks_per_degree + 1, (no + 1) * walks_per_degree)).alias("walk"), "at", "d", F.array(F.col("at").cast("string")).alias("path"))
    for k in range(1, length):
        moved = walks.withColumn("no", _drawn(seed, 2 * k, F.col("d"))).join(ways.hint("merge"), ["at", "no"]).withColumn("j", _drawn(seed, 2 * k + 1, F.size("ops").cast("long")).cast("int"))
        walks = moved.select("node", "walk", F.col("next").alias("at"), F.col("ahead").alias("d"), F.concat("path", F.array(F.col("ops")[F.col("j")]["op"], F.col("next").cast("string"))).alias("path"))
    return stored(walks.select("node", "walk", "path"), "walks")


def split_message(message: Column, parts: list[tuple[str, int]]) -> dict[str, Column]:
    """The named parts of a packed edge vector, by their sizes in order."""
    out, at = {}, 1
    for name, size in parts:
        out[name] = F.slice(message, at, size)
        at += size
    return out


def constant_vectors(nodes: DataFrame, kind: str, types: tuple[str, ...] = ()) -> DataFrame:
    """(node, vec) without training: only_type gives the node type's one-hot, only_ones a single 1."""
    if kind == "only_ones":
        return nodes.select("node", F.array(F.lit(1.0)).alias("vec"))
    if kind != "only_type":
        raise ValueError(f"no constant vectors {kind!r}")
    return nodes.select("node", F.array(*[(F.col("node_type") == t).cast("double") for t in types]).alias("vec"))


def document_vector(words: DataFrame, vectors: DataFrame, by: list[str], size: int) -> DataFrame:
    """(by, node, vec): mean over a document's known words of vector plus positional encoding; zeros if none is known."""
    each = words.select(*by, "node", F.posexplode("words").alias("i", "word")).join(vectors.select("word", "vec"), "word")
    placed = each.select(*by, "node", F.zip_with("vec", positional(F.col("i"), size), lambda v, p: v.cast("double") + p).alias("vec"))
    mean = combined(placed, [*by, "node"], "vec", size, "mean")
    zeros = F.array_repeat(F.lit(0.0), size)
    return words.select(*by, "node").join(mean, [*by, "node"], "left").withColumn("vec", F.coalesce("vec", zeros))


def context_vectors(tokens: DataFrame, vectors: DataFrame, window: int) -> DataFrame:
    """(word, k, x): the elements of each word's mean context."""
    from .embed import context_means

    return context_means(tokens, vectors, window).select("word", F.posexplode("vec").alias("k", "x"))


def edge_features(edges: DataFrame, vectors: DataFrame, type_hot: Callable[[Column], Column], op_hot: Callable[[Column], Column]) -> DataFrame:
    """Adds x: source type, source vector, operation, destination type, destination vector."""
    v = vectors.select("node", "node_type", "vec")
    e = edges.join(v.withColumnsRenamed({"node": "src", "node_type": "_st", "vec": "_sv"}), "src").join(v.withColumnsRenamed({"node": "dst", "node_type": "_dt", "vec": "_dv"}), "dst")
    return e.withColumn("x", F.concat(type_hot(F.col("_st")), "_sv", op_hot(F.col("op")), type_hot(F.col("_dt")), "_dv")).drop("_st", "_sv", "_dt", "_dv")
