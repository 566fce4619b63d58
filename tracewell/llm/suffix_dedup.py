"""Exact removal of byte strings that occur more than once anywhere in the corpus.

A byte is removed if a string of `span` bytes that covers it also starts at
another place, in the same or another document; strings are judged on the input.

Documents are cut into shards that can be judged alone. Every string of `span`
bytes has a least hash among its KGRAM-byte pieces; strings that are equal have
the same one, so that value names the shard. Neighbouring strings with the same
value form one context. A value met once holds nothing twice. Where all contexts
of a value are equal, hashes alone settle them. Only distinct contexts of the
rest are read as bytes: a suffix array by induced sorting and its permuted common
prefixes give the places where `span` bytes repeat. Values with more than HOT
contexts, or as many bytes (a passage in front of countless different ones) are dealt by hashes of
their strings instead, tiles of neighbouring strings first, so that no value
needs one task.

Null and empty texts have no bytes. Texts are whole; matches end at a document's
ends. Rows that repeat in full are copies of each other. Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix_array import permuted_lcp, suffix_array
from .support import extended, shuffle_parts, slices, stored, texts_of, with_columns

KGRAM = 32
SPAN = 200
HOT = 1024  # contexts of one value that one task compares
PARTS = 21  # ranges in which a string's bytes left of its least piece are tried
TILE = 16  # strings that hashes settle at once
BLOCK = 1 << 20  # bytes hashed, or compared, at a time
_KEYS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def piece_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-byte piece (k a power of two), by doubling."""
    with np.errstate(over="ignore"):
        h, base = _KEYS[b], np.uint64(0x9E3779B97F4A7C15)
        size = 1
        while size < k and len(h) > size:
            h = h[:-size] * base + h[size:]
            base, size = base * base, size * 2
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def window_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def contexts(texts: list[bytes], span: int, k: int = KGRAM) -> tuple[np.ndarray, ...]:
    """doc (index), first and last string start, value, whether the value lies at two places, per context."""
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    full = np.flatnonzero(size >= span)
    if not len(full):
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(np.uint64), e.astype(bool)
    h = piece_hashes(np.frombuffer(b"".join(texts), np.uint8), k)
    width = span - k + 1
    least = window_least(h, width)
    first, last = start[full], start[full] + size[full] - span
    cut = np.zeros(len(least) + 1, bool)
    cut[1:-1] = least[1:] != least[:-1]
    cut[first] = True
    cut[last + 1] = True
    begin = np.flatnonzero(cut[:-1])
    stop = np.append(begin[1:], len(least)) - 1
    doc = np.searchsorted(start, begin, side="right") - 1
    ok = (size[doc] >= span) & (begin <= start[doc] + size[doc] - span)
    begin, stop, doc = begin[ok], stop[ok], doc[ok]
    value = least[begin]
    two, offset = np.zeros(len(begin), bool), np.arange(width)
    for s in range(0, len(begin), 4096):
        a, z, v = begin[s : s + 4096, None], stop[s : s + 4096, None], value[s : s + 4096, None]
        left = a[:, 0] + (h[a + offset] == v).argmax(axis=1)
        right = z[:, 0] + width - 1 - (h[z + offset] == v)[:, ::-1].argmax(axis=1)
        two[s : s + 4096] = left != right
    return doc, begin - start[doc], stop - start[doc], value, two


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK bytes."""
    a = n = 0
    for i, t in enumerate(texts):
        if n and n + len(t) > BLOCK:
            yield a, i
            a, n = i, 0
        n += len(t)
    if a < len(texts):
        yield a, len(texts)


def _scan(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            texts = [t.encode() for t in texts_of(batch)]
            keys = batch.select(["k1", "k2"])
            for a, z in blocks(texts):
                doc, p0, p1, value, two = contexts(texts[a:z], span)
                ctx = [xxhash.xxh3_64_intdigest(texts[a + d][x : y + span]) for d, x, y in zip(doc.tolist(), p0.tolist(), p1.tolist())]
                yield with_columns(
                    keys.take(pa.array(doc + a)),
                    fp=pa.array(value.view(np.int64)),
                    ctx=pa.array(np.array(ctx, np.uint64).view(np.int64)),
                    p0=pa.array(p0.astype(np.int32)),
                    p1=pa.array(p1.astype(np.int32)),
                    two=pa.array(two),
                )

    return run


def _cut(span: int, most: int):
    """Bytes of the contexts that need them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            fp, ctx, hot, raw = [], [], [], []
            for t, mixed in zip(texts, batch.column(1).to_pylist()):
                b = t.encode()
                for m in mixed:
                    fp.append(m["fp"]), ctx.append(m["ctx"]), hot.append(m["n"] > most), raw.append(b[m["p0"] : m["p1"] + span])
            for s in range(0, max(len(fp), 1), 20000):
                z = slice(s, s + 20000)
                yield pa.RecordBatch.from_arrays([pa.array(fp[z], pa.int64()), pa.array(ctx[z], pa.int64()), pa.array(hot[z], pa.bool_()), pa.array(raw[z], pa.binary())], ["fp", "ctx", "hot", "raw"])

    return run


def repeated_starts(parts: list[bytes], span: int) -> list[np.ndarray]:
    """For each part, where `span` bytes start that also start elsewhere in these parts."""
    s = np.frombuffer(b"".join(parts), np.uint8).astype(np.int16) + 2
    size = np.array([len(p) for p in parts])
    end = np.cumsum(size + 1)
    text = np.ones(end[-1] + 1, np.int16)
    text[-1] = 0
    inside = np.ones(end[-1] + 1, bool)
    inside[end - 1] = inside[-1] = False
    text[inside] = s
    plcp, phi = permuted_lcp(text, suffix_array(text))
    at = np.flatnonzero(plcp >= span)
    hit = np.zeros(len(text), bool)
    hit[at] = hit[phi[at]] = True
    return [np.flatnonzero(hit[e - 1 - n : e - span]) for e, n in zip(end, size)]


def sharing(rows: list[tuple[int, bytes]], span: int, k: int = KGRAM) -> list[bool]:
    """For each (value, context): whether it can hold a string that another place of its value holds.

    A string has some number of bytes left of its least piece, the rest right of
    it. For each of PARTS ranges of that number, the bytes that every such string
    has must recur around the value's pieces.
    """
    size = np.array([len(r[1]) for r in rows])
    end = np.cumsum(size)
    h = piece_hashes(np.frombuffer(b"".join(r[1] for r in rows), np.uint8), k).view(np.int64)
    place = np.flatnonzero(h == np.repeat([r[0] for r in rows], size)[: len(h)])
    own = np.searchsorted(end, place, side="right")
    ok = place + k <= end[own]
    place, own = place[ok] - (end - size)[own[ok]], own[ok]
    rest = span - k
    step = -(-rest // PARTS)
    parts = [(a, min(rest, a + step)) for a in range(0, max(rest, 1), step)]
    met: dict[tuple, int] = {}
    alive = [False] * len(rows)
    for i, p in zip(own.tolist(), place.tolist()):
        fp, raw = rows[i]
        for a, z in parts:
            stop = p + k + rest - z
            if a > p or stop > len(raw):
                continue
            key = (fp, a, raw[p - a : stop])
            if key in met:
                alive[i] = alive[met[key]] = True
            met[key] = i
    return alive


def ranges(at: np.ndarray) -> list[dict]:
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > 1)
    return [{"a": int(a), "z": int(z)} for a, z in zip(at[np.append(0, gap + 1)], at[np.append(gap, len(at) - 1)])]


_FOUND = "fp long, ctx long, cov array<struct<a:int,z:int>>"


def _compare(span: int):
    """Rows sorted by value: whole values go into suffix arrays of about BLOCK bytes."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        live = [i for i, alive in enumerate(sharing([(r[0], r[3]) for r in rows], span)) if alive]
        starts = dict(zip(live, repeated_starts([rows[i][3] for i in live], span))) if live else {}
        none = np.zeros(0, np.int64)
        cov = [ranges(np.arange(len(raw) - span + 1) if n > 1 else starts.get(i, none)) for i, (_, _, n, raw) in enumerate(rows)]
        kind = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(cov, kind)], ["fp", "ctx", "cov"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if n > BLOCK and row[0] != held[-1][0]:
                    yield solve(held)
                    held, n = [], 0
                held.append(row)
                n += len(row[3])
        if held:
            yield solve(held)

    return run


def _tiles(span: int):
    """Hot contexts in tiles of up to TILE neighbouring strings, aligned to the least piece, with each string's hash.

    Where the piece lies at several places, other contexts may align equal strings
    to another of them: `two` says so, and `also` has the cores aligned to those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for fp, ctx, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                m = len(raw) - span + 1
                h = piece_hashes(np.frombuffer(raw, np.uint8), KGRAM).view(np.int64)
                places = np.flatnonzero(h == fp)
                p, two = int(places[0]), len(places) > 1
                others = set((places % TILE).tolist()) - {p % TILE}
                also = [xxhash.xxh3_64_intdigest(raw[i : i - TILE + 1 + span]) for r in others for i in range(r, m + TILE - 1, TILE)]
                lo = 0
                while lo < m:
                    last = lo + (p - lo) % TILE  # the distance to the piece is a multiple of TILE
                    hi = min(m, last + 1)
                    core = xxhash.xxh3_64_intdigest(raw[last : last - TILE + 1 + span])  # in every string of a whole tile here
                    tile = xxhash.xxh3_64_intdigest(raw[lo : hi + span - 1], seed=(p - lo) % (1 << 32))
                    out.append((fp, ctx, n, lo, tile, core, [xxhash.xxh3_64_intdigest(raw[i : i + span]) for i in range(lo, hi)], two, also if not lo else []))
                    lo = hi
            strings, also = ([np.array(r[k], np.uint64).view(np.int64) for r in out] for k in (6, 8))
            numbers = [pa.array([r[k] for r in out], pa.int64()) for k in range(4)]
            hashes = [pa.array(np.array([r[k] for r in out], np.uint64).view(np.int64)) for k in (4, 5)]
            yield pa.RecordBatch.from_arrays([*numbers, *hashes, pa.array(strings, pa.list_(pa.int64())), pa.array([r[7] for r in out], pa.bool_()), pa.array(also, pa.list_(pa.int64()))], ["fp", "ctx", "n", "lo", "tile", "core", "strings", "two", "also"])

    return run


ALIGNED = 2048  # contexts whose further alignments a task looks through


def _different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different (fp, core) of rows (fp, also), as far as a task holds them together."""
    held: set[tuple[int, int]] = set()

    def rows() -> pa.RecordBatch:
        found = sorted(held)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["fp", "core"])

    for batch in batches:
        for fp, also in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.update((fp, core) for core in also)
            if len(held) > 100_000:
                yield rows()
    yield rows()


def hot_places(hot: DataFrame, span: int) -> DataFrame:
    """(fp, ctx, cov) of hot contexts.

    Equal tiles settle their strings. Strings of other tiles are looked up one by
    one, and only where the bytes that all strings of the tile have occur in another
    tile, aligned to any place of the piece, or the piece lies at several places.
    """
    tiles = stored(hot.mapInArrow(_tiles(span), "fp long, ctx long, n long, lo long, tile long, core long, strings array<long>, two boolean, also array<long>"), "tiles")
    kinds = stored(tiles.groupBy("fp", "tile").agg(F.sum("n").alias("n"), F.first("core").alias("core"), F.first("strings").alias("strings"), F.max("two").alias("two")), "kinds")
    also = tiles.filter(F.size("also") > 0).select("fp", "also")
    also = also.repartition(max(1, -(-also.count() // ALIGNED))).mapInArrow(_different, "fp long, core long")  # one is enough for any tile of that core
    cores = kinds.select("fp", "core").unionByName(also).groupBy("fp", "core").agg(F.count("*").alias("_n")).filter("_n > 1").select("fp", "core")
    sure = F.col("two") | (F.size(F.array_distinct("strings")) < F.size("strings"))
    open_ = kinds.filter(sure).unionByName(kinds.filter(~sure).join(cores, ["fp", "core"], "left_semi"))
    each = open_.select("fp", "tile", "n", F.posexplode("strings").alias("i", "string"))
    twice = each.groupBy("fp", "string").agg(F.sum("n").alias("n")).filter("n > 1").select("fp", "string")
    alone = each.filter("n = 1").join(twice, ["fp", "string"]).groupBy("fp", "tile").agg(F.transform(F.array_sort(F.collect_set("i")), lambda i: F.struct(i.alias("a"), i.alias("z"))).alias("cov"))
    shared = kinds.filter("n > 1").select("fp", "tile", F.array(F.struct(F.lit(0).alias("a"), (F.size("strings") - 1).alias("z"))).alias("cov"))
    found = tiles.select("fp", "ctx", "lo", "tile").join(alone.unionByName(shared), ["fp", "tile"])
    at = F.col("lo").cast("int")
    return found.select("fp", "ctx", F.transform("cov", lambda c: F.struct((c["a"] + at).alias("a"), (c["z"] + at).alias("z"))).alias("cov")).groupBy("fp", "ctx").agg(F.flatten(F.collect_list("cov")).alias("cov"))


def _remove(span: int):
    """Spans, and what is left, from each text and its repeated strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t.encode() for t in texts_of(batch)]
            found = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("settled", "mixed")]
            removed, spans, kept = [], [], []
            for t, *parts in zip(texts, *found):
                pairs = sorted((r["a"], r["z"] + span) for part in parts for r in part or ())
                runs: list[list[int]] = []
                for a, z in pairs:
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(z, runs[-1][1])
                    else:
                        runs.append([a, z])
                left, at = [], 0
                for a, z in runs:
                    left.append(t[at:a])
                    at = z
                removed.append(sum(z - a for a, z in runs)), spans.append([{"a": a, "z": z} for a, z in runs]), kept.append(b"".join([*left, t[at:]]))
            out = batch.select([c for c in batch.schema.names if c not in ("text", "settled", "mixed")])
            kind = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))
            yield with_columns(
                out,
                n_bytes=pa.array([len(t) for t in texts], pa.int64()),
                n_removed=pa.array(removed, pa.int64()),
                spans=pa.array(spans, kind),
                kept=pa.array(kept, pa.binary()),
            )

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 96-bit key (k1, k2) of both."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "text", F.xxhash64("doc_id", text).alias("k1"), F.hash(text).alias("k2"))


def repeated_contexts(docs: DataFrame, span: int) -> DataFrame:
    """Per key: contexts that hashes settle, and those whose bytes are needed."""
    found = stored(keyed(docs).select("k1", "k2", "text").mapInArrow(_scan(span), "k1 long, k2 int, fp long, ctx long, p0 int, p1 int, two boolean"), "contexts")
    n = F.count("*")
    weight = F.greatest(n, F.ceil(F.sum(F.col("p1") - F.col("p0") + span) / (2 * span)))  # contexts, or as many of usual length
    values = found.groupBy("fp").agg(n.alias("n"), weight.cast("int").alias("weight"), (F.min("ctx") == F.max("ctx")).alias("same"), F.max("two").alias("two"))
    values = values.filter((F.col("n") > 1) | F.col("two")).select("fp", "weight", ((F.col("n") > 1) & F.col("same")).alias("settled"))
    kept = found.drop("two").join(values, "fp")
    settled = F.when(F.col("settled"), F.struct(F.col("p0").alias("a"), F.col("p1").alias("z")))
    mixed = F.when(~F.col("settled"), F.struct("fp", "ctx", "p0", "p1", F.col("weight").alias("n")))
    return kept.groupBy("k1", "k2").agg(F.collect_set(settled).alias("settled"), F.collect_set(mixed).alias("mixed"), n.alias("rows"))


def suffix_dedup(docs: DataFrame, span: int = SPAN, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans array<struct<a,z>> (removed, end exclusive) and kept binary per row of docs."""
    spark = docs.sparkSession
    per_doc = repeated_contexts(docs, span)
    per_doc = stored(per_doc.drop("rows"), "per-doc")
    texts = keyed(docs).repartition(shuffle_parts(spark), "k1", "k2")
    need = per_doc.filter(F.size("mixed") > 0).select("k1", "k2", "mixed")
    raw = texts.join(need, ["k1", "k2"]).select("text", "mixed").mapInArrow(_cut(span, hot), "fp long, ctx long, hot boolean, raw binary")
    distinct = raw.groupBy("fp", "ctx").agg(F.count("*").alias("n"), F.first("raw").alias("raw"), F.first("hot").alias("hot"))
    distinct = stored(distinct, "distinct")
    few = distinct.filter(~F.col("hot")).select("fp", "ctx", "n", "raw").repartition(shuffle_parts(spark), "fp").sortWithinPartitions("fp").mapInArrow(_compare(span), _FOUND)
    many = hot_places(distinct.filter("hot").select("fp", "ctx", "n", "raw"), span)
    found = few.unionByName(many).filter(F.size("cov") > 0)
    place = need.select("k1", "k2", F.explode("mixed").alias("m")).select("k1", "k2", "m.fp", "m.ctx", "m.p0")
    placed = place.join(found, ["fp", "ctx"]).select("k1", "k2", F.transform("cov", lambda c: F.struct((c["a"] + F.col("p0")).alias("a"), (c["z"] + F.col("p0")).alias("z"))).alias("cov"))
    placed = placed.groupBy("k1", "k2").agg(F.flatten(F.collect_list("cov")).alias("mixed"))
    all_found = per_doc.select("k1", "k2", "settled").join(placed, ["k1", "k2"], "full")
    joined = texts.join(all_found, ["k1", "k2"], "left").select("doc_id", "text", "settled", "mixed")
    return joined.mapInArrow(_remove(span), extended([docs.schema["doc_id"]], "n_bytes long, n_removed long, spans array<struct<a:int,z:int>>, kept binary"))


def digest_columns(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
