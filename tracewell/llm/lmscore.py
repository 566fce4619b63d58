"""Cross-entropy difference of two matched n-gram models.

The target model is counted on labelled good documents (quality 1, toxic 0), the
background model on all documents. Both are word bigrams over every word of the
corpus (lower-cased runs of other than ASCII white space); a text begins in a
begin of its own. P(w | v) interpolates the bigram with the unigram by
Witten-Bell weights; unigrams are smoothed by adding one for each word of the
corpus.

No document is scored by its own counts: texts are dealt to FOLDS folds by their hash
(copies of a text to the same one), and a text is scored by both models less its fold.
The models are matched in size: background counts are scaled by the target's share of
all tokens, and the number of different words after a word is that which a part of
such a share is expected to hold, sum of 1 - (1 - share)^n. So no document is left out of
the background, and rare words cost both models alike.

Each text's bigrams go once through a shuffle, packed by a few thousand texts, to the bucket of their first
word, and no bigram is cut by rank. With n, u and v the other folds' counts of the bigram, of w and of what follows v, k
the weight and one = (u + 1) / size, log P is log k + log one + log(1 + n / (k one)) - log(v + k). All but the third
term follow from what a bucket holds, and that term is 0 unless the other fold has the bigram: only such bigrams
ask for counts of w, in a second, smaller shuffle. Words that a sample finds to make up more than one in HOT of the tokens, and
such bigrams, fewer than HOT of each, are spread over buckets or counted by text, and their counts go to every task, so that
no key gathers a share of the corpus in one; the sample decides where counts are made, never what they are.
A document's score is the mean over its tokens of target loss less background loss, in nats; lower is closer to the
target. Words are told apart by 64-bit hashes.

Null, empty and wordless texts have no tokens and null losses. Without a target token
the target model is uniform and the background unscaled. Repeated rows count and score
each. Labels that repeat for one document count once: good if any is. Other columns
pass by unread.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import settle, slices, stored, texts_of

BROADCAST_ROWS = 2_000_000  # target ids, 8 bytes each, that may be broadcast
FLUSH = 1_000_000  # tokens of a chunk, whose bigrams are packed together
TEXTS = 60_000  # of a chunk at most
BLOBS = 32  # packed rows that a task returns at a time
HOT = 2000  # one in so many tokens makes a word or bigram hot
SAMPLE = 1000  # texts, about, that hot ones are looked for in
BUCKETS, PARTS = 96, 12  # at least; a bucket has about half a million tokens, a task ten million
SUMS = 1_000_000  # rows of sums that a task holds
FOLDS = 2  # parts of the texts, each scored by counts of the other; counts come as (n of fold 0, of 1, target's of 0, of 1)
BEGIN, END = 0, 1  # what the first word follows, what follows the last; words hash to other values
SUM, HEAD, WORD, NEED, MORE, HOT_WORD, HOT_PAIR = range(7)  # kinds of rows


def tokens(text: str) -> list[bytes]:
    return text.lower().encode().split()


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, k1 and k2 (its hashes), class (2 * fold + whether it is a target), for every document."""
    good = labels.groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).alias("target")).filter("target and doc_id is not null")
    if good.count() <= BROADCAST_ROWS:
        good = F.broadcast(good)
    text = F.coalesce("text", F.lit(""))
    kind = 2 * fold(text) + F.coalesce("target", F.lit(False)).cast("int")
    return docs.select("doc_id", "text").join(good, "doc_id", "left").select(text.alias("text"), F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"), kind.alias("class"))


def fold(text: Column) -> Column:
    """0 to FOLDS - 1, by the text alone."""
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def word_ids(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, neither BEGIN nor END."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.maximum(h, np.uint64(2))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, whole numbers in the narrowest type that holds them."""
    narrow = [a if a.dtype == np.float64 or not len(a) or a.min() < 0 else a.astype(np.min_scalar_type(a.max())) for a in arrays]
    return pickle.dumps([(a.dtype.str, a.tobytes()) for a in narrow], 5)


def _unpack(blob: pa.Scalar) -> list[np.ndarray]:
    return [np.frombuffer(x, t) for t, x in pickle.loads(blob.as_buffer())]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change, the first row included."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))


def _place(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Each x's place among sorted values, -1 if it is none of them."""
    if not len(sorted_values):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[at] == x, at, -1)


def _classes(kind: np.ndarray, c: np.ndarray) -> Iterator[np.ndarray]:
    """Counts of the folds, then of the target's in them, a column at a time."""
    for own in (kind >> 1 == 0, kind >> 1 == 1, kind == 1, kind == 3):
        yield np.where(own, c, 0).astype(float)


def _by_class(kind: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Rows of counts of the folds and of the target's in them."""
    return np.stack(list(_classes(kind, c)), axis=1)


def _sum_at(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0) if len(starts) else values[:0]


def _others(counts: np.ndarray) -> np.ndarray:
    """[fold, row, target or background]: counts of the other fold."""
    return np.stack([counts[:, [3, 1]], counts[:, [2, 0]]])


def _kinds(others: np.ndarray, share: float) -> np.ndarray:
    """What a bigram adds to the number of kinds after its first word: for the background, the chance that a part of the target's share holds it."""
    return np.stack([(others[..., 0] > 0).astype(float), 1.0 - np.power(1.0 - share, others[..., 1])], axis=-1)


def _survey(every: int):
    """Tokens by class; words (v, w null) and bigrams that a sample of the texts may have often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen, one, two = [0] * 2 * FOLDS, 0, Counter(), Counter()
        for b in slices(batches):
            for text, k1, kind in zip(texts_of(b), b.column("k1").to_pylist(), b.column("class").to_pylist()):
                n[kind] += len(text.encode().split())
                if (k1 >> 8) % every == 0:
                    w = word_ids(tokens(text)).view(np.int64).tolist()
                    seen += len(w)
                    one.update(w)
                    two.update(zip([BEGIN, *w], w))
        rows = [(k, None, None, x) for k, x in enumerate(n)] + [(-1, None, None, seen)]
        rows += [(-2, v, None, x) for v, x in one.items() if x * HOT > seen] + [(-2, v, w, x) for (v, w), x in two.items() if x * HOT > seen]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["k", "v", "w", "n"])

    return run


def _spread(words: np.ndarray, pairs: np.ndarray, buckets: int):
    """Chunks of texts as packed bigrams, a row a bucket, and a row with the texts' hashes, tokens and hot counts.

    words: hot ones, sorted, BEGIN first; pairs: hot bigrams as place of v * words + place of w, sorted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n, chunks, headed, end = 0, 0, -1, np.array([END], np.uint64)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunks
            chunk = (TaskContext.get().partitionId() << 20) + chunks
            chunks += 1
            held.sort(key=lambda h: h[0])
            kind, k1, k2 = (np.array([h[i] for h in held], np.int64) for i in range(3))
            size = np.array([len(h[3]) for h in held])
            w = np.concatenate([np.zeros(0, np.uint64), *(x for h in held if len(h[3]) for x in (h[3], end))])
            held.clear()
            v = np.concatenate([end, w])[:-1]
            v[v == END] = BEGIN
            no = np.repeat(np.arange(len(size), dtype=np.uint16), np.where(size, size + 1, 0))
            order = np.lexsort((w, v)).astype(np.uint32)  # texts keep their order
            v = v[order]
            w = w[order]
            no = no[order]
            del order
            at = _starts(v, w, no)
            c = np.diff(np.append(at, len(v))).astype(np.uint32)
            v = v[at]
            w = w[at]
            no = no[at]
            del at
            hv = _place(words, v).astype(np.int16)
            hot = np.flatnonzero(hv >= 0)
            # hot words by text: as first word of a bigram and as token
            h_v, h_w, h_no, h_c = hv[hot].astype(np.int64), w[hot], no[hot].astype(np.int64), c[hot]
            mine = h_no * len(words) + h_v
            by = np.argsort(mine, kind="stable")
            first = _starts(mine[by])
            counts = [_sum_at(np.where(use, h_c, 0)[by], first) for use in (h_w != END, h_v != BEGIN)]
            mine = mine[by][first]
            del by, first
            place = _place(words, h_w)
            place = np.where(place >= 0, _place(pairs, h_v * len(words) + place), -1)
            met = place >= 0
            keys, blobs = [chunk % buckets], [_pack(kind, k1, k2, size, mine // len(words), mine % len(words), *counts, h_no[met], place[met], h_c[met])]
            cold = np.ones(len(v), bool)
            cold[hot[met | (h_w == END)]] = False
            del hot, h_v, h_w, h_no, h_c, mine, counts, place, met
            bucket = np.where(hv >= 0, w, v)
            del hv
            bucket >>= np.uint64(32)
            bucket *= np.uint64(buckets)
            bucket >>= np.uint64(32)
            cold = np.flatnonzero(cold).astype(np.uint32)
            bucket = bucket[cold].astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cold = cold[order]
            bucket = bucket[order]
            del order
            ends = np.cumsum(np.bincount(kind, minlength=2 * FOLDS))
            cuts = _starts(bucket)
            for a, z in zip(cuts, [*cuts[1:], len(bucket)]):
                own = cold[a:z]
                first = _starts(v[own])
                keys.append(int(bucket[a]))
                blobs.append(_pack(ends, v[own[first]], np.diff(np.append(first, z - a)), w[own], no[own], c[own]))
                if len(keys) == BLOBS:
                    yield packed(chunk, keys, blobs)
                    keys, blobs = [], []
            if keys:
                yield packed(chunk, keys, blobs)

        def packed(chunk: int, keys: list[int], blobs: list[bytes]) -> pa.RecordBatch:
            nonlocal headed
            head, headed = [headed != chunk] + [False] * (len(keys) - 1), chunk
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([chunk] * len(keys), pa.int64()), pa.array(head), pa.array(blobs, pa.binary())], ["bucket", "chunk", "head", "blob"])

        for b in slices(batches):
            for text, k1, k2, kind in zip(texts_of(b), *(b.column(c).to_pylist() for c in ("k1", "k2", "class"))):
                held.append((kind, k1, k2, word_ids(tokens(text))))
                n += len(held[-1][3]) + 1
                if n >= FLUSH or len(held) >= TEXTS:
                    yield from flush()
                    settle()
                    n = 0
        if held:
            yield from flush()
        settle()

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows in order of bucket, a bucket at a time."""
    held, now = [], None
    for b in batches:
        k = b.column("bucket").to_numpy()
        cuts = _starts(k)
        for a, z in zip(cuts, [*cuts[1:], len(k)]):
            if held and k[a] != now:
                yield now, held
                held = []
            now = int(k[a])
            held.append(b.slice(a, z - a))
    if held:
        yield now, held


_ROWS = "kind int, bucket long, key long, s array<double>, blob binary"


def _rows(kind: int, key: np.ndarray, s: np.ndarray | None = None, bucket: int | None = None, blob: list[bytes] | None = None) -> pa.RecordBatch:
    n = len(key)
    lists = pa.nulls(n, pa.list_(pa.float64())) if s is None else pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * s.shape[1], pa.int32()), pa.array(s.ravel(), pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind), pa.int32()), pa.array([bucket] * n, pa.int64()), pa.array(key.astype(np.int64) if key.dtype != np.uint64 else key.view(np.int64)), lists, pa.array(blob or [None] * n, pa.binary())], ["kind", "bucket", "key", "s", "blob"])


class _Sums:
    """Sums of two values by text over the buckets of a task."""

    def __init__(self) -> None:
        self.held, self.n = [], 0

    def add(self, key: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(self._summed(key, s))
        self.n += len(self.held[-1][0])
        if self.n > SUMS:
            self.held = [self._summed(*(np.concatenate(x) for x in zip(*self.held)))]
            self.n = len(self.held[0][0])
            if self.n > SUMS // 2:
                yield from self.rest()

    @staticmethod
    def _summed(key: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        at = _starts(key[order])
        return key[order][at], _sum_at(s[order], at)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            key, s = self._summed(*(np.concatenate(x) for x in zip(*self.held)))
            self.held, self.n = [], 0
            for a in range(0, len(key), 100_000):
                yield _rows(SUM, key[a : a + 100_000], s[a : a + 100_000])


def _settle(words: np.ndarray, share: float):
    """Per bucket: its terms of the texts' sums, counts of its words, and bigrams of both folds with the words whose counts they need."""
    scale = np.array([1.0, share])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for bucket, held in _runs(batches):
            parts, chunks, kinds = [], [], []
            for b in held:
                for r in range(b.num_rows):
                    blob, chunk = b.column("blob")[r], b.column("chunk")[r].as_py()
                    if not b.column("head")[r].as_py():
                        ends, v, n, w, no, c = _unpack(blob)
                        parts.append((np.repeat(v, n).astype(np.uint64), w.astype(np.uint64), np.full(len(w), len(chunks), np.uint32), no.astype(np.uint16), c.astype(np.uint32)))
                        kinds.append(np.searchsorted(ends, no, "right").astype(np.uint8))
                        chunks.append(chunk)
                        continue
                    kind, _, _, _, no, word, first, token, p_no, pair, c = _unpack(blob)
                    yield _rows(HEAD, np.array([chunk]), blob=[blob.as_py()])
                    both = np.concatenate([_by_class(kind[no], token), _by_class(kind[no], first), np.zeros((len(no), 4))], axis=1)
                    order = np.argsort(word, kind="stable")
                    at = _starts(word[order])
                    yield _rows(HOT_WORD, word[order][at], _sum_at(both[order], at))
                    order = np.argsort(pair, kind="stable")
                    at = _starts(pair[order])
                    yield _rows(HOT_PAIR, pair[order][at], _sum_at(_by_class(kind[p_no], c)[order], at))
            if not parts:
                continue
            v, w, chunk, no, c = (np.concatenate(x) for x in zip(*parts))
            kind = np.concatenate(kinds)
            del parts, kinds
            order = np.lexsort((w, v)).astype(np.uint32)
            v = v[order]
            w = w[order]
            chunk, no, c, kind = (x[order] for x in (chunk, no, c, kind))
            del order
            at = _starts(v, w)
            counts = np.stack([_sum_at(x, at) for x in _classes(kind, c)], axis=1)
            long = np.diff(np.append(at, len(v)))
            last = w == END
            bv, bw = v[at], w[at]
            del v, w, at
            inside = (bw != END)[:, None]
            v_at = _starts(bv)
            u, after = _sum_at(counts, v_at), _sum_at(counts * inside, v_at)
            others = _others(counts)
            after_kinds = np.concatenate([_sum_at(_kinds(others[i], share) * inside, v_at) for i in range(FOLDS)], axis=1)  # fold 0: target, background; fold 1
            vs = bv[v_at]
            hv = _place(words, vs)
            cold = hv < 0
            yield _rows(WORD, vs[cold], u[cold])
            yield _rows(HOT_WORD, hv[~cold], np.concatenate([np.zeros((int((~cold).sum()), 8)), after_kinds[~cold]], axis=1))
            weight = np.maximum(np.stack([after_kinds[:, :2], after_kinds[:, 2:]]), 1.0)
            word = np.log(_others(u) * scale + 1)
            context = np.log(weight) - np.log(_others(after) * scale + weight)
            row_v = np.repeat(np.repeat(np.arange(len(vs)), np.diff(np.append(v_at, len(bv)))), long)
            use = cold[row_v]
            f, x = kind[use] >> 1, row_v[use]
            s = context[f, x]
            s[last[use]] = 0
            s += word[f, x]
            s *= c[use][:, None]
            ids = np.array(chunks)
            yield from sums.add((ids[chunk[use]] << 16) + no[use], s)
            del s, f, x, use, row_v, last
            met = (others[..., 1] > 0).all(axis=0) & inside[:, 0]
            if met.any():
                rows = np.repeat(met, long)
                firsts, of_first = np.unique(np.repeat(np.arange(len(vs)), np.diff(np.append(v_at, len(bv))))[met], return_inverse=True)
                need = np.unique(bw[met])
                yield _rows(NEED, need[_place(words, need) < 0], bucket=bucket)
                yield _rows(MORE, np.zeros(1, np.int64), bucket=bucket, blob=[_pack(vs[firsts], after_kinds[firsts].ravel(), of_first, bw[met], counts[met].astype(np.int64).ravel(), long[met], ids, chunk[rows], no[rows], c[rows], kind[rows])])
            settle()
        yield from sums.rest()

    return run


def _more(words: np.ndarray, hot: np.ndarray, share: float, size: np.ndarray):
    """Per bucket: the terms of bigrams that the other fold holds. hot: counts and kinds of hot words; size: [fold, target or background]."""
    scale = np.array([1.0, share])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for _, held in _runs(batches):
            blob, keys, counts = None, [np.zeros(0, np.uint64)], [np.zeros((0, 4))]
            for b in held:
                kind = b.column("kind").to_numpy()
                for r in np.flatnonzero(kind == MORE):
                    blob = b.column("blob")[int(r)]
                found = b.filter(pa.array(kind == NEED))
                keys.append(found.column("key").to_numpy().view(np.uint64))
                counts.append(found.column("s").flatten().to_numpy().reshape(-1, 4))
            vs, kinds, of, w, n, long, ids, chunk, no, c, kind = _unpack(blob)
            key, u = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key)
            key, u = key[order], u[order]
            hv, hw = _place(words, vs), _place(words, w)
            kinds = np.where((hv >= 0)[:, None], hot[hv, 8:], kinds.reshape(-1, 4))
            weight = np.maximum(np.stack([kinds[:, :2], kinds[:, 2:]]), 1.0)[:, of]
            u = np.where((hw >= 0)[:, None], hot[hw, :4], u[_place(key, w)] if len(u) else 0.0)
            one = (_others(u) * scale + 1) / size[:, None]
            term = np.log1p(_others(n.reshape(-1, 4).astype(float)) * scale / (weight * one))
            f, x = kind >> 1, np.repeat(np.arange(len(w)), long)
            yield from sums.add((ids[chunk].astype(np.int64) << 16) + no, term[f, x] * c[:, None])
        yield from sums.rest()

    return run


def _heads(words: int, hot: np.ndarray, pairs: np.ndarray, hot_pairs: np.ndarray, share: float, size: np.ndarray):
    """Per text: hashes, tokens, and the terms of hot words and bigrams and of the sizes."""
    scale = np.array([1.0, share])
    weight = np.maximum(np.stack([hot[:, 8:10], hot[:, 10:]]), 1.0)
    word = np.log(_others(hot[:, :4]) * scale + 1)
    context = np.log(weight) - np.log(_others(hot[:, 4:8]) * scale + weight)
    first, second = pairs // words, pairs % words
    both = np.log1p(_others(hot_pairs) * scale / (weight[:, first] * ((_others(hot[:, :4]) * scale + 1) / size[:, None])[:, second]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                kind, k1, k2, n, no, w, as_first, as_token, p_no, pair, c = _unpack(b.column("blob")[r])
                s = -np.log(size)[kind >> 1] * n[:, None]
                f = kind[no] >> 1
                np.add.at(s, no, word[f, w] * as_token[:, None] + context[f, w] * as_first[:, None])
                np.add.at(s, p_no, both[kind[p_no] >> 1, pair] * c[:, None])
                key = (b.column("key")[r].as_py() << 16) + np.arange(len(n))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(k1.astype(np.int64)), pa.array(k2.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(s[:, 0]), pa.array(s[:, 1])], ["key", "k1", "k2", "n_tokens", "target", "background"])

    return run


def _hot_sums(rows: DataFrame, kind: int, n: int, width: int) -> np.ndarray:
    """Sums of the rows of a kind by key, 0 to n - 1; on the driver, n is bounded by HOT."""
    out = np.zeros((n, width))
    for r in rows.filter(F.col("kind") == kind).groupBy("key").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)]).collect():
        out[r["key"]] = r[1:]
    return out


_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def _freed(df: DataFrame, name: str) -> DataFrame:
    """Stored, with few packed rows at a worker at a time, and the files of the shuffles before it deleted at once."""
    conf = df.sparkSession.conf
    own = {c: conf.get(c) for c in _SETTINGS}
    for c, value in _SETTINGS.items():
        conf.set(c, value)
    try:
        return stored(df, name)
    finally:
        for c, value in own.items():
            conf.set(c, value)


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, difference (means, in nats) per row of docs."""
    own = marked(docs, labels)
    found = own.mapInArrow(_survey(max(1, docs.count() // SAMPLE)), "k long, v long, w long, n long").groupBy("k", "v", "w").agg(F.sum("n").alias("n"))
    seen = F.broadcast(found.filter("k = -1").select(F.col("n").alias("_seen")))
    by = {r["k"]: r["n"] for r in found.filter("k >= 0").collect()}
    often = found.filter("k = -2").crossJoin(seen).filter(F.col("n") * HOT > F.col("_seen")).collect()  # fewer than HOT words, and bigrams
    n = np.array([by.get(k, 0) for k in range(2 * FOLDS)], float)
    whole = np.array([[n[1] + n[3], n.sum()]])
    less = whole - np.array([[n[1], n[0] + n[1]], [n[3], n[2] + n[3]]])  # tokens of the other fold, in target and background
    share = whole[0, 0] / whole[0, 1] if whole[0, 0] else 1.0
    words = np.unique(np.array([BEGIN, *(r["v"] for r in often if r["w"] is None)], np.int64).view(np.uint64))
    two = np.array([(r["v"], r["w"]) for r in often if r["w"] is not None], np.int64).reshape(-1, 2).view(np.uint64)
    first, second = _place(words, two[:, 0]), _place(words, two[:, 1])
    pairs = np.unique((first * len(words) + second)[(first >= 0) & (second >= 0)])
    size = int(whole[0, 1])
    buckets, parts = max(BUCKETS, size // 500_000), max(PARTS, size // 10_000_000)
    dealt = own.mapInArrow(_spread(words, pairs, buckets), "bucket long, chunk long, head boolean, blob binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    rows = _freed(dealt.mapInArrow(_settle(words, share), _ROWS), "bigrams")
    hot, hot_pairs = _hot_sums(rows, HOT_WORD, len(words), 12), _hot_sums(rows, HOT_PAIR, len(pairs), 4)
    for v, x in zip(pairs // len(words), np.concatenate(list(_kinds(_others(hot_pairs), share)), axis=1)):
        hot[v, 8:] += x
    counts = rows.filter(F.col("kind") == WORD).select("key", "s")
    model = np.maximum(1.0, less * np.array([1.0, share]) + counts.count() + int((hot[1:, :2].sum(axis=1) > 0).sum()))
    need = rows.filter(F.col("kind") == NEED).select("kind", "bucket", "key").join(counts, "key").select("kind", "bucket", "key", "s", F.lit(None).cast("binary").alias("blob"))
    asked = rows.filter(F.col("kind") == MORE).select("kind", "bucket", "key", "s", "blob").unionByName(need).repartition(parts, "bucket").sortWithinPartitions("bucket")
    sums = rows.filter(F.col("kind") == SUM).unionByName(asked.mapInArrow(_more(words, hot, share, model), _ROWS)).select("key", F.col("s")[0].alias("target"), F.col("s")[1].alias("background"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("k1", "long"), ("k2", "int"), ("n_tokens", "long"))]
    heads = rows.filter(F.col("kind") == HEAD).mapInArrow(_heads(len(words), hot, pairs, hot_pairs, share, model), "key long, k1 long, k2 int, n_tokens long, target double, background double")
    texts = heads.unionByName(sums.select("key", *none, "target", "background")).groupBy("key").agg(F.max("k1").alias("k1"), F.max("k2").alias("k2"), F.max("n_tokens").alias("n_tokens"), F.sum("target").alias("target"), F.sum("background").alias("background"))
    per = _freed(texts.groupBy("k1", "k2").agg(F.max(F.struct("n_tokens", "target", "background")).alias("m")).select("k1", "k2", "m.*"), "scores")  # copies score alike
    text = F.coalesce("text", F.lit(""))
    loss = lambda c: F.when(F.col("n_tokens") > 0, -F.col(c) / F.col("n_tokens"))
    scored = docs.select("doc_id", F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")).join(per, ["k1", "k2"]).select("doc_id", "n_tokens", loss("target").alias("loss_target"), loss("background").alias("loss_background"))
    return scored.withColumn("difference", F.col("loss_target") - F.col("loss_background"))
