"""Byte-level BPE on numpy matrices.

Distinct pieces of a block of texts go into padded matrices, one per length
bucket. In each round every row merges its leftmost pair of least rank; pairs
are looked up in an open-addressing hash table, finished rows leave the matrix
and trailing columns are cut. Pieces longer than LONG bytes, whose rounds would
grow with the square of their length, take a heap over a linked list instead,
with the same order of merges.

A null text counts as empty: no ids, empty decoding. Texts are whole, of any
length. Repeated rows give repeated results; other columns pass by unread.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .support import extended, slices, texts_of, with_columns

NONE = np.int32(2**31 - 1)
LONG = 192
CACHE = 120_000  # pieces remembered by a worker; beyond that it starts anew
BLOCK_CHARS = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token, space, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Hash table (left id, right id) -> id of the merged token."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, to = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        values = np.array(to, np.int32)
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, 2**64 - 1, np.uint64), np.full(1 << bits, NONE, np.int32)
        slot, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            first = np.zeros(len(todo), bool)
            first[np.unique(slot[todo], return_index=True)[1]] = True
            put = free & first
            self.keys[slot[todo[put]]], self.values[slot[todo[put]]] = keys[todo[put]], values[todo[put]]
            todo = todo[~put]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair does not merge; negative ids are padding."""
        out = np.full(left.shape, NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left.ravel()[at].astype(np.uint64) << np.uint64(32)) | right.ravel()[at].astype(np.uint64)
        slot, flat = self._slot(keys), out.reshape(-1)
        while len(at):
            found = self.keys[slot]
            hit = found == keys
            flat[at[hit]] = self.values[slot[hit]]
            more = ~hit & (found != np.uint64(2**64 - 1))
            at, keys, slot = at[more], keys[more], (slot[more] + 1) & self.mask
        return out


class Coder:
    """Encoder and decoder over one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.ranks, self.pairs = ranks, PairTable(ranks)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.known: dict[str, bytes] = {}

    def _matrix(self, x: np.ndarray) -> list[np.ndarray]:
        """Encode rows of byte ids padded by -1; rows keep their order."""
        done: list = [None] * len(x)
        row = np.arange(len(x))
        p = self.pairs.find(x[:, :-1], x[:, 1:])
        while True:
            least = p.min(axis=1) if p.shape[1] else np.full(len(x), NONE, np.int32)
            over = least == NONE
            if over.any():
                for r, ids in zip(row[over], x[over]):
                    done[r] = ids[ids >= 0]
                keep = ~over
                row, x, p, least = row[keep], x[keep], p[keep], least[keep]
            if not len(x):
                return done
            width = int((x >= 0).sum(axis=1).max())
            x, p = x[:, :width], p[:, : width - 1]
            j, n = p.argmin(axis=1), np.arange(len(x))
            x[n, j] = least
            cols = np.arange(width - 1)
            src = cols + (cols[None, :] > j[:, None])
            x = np.take_along_axis(x, src, axis=1)
            p = np.take_along_axis(np.concatenate([p, np.full((len(p), 1), NONE, np.int32)], axis=1), src, axis=1)[:, : width - 2]
            if width >= 3:
                for at in (j - 1, j):
                    ok = (at >= 0) & (at < width - 2)
                    r, c = n[ok], at[ok]
                    p[r, c] = self.pairs.find(x[r, c], x[r, c + 1])

    def _long(self, piece: bytes) -> np.ndarray:
        rank = self.ranks.get
        parts: list = [piece[i : i + 1] for i in range(len(piece))]
        after, before, n = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1)), len(parts)
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            if parts[i] is None or (k := after[i]) >= n or len(parts[i]) + len(parts[k]) != size:
                continue
            parts[i], parts[k] = parts[i] + parts[k], None
            after[i] = after[k]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := rank(both := parts[a] + parts[after[a]])) is not None:
                    heapq.heappush(heap, (r, a, len(both)))
        return np.array([self.ranks[p] for p in parts if p is not None], np.int32)

    def _learn(self, pieces: list[str]) -> None:
        """Put the ids of new pieces, as little-endian uint32, into the cache."""
        if len(self.known) + len(pieces) > CACHE:
            self.known.clear()
        raw = [p.encode() for p in pieces]
        size = np.array([len(b) for b in raw])
        for i in np.flatnonzero(size > LONG):
            self.known[pieces[i]] = self._long(raw[i]).astype("<u4").tobytes()
        low = 0
        for high in (4, 8, 12, 16, 24, 32, 64, LONG):
            at = np.flatnonzero((size > low) & (size <= high))
            low = high
            for s in range(0, len(at), 1 << 14):
                part = at[s : s + (1 << 14)]
                flat = np.frombuffer(b"".join([raw[i] for i in part]), np.uint8)
                x, n = np.full((len(part), high), -1, np.int32), size[part]
                x[np.arange(high)[None, :] < n[:, None]] = self.byte[flat]
                for i, ids in zip(part, self._matrix(x)):
                    self.known[pieces[i]] = ids.astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        out, start = [], 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= BLOCK_CHARS):
                chars += len(texts[end])
                end += 1
            split = [self.split(t) for t in texts[start:end]]
            used = set().union(*split)
            new = [p for p in used if p not in self.known]
            if len(self.known) + len(new) > CACHE:
                new = list(used)
            self._learn(new)
            get = self.known.__getitem__
            out += [b"".join(map(get, pieces)) for pieces in split]
            start = end
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


_coders: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """The worker's coder of a rank file; the file is read where it is used."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(load_ranks(path), pattern)
    return _coders[path, pattern]


def listed(ids: list[bytes]) -> dict[str, pa.Array]:
    """Ids of each text as lists, and how many there are."""
    ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
    return {"ids": lists, "n_tokens": pa.array(np.diff(ends), pa.int64())}


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of docs, and ids array<int> and n_tokens; docs' own columns of these names go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in slices(batches):
            yield with_columns(b, **listed(c.encode(texts_of(b))))

    docs = docs.drop("ids", "n_tokens")
    return docs.mapInArrow(run, extended(docs.schema, "ids array<int>, n_tokens long"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of encoded and decoded binary, from ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in slices(batches):
            ids = b.column(b.schema.get_field_index("ids")).to_numpy(zero_copy_only=False)
            yield with_columns(b, decoded=pa.array([c.decode(np.asarray(i)) for i in ids], pa.binary()))

    return encoded.mapInArrow(run, extended(encoded.schema, "decoded binary"))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of docs, and ids array<int>, n_tokens and decoded binary, by one coder in one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in slices(batches):
            ids = c.encode(texts_of(b))
            back = pa.array([c.decode(np.frombuffer(i, "<u4")) for i in ids], pa.binary())
            yield with_columns(b, **listed(ids), decoded=back)

    docs = docs.drop("ids", "n_tokens", "decoded")
    return docs.mapInArrow(run, extended(docs.schema, "ids array<int>, n_tokens long, decoded binary"))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode each text and return digests of both, so that no id leaves its worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in slices(batches):
            ids = c.encode(texts_of(b))
            back = [hashlib.sha256(c.decode(np.frombuffer(i, "<u4"))).hexdigest() for i in ids]
            yield with_columns(
                b.select(["doc_id"]),
                n_tokens=pa.array([len(i) // 4 for i in ids], pa.int64()),
                ids_sha256=pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                decoded_sha256=pa.array(back, pa.string()),
            )

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, extended([docs.schema["doc_id"]], "n_tokens long, ids_sha256 string, decoded_sha256 string"))
