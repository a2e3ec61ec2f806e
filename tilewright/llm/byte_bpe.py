"""Byte-level BPE on length-bucketed padded numpy matrices.

A text is cut by the pattern; each distinct piece is a row of a matrix of token ids, padded, with rows of like
length together. In a round every row merges its leftmost pair of least rank; pairs are looked up in a hash table
of arrays, rows close up over the merged token, and rows without a pair leave the matrix. A piece of more than
``LONGEST`` bytes is a matrix of its own, where one merge a round would be quadratic: there a round merges the places of the
least rank from left to right, up to the first whose merged token makes a pair of a lesser rank, which comes next. That is the same
order of merges.

Decoding gives bytes; ``decode`` shows them as text, with the replacement character where token ids cut a character apart.

Defined cases: a null or empty text has no tokens; rows are encoded one by one, repeated ones too; texts of any
length are encoded whole; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int32(2**31 - 1)
LONGEST = 512
CELLS = 1 << 20
#: Pieces remembered by a worker, and the longest of them; beyond that it forgets and starts again.
REMEMBERED, REMEMBERED_CHARS = 160_000, 48


class ByteBpe:
    def __init__(self, vocabulary: str, pattern: str):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = rank
        self._hash(pairs)
        self.known: dict[str, bytes] = {}

    def _hash(self, pairs: dict[tuple[int, int], int]) -> None:
        """Open addressing in two arrays, filled in rounds: of the pairs that want a free slot, one gets it."""
        bits = max(8, (4 * len(pairs)).bit_length())
        self.mask, self.shift = np.uint64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        key = np.array([a << 32 | b for a, b in pairs], np.int64)
        value = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot, self.probes = self._slot(key), 0
        while len(key):
            self.probes += 1
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = key[won], value[won]
            left = np.ones(len(key), bool)
            left[won] = False
            key, value, slot = key[left], value[left], (slot[left] + np.uint64(1)) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merged token, NONE where there is none or the right side is padding."""
        shape = left.shape
        key = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        out = np.full(key.shape, NONE, np.int32)
        todo = np.flatnonzero(right.ravel() >= 0)
        key = key[todo]
        slot = self._slot(key)
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == key
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there >= 0)
            if not on.any():
                break
            todo, key, slot = todo[on], key[on], (slot[on] + np.uint64(1)) & self.mask
        return out.reshape(shape)

    def merge_rows(self, rows: list[bytes]) -> list[np.ndarray]:
        """Token ids of pieces of about one length."""
        width = max(map(len, rows))
        m = np.full((len(rows), width), -1, np.int32)
        for i, r in enumerate(rows):
            m[i, : len(r)] = self.single[np.frombuffer(r, np.uint8)]
        out: list = [None] * len(rows)
        owner = np.arange(len(rows))
        rank = self.lookup(m[:, :-1], m[:, 1:])
        while True:
            if m.shape[1] > 1:
                at = rank.argmin(1)
                best = rank[np.arange(len(m)), at]
                live = best < NONE
            else:
                live = np.zeros(len(m), bool)
            for i in np.flatnonzero(~live):
                out[owner[i]] = m[i][m[i] >= 0]
            if not live.any():
                return out
            m, rank, owner, at, best = m[live], rank[live], owner[live], at[live], best[live]
            row = np.arange(len(m))
            m[row, at] = best
            keep = np.ones(m.shape, bool)
            keep[row, at + 1] = False
            m = m[keep].reshape(len(m), -1)
            keep = np.ones(rank.shape, bool)
            keep[row, at] = False
            rank = rank[keep].reshape(len(m), -1)
            width = m.shape[1]
            has = np.flatnonzero(at > 0)
            if len(has):
                rank[has, at[has] - 1] = self.lookup(m[has, at[has] - 1], m[has, at[has]])
            has = np.flatnonzero(at < width - 1)
            if len(has):
                rank[has, at[has]] = self.lookup(m[has, at[has]], m[has, at[has] + 1])

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Token ids of one long piece."""
        row = self.single[np.frombuffer(piece, np.uint8)]
        rank = self.lookup(row[:-1], row[1:])
        while len(rank):
            best = rank.min()
            if best == NONE:
                break
            at = np.flatnonzero(rank == best)
            first = np.concatenate([[True], np.diff(at) > 1])
            at = at[(at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0]  # of places side by side every other one
            # What each merge would meet: on its left a token, merged or not, on its right one that isn't merged yet.
            merged = np.full(len(at), best, np.int32)
            left = np.where(np.concatenate([[False], np.diff(at) == 2]), best, np.where(at > 0, row[at - 1], -1)).astype(np.int32)
            right = np.where(at + 2 < len(row), row[np.minimum(at + 2, len(row) - 1)], -1).astype(np.int32)
            urgent = (np.where(left >= 0, self.lookup(left, merged), NONE) < best) | (self.lookup(merged, right) < best)
            at = at[: int(np.argmax(urgent)) + 1] if urgent.any() else at
            row[at] = best
            stay = np.ones(len(row), bool)
            stay[at + 1] = False
            row = row[stay]
            gone = np.ones(len(rank), bool)
            gone[at] = False
            rank = rank[gone]
            new = at - np.arange(len(at))  # where the merged tokens are now
            near = np.unique(np.concatenate([new - 1, new]))
            near = near[(near >= 0) & (near < len(rank))]
            rank[near] = self.lookup(row[near], row[near + 1])
        return row

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each distinct piece as little-endian unsigned 32-bit integers."""
        raw = [p.encode() for p in pieces]
        found: list = [None] * len(raw)
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        i = 0
        while i < len(order):
            n = len(raw[order[i]])
            if n > LONGEST:
                found[order[i]] = self.merge_long(raw[order[i]])
                i += 1
                continue
            top = 1 << max(2, (n - 1).bit_length())  # lengths up to the next power of two share a matrix
            j = i
            while j < len(order) and len(raw[order[j]]) <= top and (j - i) * top < CELLS:
                j += 1
            for k, ids in zip(order[i:j], self.merge_rows([raw[k] for k in order[i:j]])):
                found[k] = ids
            i = j
        return {p: ids.astype("<u4").tobytes() for p, ids in zip(pieces, found)}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(t) for t in texts]
        known = self.known
        new = {p for pieces in cut for p in pieces if p not in known}
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = {p for pieces in cut for p in pieces}
        known.update(self.encode_pieces(list(new)))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        for p in new:
            if len(p) > REMEMBERED_CHARS:
                del known[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[tuple[str, str], ByteBpe] = {}


def codec(vocabulary: str, pattern: str) -> ByteBpe:
    """One codec per worker process."""
    if (vocabulary, pattern) not in _loaded:
        _loaded[vocabulary, pattern] = ByteBpe(vocabulary, pattern)
    return _loaded[vocabulary, pattern]


def _groups(texts: list[str], most: int = 1 << 18):
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= most:
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, token_ids (array of int) of every document row; no shuffle."""

    def run(batches):
        bpe = codec(vocabulary, pattern)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, j in _groups(texts):
                ids = bpe.encode_batch(texts[i:j])
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                n = np.array([len(x) // 4 for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").slice(i, j - i), "n_tokens": pa.array(n), "token_ids": lists})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>")


def decode(tokens: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, text of every row of ``encode``'s result."""

    def run(batches):
        bpe = codec(vocabulary, pattern)
        for b in batches:
            texts = [bpe.decode(np.array(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in b.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array(texts, pa.string())})

    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, digest of the ids, digest of the bytes they decode to: both ways in one pass."""

    def run(batches):
        bpe = codec(vocabulary, pattern)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n, ids_sha, back_sha = [], [], []
            for i, j in _groups(texts):
                for ids in bpe.encode_batch(texts[i:j]):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    back_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(back_sha, pa.string())})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
