"""Exact top-k by inner product over an impact-ordered index, a score at a time.

A block of vectors is indexed by dimension: its postings are ordered by value and cut into segments of one
quantised value. Against a query, a component's impact is what it adds over the least that its dimension adds in the block, so
that impacts are never negative; a segment's impact is the largest of its postings. Segments are taken by descending quantised
impact, one level after the other, into accumulators that live as long as the query does: the impacts seen of a
vector, and of how many dimensions. With I the largest impact not yet taken, a dimension can add min(I, its largest impact) at
most, which bounds every vector from above. A score that k vectors reach is known from the blocks before and from exact scores
of the best accumulators. The query stops on proof alone: when few vectors have a bound that reaches this score, or everything is
taken; those possible members are rescored exactly. So the result is exact and recall is 1.

Queries and vectors meet in groups of fixed size, ``GROUP`` blocks of vectors and one of queries; no task holds more, and only
k rows of each query leave a group.

Arithmetic: floor(scale * x) is kept as a double, which holds it exactly. Where no sum can pass 2**53 all sums are exact in
doubles; else bounds get a slack above their rounding, and possible members are scored in integers of any length.

Defined cases: a vector that is null, or has a null or non-finite component (also one that is not finite once
scaled), takes no part, nor does a row with a null vec_id; a shorter vector has zeros at its end; ties go to the smaller
vec_id; rows that repeat a vec_id are candidates one by one, and a repeated query is asked once for each;
candidates with the query's own id are left out; a score beyond a long's range is shown as the range's end, and ranked by its true
value within a group of vectors; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of vectors and of queries, and blocks of vectors in a group.
BLOCK, QUERY_BLOCK, GROUP = 16384, 1024, 1
#: Quantised values of a dimension, quantised impacts of a query, and levels from one proof to the next.
SEGMENTS, LEVELS, PROVE = 32, 32, 3
#: Share of a block that may be rescored.
FEW = 0.35
LONG = 2**63 - 1


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """vec_id, v (array<double>): floor(scale * x) of each component; rows that take no part are left out."""
    scaled = F.transform(vector_col, lambda c: c.cast("double") * scale)
    fine = F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # floor() of a double is a long, which the largest values don't fit; from 2**53 on they are integers anyway.
    whole = F.transform(scaled, lambda c: F.when(F.abs(c) < float(2**53), F.floor(c).cast("double")).otherwise(c))
    return df.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


class Index:
    """Impact-ordered postings of a block: vectors are rows of whole numbers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n, width = vectors.shape
        by_value = np.argsort(vectors, axis=0, kind="stable").T
        self.place = by_value.ravel().copy()
        values = np.take_along_axis(vectors.T, by_value, axis=1)
        self.values = values.ravel()
        self.low, self.high = (values[:, 0], values[:, -1]) if n else (np.zeros(width), np.zeros(width))
        span = np.maximum(self.high / 2 - self.low / 2, 0.5)[:, None]
        cell = np.floor((values / 2 - self.low[:, None] / 2) / span * SEGMENTS)
        starts = np.ones((width, n), bool)
        starts[:, 1:] = cell[:, 1:] != cell[:, :-1]
        self.start = np.flatnonzero(starts)  # a segment is a run of postings of one dimension
        self.end = np.append(self.start[1:], n * width)
        self.dim = self.start // max(n, 1)
        self.largest = np.abs(vectors).max(initial=0.0)
        self.taken = self.segments = 0  # segments taken, of how many

    def _exact(self, rows: np.ndarray, q: np.ndarray, safe: bool) -> list[int] | np.ndarray:
        if safe:
            return self.vectors[rows] @ q
        whole = [int(x) for x in q]
        return [sum(int(x) * y for x, y in zip(v, whole)) for v in self.vectors[rows].tolist()]

    def top(self, q: np.ndarray, own: int, k: int, known: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
        """(-score, id) of the k best of the block and of ``known``, the best first."""
        n, width = self.vectors.shape
        other = self.ids != own
        top = width * self.largest * np.abs(q).max(initial=0.0)
        safe = bool(top < 2**52)
        slack = 0.0 if safe else top * width * 2.0**-49
        floor = float(np.where(q > 0, q * self.low, q * self.high).sum())
        most = np.abs(q) * (self.high - self.low)
        reached = -known[k - 1][0] if len(known) >= k else None  # a score that k vectors reach
        if not n or (reached is not None and floor + most.sum() + slack < reached):
            return list(known)
        weight, least = q[self.dim], np.where(q > 0, self.low, self.high)[self.dim]
        impact = np.where(weight > 0, weight * (self.values[self.end - 1] - least), weight * (self.values[self.start] - least))
        level = np.floor(impact / max(impact.max(initial=0.0), 1e-300) * LEVELS)
        level[impact == 0] = -1  # adds nothing
        order = np.lexsort((self.start, -level))[: int((level >= 0).sum())]
        self.segments += len(order)
        # Neighbouring segments of a dimension and level are one run of postings.
        kind, dim = level[order], self.dim[order]
        first = np.flatnonzero(np.append(True, (np.diff(order) != 1) | (np.diff(kind) != 0) | (np.diff(dim) != 0))) if len(order) else np.zeros(0, int)
        last = np.append(first[1:], len(order)) - 1
        begin, stop, w = self.start[order[first]], self.end[order[last]], weight[order[first]]
        base, kind, number = w * least[order[first]], kind[first], last - first + 1
        edges = np.append(np.flatnonzero(np.append(True, np.diff(kind) != 0)), len(kind)) if len(kind) else np.zeros(1, int)
        highest = np.append(np.maximum.reduceat(impact[order], first[edges[:-1]]), 0.0) if len(kind) else np.zeros(1)
        runs = list(zip(begin.tolist(), stop.tolist()))
        # Impacts and numbers of dimensions share one accumulator where both fit a double: a dimension counts one ``unit``.
        unit = 2.0 ** np.ceil(np.log2(2 * top + 2))
        unit = unit if safe and (width + 1) * unit < 2**53 else 0.0
        seen, dims = np.zeros(n), np.zeros(n, np.int64)
        possible = np.flatnonzero(other)
        for step, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            place = np.concatenate([self.place[x:y] for x, y in runs[i:j]])
            size = stop[i:j] - begin[i:j]
            gain = np.concatenate([self.values[x:y] for x, y in runs[i:j]]) * np.repeat(w[i:j], size) - np.repeat(base[i:j] - unit, size)
            seen += np.bincount(place, gain, n)
            if not unit:
                dims += np.bincount(place, minlength=n)
            self.taken += int(number[i:j].sum())
            left = float(highest[step + 1])
            if step % PROVE != PROVE - 1 and j < len(runs):
                continue
            if unit:
                dims = np.floor(seen / unit)
            bound = floor + (seen - dims * unit) + (np.minimum(most, left).sum() - dims * left)
            bound[~other] = -np.inf
            if n > 2 * k:
                best = np.argpartition(bound, n - 2 * k)[n - 2 * k :]
                best = best[other[best]]
                if len(best) >= k:
                    at_least = sorted(self._exact(best, q, safe), reverse=True)[k - 1]
                    reached = at_least if reached is None else max(reached, at_least)
            if reached is not None:
                possible = np.flatnonzero(bound + slack >= reached)
                if len(possible) <= max(2 * k, FEW * n):
                    break
        possible = possible[other[possible]]
        score = self._exact(possible, q, safe)
        if safe and len(possible) > k:
            best = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
            score, possible = score[best], possible[best]
        found = [(-int(s), i) for s, i in zip(score, self.ids[possible].tolist())]
        return sorted([*known, *found])[:k]


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    edge, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    n = np.diff(edge)
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(edge[0], edge[-1]) - np.repeat(edge[:-1], n)] = flat[edge[0] : edge[-1]]
    return out


def _search(k: int, block: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int, int]] = []
        if vectors.num_rows and queries.num_rows:
            width = max(max(t.column("size").to_pylist()) for t in (vectors, queries))
            asked = _matrix(queries.column("v"), width)
            owns = queries.column("vec_id").to_pylist()
            best: list[list[tuple[int, int]]] = [[] for _ in owns]
            for i in range(0, vectors.num_rows, block):
                part = vectors.slice(i, block)
                index = Index(part.column("vec_id").to_numpy(), _matrix(part.column("v"), width))
                best = [index.top(q, own, k, known) for q, own, known in zip(asked, owns, best)]
            for own, copy, found in zip(owns, queries.column("copy").to_pylist(), best):
                rows += [(own, copy, i, max(-LONG - 1, min(LONG, -s))) for s, i in found]
        names = ("query_id", "copy", "vec_id", "score")
        return pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK, group: int = GROUP) -> DataFrame:
    """vectors (vec_id, v) -> query_id, rank, vec_id, score: each query's k highest integer inner products."""
    vectors = vectors.withColumn("size", F.size("v"))
    queries = vectors.where(is_query).withColumn("copy", F.monotonically_increasing_id())
    n, m = vectors.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // (block * group))), max(1, -(-m // query_block))
    # Two rows share a group only by their block numbers: each vector goes to all query blocks, each query to all vector blocks.
    left = vectors.withColumn("cb", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks).cast("long"))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id", "copy"), F.lit(query_blocks)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(_search(k, block), "query_id long, copy long, vec_id long, score long")
    order = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
