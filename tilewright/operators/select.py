"""Selection of a few tiles a slide.

Where no term depends on what was picked before, selection is a window (:func:`quota_top`). Otherwise picks follow one
another, and a slide is one group of a kernel that keeps, for every row, its largest proximity to a pick, its least
feature distance, its largest similarity and the picks in its cluster; a pick updates them in one pass, so k picks of n rows cost
k * n and not k * k * n. A group holds the scored rows of a slide, which the selectors cap (300 to 2000)."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SMART_FIELDS = [f"{c}_norm" for c in ("tissue_ratio", "nuclear_signal", "visual_entropy", "blur_score", "artifact_penalty")]


def with_regions(df: DataFrame, width: str = "slide_width", height: str = "slide_height", rows: int = 4, cols: int = 4, tile: str = "patch_size") -> DataFrame:
    """region_row, region_col, region_id of the tile's centre; ids sort as text."""
    cx, cy = F.col("x_level0") + F.col(tile) / 2, F.col("y_level0") + F.col(tile) / 2
    place = lambda c, size, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(c / F.col(size) * n).cast("int")))
    df = df.withColumns({"region_row": place(cy, height, rows), "region_col": place(cx, width, cols)})
    return df.withColumn("region_id", F.concat(F.lit("r"), F.col("region_row"), F.lit("_c"), F.col("region_col")))


def parse_grid(text: str) -> tuple[int, int]:
    """'4x4' as (rows, columns); any case, blanks around."""
    a, _, b = text.strip().lower().partition("x")
    rows, cols = int(a), int(b)
    if rows <= 0 or cols <= 0:
        raise ValueError("grid needs positive rows and columns")
    return rows, cols


def quota_top(df: DataFrame, k: int, score: str = "score_raw", by: str = "slide_id") -> DataFrame:
    """Round robin over the regions of a slide, the best row of a region each turn: by turn, then region."""
    turn = Window.partitionBy(by, "region_id").orderBy(F.desc(score), "candidate_id")
    order = Window.partitionBy(by).orderBy("turn", "region_id")
    return df.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("turn")


def top_k(df: DataFrame, k: int, order: list, by: str = "slide_id") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Terms:
    """Weights of the terms that depend on earlier picks, how regions are used, and whether the rest, which isn't picked, is returned as well."""

    k: int = 16
    spatial: float = 0.15
    scale: float = 1024.0
    diversity: float = 0.0
    redundancy: float = 0.0
    embedding: float = 0.0
    similarity: float = 0.0
    cluster: float = 0.0
    representative: float = 0.0
    round_robin: bool = False
    fill: bool = False
    fields: tuple[str, ...] = field(default=())
    rest: bool = True

    def __post_init__(self):
        if self.k <= 0 or self.scale <= 0:
            raise ValueError("k and scale must be positive")
        if min(self.spatial, self.diversity, self.redundancy, self.embedding, self.similarity, self.cluster, self.representative) < 0:
            raise ValueError("weights must not be negative")

    def document(self) -> dict:
        return asdict(self)


class Picks:
    """What each row of a slide gains or loses by the picks so far."""

    def __init__(self, base, x, y, terms: Terms, features=None, vectors=None, cluster=None, representative=None):
        n = len(base)
        self.terms, self.base, self.x, self.y = terms, base, x, y
        self.features = np.zeros((n, 0)) if features is None else features
        self.vectors = vectors
        self.cluster = np.zeros(n, np.int64) if cluster is None else np.unique(cluster, return_inverse=True)[1]
        self.rep = np.zeros(n) if representative is None else representative
        self.near = np.zeros(n)
        self.apart = np.full(n, np.inf)
        self.alike = np.full(n, -1.0)
        self.held = np.zeros(int(self.cluster.max()) + 1 if n else 1)
        self.count = 0

    def parts(self, rows: np.ndarray | slice = slice(None)) -> dict[str, np.ndarray]:
        """The terms of these rows."""
        some, near = self.count > 0, self.near[rows]
        zero = np.zeros(len(near))
        apart = self.apart[rows] if some and self.features.shape[1] else zero
        balance = 1.0 / (1.0 + self.held[self.cluster[rows]])
        alike = np.clip(self.alike[rows], -1.0, 1.0)
        novel = np.clip(1.0 - alike, 0.0, 2.0) if some and self.vectors is not None else zero
        return {
            "spatial_penalty": near if some else zero,
            "feature_diversity_bonus": apart,
            "redundancy_penalty": 1.0 - np.minimum(1.0, apart) if some else zero,
            "embedding_diversity_bonus": novel,
            "embedding_redundancy_penalty": np.maximum(0.0, alike) if some and self.vectors is not None else zero,
            "cluster_balance": balance,
            "morphology_diversity_score": np.clip(0.45 * novel + 0.30 * balance + 0.25 * self.rep[rows], 0.0, 1.0),
        }

    def score(self, p: dict[str, np.ndarray], rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        t = self.terms
        s = self.base[rows] - t.spatial * p["spatial_penalty"]
        s = s - t.redundancy * p["redundancy_penalty"] + t.diversity * p["feature_diversity_bonus"]
        s = s + t.embedding * p["embedding_diversity_bonus"] - t.similarity * p["embedding_redundancy_penalty"]
        return s + t.cluster * p["cluster_balance"] + t.representative * self.rep[rows]

    def add(self, i: int) -> None:
        away = np.sqrt((self.x - self.x[i]) ** 2 + (self.y - self.y[i]) ** 2)
        self.near = np.maximum(self.near, np.exp(-away / self.terms.scale))
        if self.features.shape[1]:
            self.apart = np.minimum(self.apart, np.sqrt(((self.features - self.features[i]) ** 2).mean(1)))
        if self.vectors is not None:
            self.alike = np.maximum(self.alike, np.einsum("ij,j->i", self.vectors, self.vectors[i]))  # equal rows alike to the bit, which BLAS does not have
        self.held[self.cluster[i]] += 1
        self.count += 1


def run_picks(ids: np.ndarray, eligible: np.ndarray, reserve: np.ndarray, regions: np.ndarray, picks: Picks) -> list[tuple[int, float, dict[str, float]]]:
    """(row, score, terms) in order of picking. Best: the highest score, ties to the smaller id."""
    t, out = picks.terms, []
    order = np.argsort(ids, kind="stable")
    open_ = eligible.copy()

    def take(among: np.ndarray) -> bool:
        rows = order[among[order]]
        if not len(rows):
            return False
        p = picks.parts(rows)  # of the region in turn alone
        s = picks.score(p, rows)
        best = int(np.argmax(s))
        i = int(rows[best])
        out.append((i, float(s[best]), {k: float(v[best]) for k, v in p.items()}))
        picks.add(i)
        open_[i] = False
        return True

    if t.round_robin:
        names = sorted(set(regions[open_].tolist()))
        members = [regions == name for name in names]
        turn, idle = 0, 0
        while names and len(out) < t.k and idle < len(names):
            idle = 0 if take(open_ & members[turn % len(names)]) else idle + 1
            turn += 1
        if not t.fill:
            return out
        open_ = reserve.copy()
        open_[[i for i, *_ in out]] = False
    while len(out) < t.k and take(open_):
        pass
    return out


PARTS = ["spatial_penalty", "feature_diversity_bonus", "redundancy_penalty", "embedding_diversity_bonus", "embedding_redundancy_penalty", "cluster_balance", "morphology_diversity_score"]
OUT = "slide_id long, candidate_id string, selected boolean, rank int, score_final double, " + ", ".join(f"{p} double" for p in PARTS)


def pick(df: DataFrame, terms: Terms, base: str = "score_raw", by: str = "slide_id", vectors: str | None = None) -> DataFrame:
    """One row for each of the input: picked or not, its rank, and its terms: at the pick for the picked, against all picks for the rest, which ``terms``
    may leave out.

    Reads by, candidate_id, x_level0, y_level0, patch_size, the base score, the terms' fields, and where they are there region_id,
    eligible, reserve, cluster_id, representativeness and the vectors."""
    optional = [c for c in ("region_id", "eligible", "reserve", "cluster_id", "representativeness", vectors) if c and c in df.columns]
    cols = list(dict.fromkeys([by, "candidate_id", "x_level0", "y_level0", "patch_size", base, *terms.fields, *optional]))

    def picked(n: int, g: dict[str, np.ndarray]) -> tuple[list[tuple[int, float, dict[str, float]]], Picks]:
        number = lambda c: np.where(np.isnan(v := g[c].astype(float)), 0.0, v)
        get = lambda c, d: g[c] if c in g else np.full(n, d)
        half = g["patch_size"].astype(float) / 2
        features = np.stack([number(f) for f in terms.fields], 1) if terms.fields else None
        e = np.stack(g[vectors]).astype(float) if vectors and n else None
        p = Picks(number(base), g["x_level0"] + half, g["y_level0"] + half, terms, features, e, get("cluster_id", 0), number("representativeness") if "representativeness" in g else None)
        eligible = get("eligible", True).astype(bool)
        reserve = get("reserve", False).astype(bool) if "reserve" in g else (eligible if eligible.sum() else np.ones(n, bool))
        return run_picks(np.arange(n), eligible, reserve, get("region_id", ""), p), p

    def only_picks(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [(c, "ascending") for c in ("candidate_id", "y_level0", "x_level0")])).combine_chunks()
        found, _ = picked(len(t), {c: t.column(c).to_numpy() for c in t.column_names})
        rows = t.select([by, "candidate_id"]).take(pa.array([i for i, *_ in found], pa.int64()))
        values = [pa.array(x) for x in (np.ones(len(found), bool), np.arange(1, len(found) + 1, dtype=np.int32), np.array([s for _, s, _ in found], float), *(np.array([v[c] for *_, v in found], float) for c in PARTS))]
        return pa.table([*rows.columns, *values], names=[by, "candidate_id", "selected", "rank", "score_final", *PARTS])

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["candidate_id", "y_level0", "x_level0"], kind="stable").reset_index(drop=True)
        n = len(g)
        found, p = picked(n, {c: g[c].to_numpy() for c in g.columns})
        late = p.parts()
        values = {"score_final": p.score(late), **{k: np.array(v, float) for k, v in late.items()}}
        rank = np.zeros(n, np.int32)
        for r, (i, s, at_pick) in enumerate(found, 1):
            rank[i] = r
            values["score_final"][i] = s
            for name, v in at_pick.items():
                values[name][i] = v
        ranks = pd.arrays.IntegerArray(rank, rank == 0)
        return pd.DataFrame({by: g[by], "candidate_id": g["candidate_id"], "selected": rank > 0, "rank": ranks, "score_final": values["score_final"], **{c: values[c] for c in PARTS}})

    groups, out = df.select(*cols).groupBy(by), OUT.replace("slide_id", by, 1)
    return groups.applyInPandas(kernel, out) if terms.rest else groups.applyInArrow(only_picks, out)


def rescored(df: DataFrame, chosen: DataFrame, spatial: float, scale: float, base: str = "score_raw", by: str = "slide_id") -> DataFrame:
    """The rows not chosen, against the whole final set: a slide's picks (k) are one array, met by one join; no row is multiplied."""
    picks = chosen.groupBy(by).agg(F.collect_list(F.struct("candidate_id", "x_level0", "y_level0")).alias("picks"))
    away = lambda p: F.sqrt(F.pow(F.col("x_level0") - p["x_level0"], 2) + F.pow(F.col("y_level0") - p["y_level0"], 2))
    rest = df.select(by, "candidate_id", "x_level0", "y_level0", base).join(picks, by).where(~F.exists("picks", lambda p: p["candidate_id"] == F.col("candidate_id")))
    near = rest.select(by, "candidate_id", base, F.array_max(F.transform("picks", lambda p: F.exp(-away(p) / scale))).alias("spatial_penalty"))
    return near.withColumn("score_final", F.col(base) - F.lit(spatial) * F.col("spatial_penalty"))


def shuffled_rank(seed: int, n: int) -> list[int]:
    """Rank of each ordinal after CPython's seeded shuffle of range(n)."""
    import random

    order = list(range(n))
    random.Random(seed).shuffle(order)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    return rank


def uniform(df: DataFrame, k: int, seed: int = 42, by: str = "slide_id") -> DataFrame:
    """The first k rows of each slide's pool after a seeded shuffle, in order of candidate_id before it."""

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("candidate_id", kind="stable")
        r = np.array(shuffled_rank(seed, len(g)))
        return g.assign(rank=(r + 1).astype("int32"))[r < k]

    cols = df.select(by, "candidate_id", "x_level0", "y_level0")
    return cols.groupBy(by).applyInPandas(kernel, f"{by} long, candidate_id string, x_level0 long, y_level0 long, rank int")


@lru_cache(maxsize=16)
def drawn(seed: int, n: int, cap: int) -> np.ndarray:
    """Which of n ordinals are among the first cap after a seeded shuffle."""
    return np.array(shuffled_rank(seed, n)) < cap


def seeded_sample(df: DataFrame, cap: int, seed: int = 42, by: str = "slide_id") -> DataFrame:
    """The first cap rows of each slide's pool after a seeded shuffle (CPython's order), in order of candidate_id before it; 0 keeps all. Rows are
    numbered in a window and kept by number, so that they aren't joined with the sample; the shuffle is of numbers, once for each size of pool."""
    if cap <= 0:
        return df

    @F.pandas_udf("boolean")
    def kept(i: pd.Series, n: pd.Series) -> pd.Series:
        out, i, n = np.ones(len(i), bool), i.to_numpy(), n.to_numpy()
        for size in np.unique(n[n > cap]):
            out[n == size] = drawn(seed, int(size), cap)[i[n == size]]
        return pd.Series(out)

    pool = Window.partitionBy(by)
    order = [c for c in ("candidate_id", "y_level0", "x_level0") if c in df.columns]
    rows = df.withColumns({"__i": F.row_number().over(pool.orderBy(*order)) - 1, "__n": F.count(F.lit(1)).over(pool)})
    return rows.where(kept("__i", "__n")).drop("__i", "__n")


def sample_by_hash(df: DataFrame, cap: int, seed: int = 42, by: str = "slide_id") -> DataFrame:
    """At most cap rows a slide by a seeded hash: the sample for pools too large to shuffle in one place; 0 keeps all."""
    if cap <= 0:
        return df
    order = Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), "candidate_id"), "candidate_id")
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= cap).drop("__r")
