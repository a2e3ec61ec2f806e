"""Embeddings: normalisation, distances, clusters, representativeness, caches."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """v over its length; a length of 1e-12 or less counts 1."""
    n = norm(v)
    by = F.when(n <= 1e-12, 1.0).otherwise(n)
    return F.transform(v, lambda x: x / by)


def with_unit_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``unit``; the length is a column first, else it would be worked out for each component."""
    df = df.withColumn("__n", norm(F.col(vector))).withColumn("__n", F.when(F.col("__n") <= 1e-12, 1.0).otherwise(F.col("__n")))
    return df.withColumn("unit", F.transform(vector, lambda x: x / F.col("__n"))).drop("__n")


def cosine_pairs(df: DataFrame, key: str, order: str) -> DataFrame:
    """Cosine distances (0 to 2) of all unordered pairs of a key's rows: keys hold a selection of k rows, not a corpus."""
    u = with_unit_vectors(df).select(key, order, "unit")
    a, b = u.alias("a"), u.alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{order}") < F.col(f"b.{order}")))
    d = F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.lit(1.0) - dot(F.col("a.unit"), F.col("b.unit"))))
    return pairs.select(F.col(f"a.{key}").alias(key), F.col(f"a.{order}").alias("i"), F.col(f"b.{order}").alias("j"), d.alias("distance"))


def nearest(pairs: DataFrame, key: str) -> DataFrame:
    """Each row's least distance to another."""
    both = pairs.select(key, "i", "distance").unionByName(pairs.select(key, F.col("j").alias("i"), "distance"))
    return both.groupBy(key, "i").agg(F.min("distance").alias("nearest"))


#: Rows of a selection that goes to every task.
MOST_SELECTED = 10_000


def against_selected(df: DataFrame, chosen: DataFrame, by: str | None = None) -> DataFrame:
    """Least cosine distance and largest similarity to a selection; 1 and 0 where there is none. With no key the selection is one row:
    an array of vectors of k rows; more than ``MOST_SELECTED`` are no selection."""
    if not by and chosen.limit(MOST_SELECTED + 1).count() > MOST_SELECTED:
        raise ValueError(f"a selection has at most {MOST_SELECTED} rows")
    chosen_u = with_unit_vectors(chosen).select(*([by] if by else []), F.col("unit").alias("s"))
    grouped = (chosen_u.groupBy(by) if by else chosen_u.groupBy()).agg(F.collect_list("s").alias("set"))
    u = with_unit_vectors(df)
    joined = u.join(grouped, by, "left") if by else u.join(F.broadcast(grouped))
    most = F.array_max(F.transform("set", lambda s: dot(F.col("unit"), s)))
    most = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), most))
    return joined.withColumns({"max_similarity": F.coalesce(most, F.lit(0.0)), "min_distance": F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.lit(1.0) - most)), F.lit(1.0))}).drop("set")


def centroids(df: DataFrame, cluster: str = "cluster_id", vector: str = "unit") -> DataFrame:
    """Mean vector of each cluster, normalised: components are exploded, so that no cluster's vectors gather in one place. The outer form keeps Spark
    from a filter of its own on the vector's size, which would work a length out again for each component."""
    parts = df.select(cluster, F.posexplode_outer(vector).alias("i", "x")).where("i is not null").groupBy(cluster, "i").agg(F.avg("x").alias("m"))
    mean = parts.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))
    return with_unit_vectors(mean).select(cluster, F.col("unit").alias("centroid"))


def representativeness(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Adds distance_to_centroid and representativeness, one minus the distance scaled to the whole frame (1 where constant)."""
    u = with_unit_vectors(df)
    d = F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.lit(1.0) - dot(F.col("unit"), F.col("centroid"))))
    u = u.join(centroids(u, cluster), cluster).withColumn("distance_to_centroid", d)
    ends = u.agg(F.min("distance_to_centroid").alias("lo"), F.max("distance_to_centroid").alias("hi"))
    u = u.join(F.broadcast(ends))
    rep = F.when(F.abs(F.col("hi") - F.col("lo")) <= 1e-12, 1.0).otherwise(F.lit(1.0) - F.try_divide(F.col("distance_to_centroid") - F.col("lo"), F.col("hi") - F.col("lo")))
    return u.withColumn("representativeness", rep).drop("lo", "hi")


def cluster_summary(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Rows, picks, and mean scores of each cluster; keys as text."""
    return df.groupBy(F.col(cluster).cast("string").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.count_if("selected").alias("n_selected"), F.avg("representativeness").alias("mean_representativeness"), F.avg("distance_to_centroid").alias("mean_distance"))


def cluster_entropy(df: DataFrame, key: str, cluster: str = "cluster_id") -> DataFrame:
    """Clusters that the rows cover and the entropy of their shares, over log2 of their number (1 cluster: divisor 1)."""
    n = df.groupBy(key, cluster).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(key))
    e = n.withColumn("p", share).groupBy(key).agg(F.count(F.lit(1)).alias("clusters_covered"), (-F.sum(F.col("p") * F.log2("p"))).alias("h"))
    return e.select(key, "clusters_covered", (F.col("h") / F.when(F.col("clusters_covered") > 1, F.log2(F.col("clusters_covered"))).otherwise(1.0)).alias("cluster_entropy"))


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size <= 1e-12, 1.0, size)


def farthest_first(unit: np.ndarray, k: int, first: int) -> np.ndarray:
    """Places of k rows: each is, of the rows not taken, the one least like its likest taken row."""
    likest, taken = np.full(len(unit), -np.inf), np.zeros(0, int)
    for _ in range(k):
        taken = np.append(taken, first)
        likest = np.maximum(likest, unit @ unit[first])
        likest[taken] = np.inf
        first = int(np.argmin(likest))
    return taken


def kmeans_small(vectors: np.ndarray, k: int, seed: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Cosine k-means of a pool that fits one task, from a seeded row and those farthest from it; sums of members by a product with their
    membership. An empty cluster keeps its centre. Returns labels and unit centres."""
    unit = _unit(np.asarray(vectors, float))
    k = min(k, len(unit))
    centres = unit[farthest_first(unit, k, int(np.random.default_rng(seed).integers(0, len(unit))))]
    for _ in range(rounds):
        label = np.argmax(unit @ centres.T, axis=1)
        member = label == np.arange(k)[:, None]
        n = member.sum(1, keepdims=True)
        centres = np.where(n > 0, _unit(member @ unit / np.maximum(n, 1)), centres)
    return label, centres


def kmeans_per_group(df: DataFrame, k: int, seed: int, by: str) -> DataFrame:
    """cluster_id of each row by ``kmeans_small`` within its group, a slide's capped pool."""

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("candidate_id", kind="stable")
        return pd.DataFrame({by: g[by], "candidate_id": g["candidate_id"], "cluster_id": kmeans_small(np.stack(g["embedding"].to_numpy()), k, seed)[0].astype("int32")})

    return df.select(by, "candidate_id", "embedding").groupBy(by).applyInPandas(kernel, f"{by} long, candidate_id string, cluster_id int")


def kmeans(df: DataFrame, k: int, seed: int) -> DataFrame:
    """Clusters of a whole table by Spark's distributed k-means with cosine distance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("features", array_to_vector("embedding"))
    return KMeans(k=k, seed=seed, distanceMeasure="cosine", predictionCol="cluster_id").fit(rows).transform(rows).drop("features")


class Embedder(Protocol):
    """An embedding model: built once in each worker, then called with a batch of (h, w, 3) rasters."""

    name: str
    dim: int

    def __call__(self, tiles: list[np.ndarray]) -> np.ndarray: ...


class ColourEmbedder:
    """A deterministic stand-in: colour moments over a grid of cells."""

    name, dim = "colour-moments", 54

    def __call__(self, tiles: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(tiles), self.dim))
        for i, t in enumerate(tiles):
            cells = [c for band in np.array_split(t.astype(float) / 255, 3, 0) for c in np.array_split(band, 3, 1)]
            out[i] = np.concatenate([np.concatenate([c.mean((0, 1)), c.std((0, 1))]) for c in cells])
        return out


def embed_missing(tiles: DataFrame, cache: DataFrame | None, embedder: Embedder) -> DataFrame:
    """candidate_id, embedding of all tiles (candidate_id, h, w, rgb): those of the cache, and the rest computed in Arrow batches."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            pictures = [np.frombuffer(x, np.uint8).reshape(h, w, 3) for x, h, w in zip(*(b.column(c).to_pylist() for c in ("rgb", "h", "w")))]
            yield pa.RecordBatch.from_pydict({"candidate_id": b.column("candidate_id"), "embedding": pa.array(list(embedder(pictures)), pa.list_(pa.float64()))})

    todo = tiles if cache is None else tiles.join(cache.select("candidate_id"), "candidate_id", "left_anti")
    new = todo.select("candidate_id", "h", "w", "rgb").mapInArrow(run, "candidate_id string, embedding array<double>")
    return new if cache is None else cache.join(tiles.select("candidate_id"), "candidate_id", "left_semi").select("candidate_id", "embedding").unionByName(new)


def cache_fault(cache: DataFrame, ids: DataFrame, meta: dict, expected: dict, dim: int) -> str | None:
    """Why a cache can't be used, or None: the first of backend, model, metric, ids in order, dimension."""
    for name in ("embedding_backend", "embedding_model_name", "embedding_distance_metric"):
        if meta.get(name) != expected.get(name):
            return f"{name} is {meta.get(name)!r}, not {expected.get(name)!r}"
    both = cache.select(F.col("position"), F.col("candidate_id").alias("c"), F.size("embedding").alias("n")).join(ids.select("position", "candidate_id"), "position", "full")
    bad = both.agg(F.count_if(~F.col("c").eqNullSafe(F.col("candidate_id"))).alias("ids"), F.count_if(F.col("n") != dim).alias("dim")).first()
    if bad["ids"]:
        return "candidate ids differ"
    return "vectors have another dimension" if bad["dim"] else None


def distance_checks(df: DataFrame, key: str, i: str, tolerance: float = 2e-6) -> DataFrame:
    """Whether each group's cosine distances make sense: two vectors at least, all finite, none null; and over all pairs of the group, itself
    included: symmetric, zero on the diagonal, within 0 and 2. Groups are selections, a few rows each."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = with_unit_vectors(df.withColumns({"finite": finite, "null_vector": F.coalesce(norm(F.col("embedding")) <= 1e-12, F.lit(True))}))
    group = rows.groupBy(key).agg((F.count(F.lit(1)) >= 2).alias("enough"), F.bool_and("finite").alias("all_finite"), (F.count_if("null_vector") == 0).alias("no_null_vector"))
    side = lambda n: rows.select(key, F.col(i).alias(f"i{n}"), F.col("unit").alias(f"u{n}"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    pairs = side(1).join(side(2), key).select(key, "i1", "i2", (1 - dot("u1", "u2")).alias("d"), (1 - dot("u2", "u1")).alias("e"))
    sane = pairs.groupBy(key).agg(
        F.bool_and(F.abs(F.col("d") - F.col("e")) <= tolerance).alias("symmetric"),
        F.bool_and((F.col("i1") != F.col("i2")) | (F.abs("d") <= tolerance)).alias("diagonal_zero"),
        F.bool_and(~F.isnan("d") & F.col("d").between(-tolerance, 2 + tolerance)).alias("bounds_valid"),
    )
    return group.join(sane, key)
