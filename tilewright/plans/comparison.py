"""Whole comparisons: two selections of the same pools, and two segmentation runs, as named frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.parse import relative_delta
from tilewright.operators import compare, embed, stats

#: The metrics of a comparison in order, and whether more is better (None: only described).
COUNT_METRICS = ["num_candidates_generated", "num_thumbnail_candidates_passing_mask", "num_candidate_rows_written", "num_candidates_evaluated", "num_candidates_scored", "num_selected", "regions_covered", "active_regions"]
QUOTA_METRICS = ["quota_fill_rate", "mean_feature_diversity_bonus_selected"]
FIELD_METRICS = ["nuclear_proxy", "spatial_strategy", "diversity_strategy"]
OVERLAP_METRICS = ["num_overlap_selected", "overlap_ratio_baseline", "overlap_ratio_smart", "jaccard_selected"]
RECOMPUTED = ["tissue_ratio", "nuclear_signal", "nuclear_signal_rgb", "nuclear_signal_hed", "visual_entropy", "blur_score", "artifact_penalty"]
SPATIAL_METRICS = ["mean_pairwise_distance", "median_pairwise_distance", "min_pairwise_distance", "mean_nearest_neighbor_distance", "median_nearest_neighbor_distance", "min_nearest_neighbor_distance", "spatial_bbox_area", "spatial_coverage_ratio_approx"]
MEDICAL = ["medical_image_quality_score", "medical_image_utility_score", "medical_artifact_penalty", "medical_texture_score", "medical_pseudo_cellularity_score"]
CLUSTER_METRICS = ["num_embedding_clusters_covered", "selected_cluster_entropy"]
EMBEDDING_METRICS = ["mean_pairwise_embedding_distance", "median_pairwise_embedding_distance", "min_pairwise_embedding_distance"]
METRICS: list[tuple[str, bool | None]] = [
    *[(m, None) for m in COUNT_METRICS],
    ("runtime_seconds", False),
    *[(m, True) for m in QUOTA_METRICS],
    *[(m, None) for m in (*FIELD_METRICS, *OVERLAP_METRICS)],
    *[(f"mean_{f}_recomputed", f != "artifact_penalty") for f in RECOMPUTED],
    *[(f"median_{f}_recomputed", True) for f in ("nuclear_signal_rgb", "nuclear_signal_hed")],
    *[(m, True) for m in SPATIAL_METRICS],
    *[(f"mean_{f}", f != "medical_artifact_penalty") for f in MEDICAL],
    *[(m, True) for m in (*CLUSTER_METRICS, *EMBEDDING_METRICS)],
]

SHARED_FIELDS = ["patch_size", "stride", "min_mask_ratio", "slide_width", "slide_height", "mpp_x", "mpp_y", "level_count", "k", "seed"]


def selections(first: DataFrame, second: DataFrame, pool: DataFrame, configs: tuple[dict, dict] | None = None, strict: bool = False) -> dict[str, DataFrame | list[str]]:
    """overlap rows and ratios, spatial metrics, score statistics, untraceable rows, and warnings on what the runs don't share.
    Strict: a difference of the pools' digests, or a row that the pool lacks, is an error."""
    keys = ["slide_id", "candidate_id"]
    both = first.withColumn("method", F.lit("baseline")).unionByName(second.withColumn("method", F.lit("smart")))
    rows = compare.overlap_rows(first, second, keys)
    lost = compare.untraceable(both, pool, keys)
    warnings = compare.config_matches(*configs, SHARED_FIELDS)[1] if configs else []
    if configs and configs[0].get("pool_hash") != configs[1].get("pool_hash"):
        warnings.append("the pools differ")
    if strict and (warnings or not lost.isEmpty()):
        raise ValueError("; ".join(warnings) or "rows that the pool lacks")
    return {
        "overlap_rows": rows,
        "overlap": compare.overlap(rows, ["slide_id"]),
        "spatial": compare.spatial_metrics(both, ["method", "slide_id"]),
        "scores": both.groupBy("method", "slide_id").agg(*stats.describe(F.col("score_raw"))),
        "untraceable": lost,
        "warnings": warnings,
    }


def selection_metrics(first: DataFrame, second: DataFrame, slides: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """slide_id, method, metric, value (text) of two selections with their measured features and whatever else they have (rank, cluster_id,
    unit vectors, composite scores); ``summaries`` (slide_id, method, metric, value) adds what runs recorded, and goes before."""
    key = ["method", "slide_id"]
    both = first.withColumn("method", F.lit("baseline")).unionByName(second.withColumn("method", F.lit("smart")))
    there = set(both.columns)
    means = [F.avg(f).alias(f"mean_{f}_recomputed") for f in RECOMPUTED if f in there] + [F.percentile(f, F.lit(0.5)).alias(f"median_{f}_recomputed") for f in ("nuclear_signal_rgb", "nuclear_signal_hed") if f in there]
    means += [F.avg(f).alias(f"mean_{f}") for f in MEDICAL if f in there]
    wide = both.groupBy(*key).agg(F.count(F.lit(1)).alias("num_selected"), *means)
    names = {"pair_mean": "mean_pairwise_distance", "pair_median": "median_pairwise_distance", "pair_min": "min_pairwise_distance", "nn_mean": "mean_nearest_neighbor_distance", "nn_median": "median_nearest_neighbor_distance", "nn_min": "min_nearest_neighbor_distance", "bbox_area": "spatial_bbox_area"}
    spatial = compare.spatial_metrics(both, key).drop("n").withColumnsRenamed(names)
    wide = wide.join(spatial, key, "left").join(slides.select("slide_id", (F.col("slide_width") * F.col("slide_height")).alias("area")), "slide_id", "left")
    wide = wide.withColumn("spatial_coverage_ratio_approx", F.try_divide("spatial_bbox_area", "area")).drop("area")
    shared = compare.overlap(compare.overlap_rows(first, second, ["slide_id", "candidate_id"]), ["slide_id"])
    shared = shared.select("slide_id", F.col("both").alias("num_overlap_selected"), F.col("ratio_baseline").alias("overlap_ratio_baseline"), F.col("ratio_smart").alias("overlap_ratio_smart"), F.col("jaccard").alias("jaccard_selected"))
    wide = wide.join(shared, "slide_id", "left")
    if "cluster_id" in there:
        e = embed.cluster_entropy(both.withColumn("run", F.struct(*key)), "run").select(F.col("run.method").alias("method"), F.col("run.slide_id").alias("slide_id"), F.col("clusters_covered").alias("num_embedding_clusters_covered"), F.col("cluster_entropy").alias("selected_cluster_entropy"))
        wide = wide.join(e, key, "left")
    if "unit" in there:
        p = embed.cosine_pairs(both.withColumn("run", F.concat_ws(":", *key)), "run", "candidate_id").groupBy("run").agg(F.avg("distance").alias(EMBEDDING_METRICS[0]), F.percentile("distance", F.lit(0.5)).alias(EMBEDDING_METRICS[1]), F.min("distance").alias(EMBEDDING_METRICS[2]))
        wide = wide.withColumn("run", F.concat_ws(":", *key)).join(p, "run", "left").drop("run")
    found = [c for c in wide.columns if c not in key]
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in found)
    rows = wide.selectExpr("slide_id", "method", f"stack({len(found)}, {pairs}) as (metric, value)")
    if summaries is None:
        return rows
    own = summaries.select("slide_id", "method", "metric", F.col("value").cast("string").alias("value"))
    return own.unionByName(rows.join(own.select("slide_id", "method", "metric"), ["slide_id", "method", "metric"], "left_anti"))


def metric_table(values: DataFrame) -> DataFrame:
    """The 45 metrics of each slide in order, from (slide_id, method, metric, value): both values as text, and for numbers the difference,
    the relative difference, and which side is better; a metric that neither side has is ``missing``."""
    spec = values.sparkSession.createDataFrame([(i, m, up) for i, (m, up) in enumerate(METRICS)], "position int, metric string, higher_is_better boolean")
    p = values.groupBy("slide_id", "metric").pivot("method", ["baseline", "smart"]).agg(F.first("value", ignorenulls=True))
    every = values.select("slide_id").distinct().withColumn("metric", F.explode(F.array(*[F.lit(m) for m, _ in METRICS])))
    rows = every.join(F.broadcast(spec), "metric").join(p, ["slide_id", "metric"], "left")
    a, b = (F.col(c).try_cast("double") for c in ("baseline", "smart"))
    d = b - a
    good = F.when(F.col("higher_is_better"), d > 0).otherwise(d < 0)
    said = F.when(F.col("baseline").isNull() & F.col("smart").isNull(), "missing").when(F.col("higher_is_better").isNull() | d.isNull(), "descriptive").when(F.abs(d) <= 1e-12, "equal").when(good, "smart better").otherwise("baseline better")
    return rows.select("slide_id", "position", "metric", F.col("baseline").alias("baseline_value"), F.col("smart").alias("smart_value"), d.alias("delta_smart_minus_baseline"), relative_delta(b, a).alias("relative_delta"), "higher_is_better", said.alias("interpretation"))


def segmentations(rows: DataFrame) -> dict[str, DataFrame]:
    """Per-tile rows (method, status, class_pixel_counts as JSON): class table, totals, status counts."""
    counts = compare.class_counts(rows)
    status = rows.groupBy("method").pivot("status", ["completed", "failed", "skipped"]).agg(F.count(F.lit(1))).fillna(0)
    return {"classes": compare.class_comparison(counts), "totals": counts, "status": status}


def strategies(tiles: DataFrame, classes: int) -> DataFrame:
    """tiles (tile_id, strategy, class_id, ratio): each strategy's mean share of every class, a class that a tile lacks counting 0."""
    each = tiles.select("tile_id", "strategy").distinct().withColumn("class_id", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    full = each.join(tiles, ["tile_id", "strategy", "class_id"], "left")
    return full.groupBy("strategy", "class_id").agg(F.avg(F.coalesce("ratio", F.lit(0.0))).alias("mean_ratio"), F.count(F.lit(1)).alias("tiles"))
