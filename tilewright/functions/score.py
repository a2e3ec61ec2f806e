"""Score expressions built from weights; everything stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ["tissue_ratio", "nuclear_signal", "visual_entropy", "blur_score", "artifact_penalty"]

#: Weights of the scores.
SMART_WEIGHTS = {"tissue_ratio": 0.35, "nuclear_signal": 0.25, "visual_entropy": 0.15, "blur_score": 0.15, "artifact_penalty": -0.10}
CELLULARITY_WEIGHTS = {"nuclear_signal_hed": 0.70, "nuclear_signal_rgb": 0.30}
USEFULNESS_WEIGHTS = {
    "technical_quality_score": 0.30,
    "residual_candidate_proxy": 0.22,
    "low_cellularity_treated_bed_proxy": 0.18,
    "tumor_bed_relevance_proxy": 0.20,
    "heterogeneity_score": 0.10,
    "artifact_penalty_norm": -0.10,
}
COMPOSITE_WEIGHTS = {
    "medical_stain_quality_score": {"stain_contrast_score": 0.35, "stain_balance_score": 0.25, "hematoxylin_dynamic_range": 0.20, "eosin_dynamic_range": 0.20, "stain_saturation_penalty": -0.20, "low_contrast_penalty": -0.15},
    "medical_tissue_quality_score": {"clean_tissue_ratio": 0.50, "foreground_component_score": 0.30, "~border_tissue_penalty": 0.20, "fat_background_penalty": -0.15},
    "medical_texture_score": {"texture_entropy_score": 0.25, "local_entropy_score": 0.20, "gradient_energy_score": 0.20, "laplacian_texture_score": 0.15, "multi_scale_entropy_score": 0.10, "glcm_contrast_proxy": 0.10},
    "medical_sharpness_score": {"tenengrad_sharpness_score": 0.45, "laplacian_sharpness_score": 0.35, "~fold_or_edge_artifact_penalty": 0.20},
    "medical_pseudo_cellularity_score": {"pseudo_nuclear_density_score": 0.45, "pseudo_nuclear_component_density": 0.30, "~pseudo_nuclear_size_variability": 0.15, "pseudo_nuclear_clustering_score": 0.10},
    "medical_artifact_penalty": {"stain_saturation_penalty": 0.30, "low_contrast_penalty": 0.25, "border_tissue_penalty": 0.20, "fold_or_edge_artifact_penalty": 0.15, "extreme_intensity_penalty": 0.10},
    "medical_image_quality_score": {"medical_stain_quality_score": 0.25, "medical_tissue_quality_score": 0.25, "medical_sharpness_score": 0.20, "medical_texture_score": 0.20, "medical_artifact_penalty": -0.10},
    "medical_image_utility_score": {"medical_image_quality_score": 0.35, "medical_texture_score": 0.25, "medical_pseudo_cellularity_score": 0.20, "tumor_bed_relevance_proxy": 0.20},
}


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def weighted(weights: dict[str, float], suffix: str = "") -> Column:
    """Sum of weight * column; a name that starts with ~ stands for one minus the column."""
    total = None
    for name, w in weights.items():
        x = F.lit(1.0) - F.col(name[1:] + suffix) if name[0] == "~" else F.col(name + suffix)
        total = F.lit(w) * x if total is None else total + F.lit(w) * x
    return total


def normalise(df: DataFrame, features: list[str], by: str = "slide_id") -> DataFrame:
    """<feature>_norm by minimum and maximum of the group: 0.5 where the value is missing or the group constant.

    A window on the group: rows are dealt out by it once, and what follows on the same group needs no other exchange; a grouped aggregate joined
    back would work the rows out twice."""
    whole = Window.partitionBy(by)
    both = df.where(F.col(by).isNotNull()).withColumns({f"__{n}_{c}": f(c).over(whole) for c in features for n, f in (("lo", F.min), ("hi", F.max))})
    norm = {}
    for c in features:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        norm[f"{c}_norm"] = F.when(F.col(c).isNull() | (F.abs(hi - lo) <= 1e-12), 0.5).otherwise(clip01(F.try_divide(F.col(c) - lo, hi - lo)))
    return both.withColumns(norm).drop(*[f"__{n}_{c}" for c in features for n in ("lo", "hi")])


def smart_score(df: DataFrame, by: str = "slide_id") -> DataFrame:
    return normalise(df, FEATURES, by).withColumn("score_raw", weighted(SMART_WEIGHTS, "_norm"))


def quality_scores(df: DataFrame, by: str = "slide_id") -> DataFrame:
    """Six proxies and the usefulness score. A frame without RGB, HED or thumbnail signals gets them from the nuclear signal
    and, for the thumbnail, a missing value, which counts 0.5."""
    for name, source in (("nuclear_signal_hed", F.col("nuclear_signal")), ("nuclear_signal_rgb", F.col("nuclear_signal")), ("thumbnail_tissue_ratio", F.lit(None).cast("double"))):
        if name not in df.columns:
            df = df.withColumn(name, source)
    n = normalise(df, [*FEATURES, "nuclear_signal_hed", "nuclear_signal_rgb", "thumbnail_tissue_ratio"], by)
    c = lambda x: F.col(x)
    quiet = F.lit(1.0) - c("artifact_penalty_norm")
    n = n.withColumns(
        {
            "cellularity_proxy_score": clip01(weighted(CELLULARITY_WEIGHTS, "_norm")),
            "technical_quality_score": clip01(c("tissue_ratio_norm") * 0.42 + c("blur_score_norm") * 0.28 + quiet * 0.20 + c("thumbnail_tissue_ratio_norm") * 0.10),
            "heterogeneity_score": clip01(c("visual_entropy_norm")),
        }
    )
    cell, qual, het = c("cellularity_proxy_score"), c("technical_quality_score"), c("heterogeneity_score")
    n = n.withColumns(
        {
            "residual_candidate_proxy": clip01(cell * 0.45 + het * 0.30 + qual * 0.25),
            "low_cellularity_treated_bed_proxy": clip01(qual * (c("tissue_ratio_norm") * 0.55 + het * 0.25 + quiet * 0.20) * (F.lit(1.0) - cell * 0.75)),
        }
    )
    n = n.withColumn("tumor_bed_relevance_proxy", clip01(qual * 0.32 + c("residual_candidate_proxy") * 0.28 + c("low_cellularity_treated_bed_proxy") * 0.25 + het * 0.15))
    return n.withColumn("score_raw", clip01(weighted(USEFULNESS_WEIGHTS))).withColumn("usefulness_reason", dominant_proxy())


def dominant_proxy() -> Column:
    low, resid, het, qual = (F.col(x) for x in ("low_cellularity_treated_bed_proxy", "residual_candidate_proxy", "heterogeneity_score", "technical_quality_score"))
    return (
        F.when(low >= F.greatest(resid, het, qual), "low_cellularity_treated_bed_proxy")
        .when(resid >= F.greatest(low, het, qual), "residual_candidate_proxy")
        .when(het >= F.greatest(low, resid, qual), "heterogeneity")
        .otherwise("balanced_quality")
    )


def composite_scores(df: DataFrame) -> DataFrame:
    """The eight composite scores of raster features, each clipped; a missing tumour-bed proxy counts 0."""
    return utility_score(raster_scores(df))


def raster_scores(df: DataFrame) -> DataFrame:
    """The composite scores that need nothing but raster features: all but the utility."""
    for name, weights in COMPOSITE_WEIGHTS.items():
        if name != "medical_image_utility_score":
            df = df.withColumn(name, clip01(weighted(weights)))
    return df


def utility_score(df: DataFrame) -> DataFrame:
    """The composite score that needs others and the tumour-bed proxy, too."""
    if "tumor_bed_relevance_proxy" not in df.columns:
        df = df.withColumn("tumor_bed_relevance_proxy", F.lit(0.0))
    df = df.withColumn("tumor_bed_relevance_proxy", clip01(F.col("tumor_bed_relevance_proxy")))
    return df.withColumn("medical_image_utility_score", clip01(weighted(COMPOSITE_WEIGHTS["medical_image_utility_score"])))


def sanitise(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(frame with missing and non-finite values as 0, one row a column with the number repaired)."""
    bad = {c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in columns}
    clean = df.withColumns({c: F.when(b, 0.0).otherwise(F.col(c)) for c, b in bad.items()})
    counts = df.agg(*[F.count_if(b).alias(c) for c, b in bad.items()])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return clean, counts.selectExpr(f"stack({len(columns)}, {pairs}) as (feature, repaired)")
