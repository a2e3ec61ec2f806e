"""Declared columns of the tables that runs write and read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.raster import RASTER_FEATURES
from tilewright.functions.score import COMPOSITE_WEIGHTS

_KINDS = {"l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "s": T.StringType(), "b": T.BooleanType()}


def struct(**groups: str) -> T.StructType:
    """Columns by kind: names in one string, kind after a colon for those that aren't double."""
    fields = []
    for names in groups.values():
        for n in names.split():
            name, _, kind = n.partition(":")
            fields.append(T.StructField(name, _KINDS[kind or "d"]))
    return T.StructType(fields)


SLIDE = struct(all="slide_id:l slide_width:l slide_height:l level_count:i objective_power:s mpp_x mpp_y")
POOL = struct(all="case_id:s generation_order:i candidate_id:s extractor_index:i x_level0:l y_level0:l level:i patch_size:l")
CANDIDATE = struct(
    identity="slide_id:l candidate_id:s grid_index:i x_level0:l y_level0:l patch_size:l stride:l extractor_index:i min_mask_ratio width:l height:l thumbnail_tissue_ratio",
    state="evaluated:b scored:b nuclear_proxy:s",
    base="tissue_ratio nuclear_signal nuclear_signal_rgb nuclear_signal_hed visual_entropy blur_score artifact_penalty",
    proxies="technical_quality_score heterogeneity_score cellularity_proxy_score residual_candidate_proxy low_cellularity_treated_bed_proxy tumor_bed_relevance_proxy usefulness_score",
    terms="spatial_penalty feature_diversity_bonus redundancy_penalty",
    raster=" ".join([*RASTER_FEATURES, *COMPOSITE_WEIGHTS]),
    embedding="score_v3_base embedding_backend:s embedding_model_name:s embedding_dim:i embedding_cache_used:b embedding_cluster_id:i embedding_distance_to_cluster_centroid embedding_representativeness_score embedding_novelty_score embedding_diversity_bonus embedding_redundancy_penalty morphology_diversity_score",
    result="score_raw score_final usefulness_reason:s region_id:s region_row:i region_col:i quota_grid:s spatial_strategy:s diversity_strategy:s selected:b rank:i filename:s patch_id:s patch_path:s",
    provenance="selector:s selection_method:s seed:i source_wsi_path:s slide_width:l slide_height:l objective_power:s mpp_x mpp_y level_count:i tissue_mask_method:s clinical_warning:s",
)
#: Selected rows are found again by their place: they carry no candidate id.
SELECTED = T.StructType([f for f in CANDIDATE.fields if f.name not in ("candidate_id", "grid_index", "evaluated", "scored")])
METRIC = struct(all="metric:s baseline_value smart_value delta_smart_minus_baseline relative_delta higher_is_better:b interpretation:s")
OVERLAP = struct(all="candidate_key:s x_level0:l y_level0:l in_baseline:b in_smart:b baseline_rank:i smart_rank:i")
SEGMENTED = T.StructType(
    [
        *struct(all="slide_id:l candidate_id:s rank:i x_level0:l y_level0:l patch_id:s status:s error:s strategy:s runtime_seconds mean_max_probability median_max_probability mean_entropy median_entropy was_resized:b mpp_within:b").fields,
        T.StructField("prediction_shape", T.ArrayType(T.IntegerType())),
        T.StructField("class_pixel_counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("class_pixel_ratios", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("patch_warnings", T.ArrayType(T.StringType())),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order: missing ones null, others left out."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
