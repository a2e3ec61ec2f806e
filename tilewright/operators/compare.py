"""Comparison of two selections of a slide, and of two segmentation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.parse import json_counts, relative_delta


def overlap_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full join of two selections on their keys, coordinates of the first before those of the second."""
    x = a.select(*keys, F.col("x_level0").alias("ax"), F.col("y_level0").alias("ay"), F.col("rank").alias("baseline_rank"))
    y = b.select(*keys, F.col("x_level0").alias("bx"), F.col("y_level0").alias("by"), F.col("rank").alias("smart_rank"))
    return x.join(y, keys, "full").select(*keys, F.coalesce("ax", "bx").alias("x_level0"), F.coalesce("ay", "by").alias("y_level0"), F.col("baseline_rank").isNotNull().alias("in_baseline"), F.col("smart_rank").isNotNull().alias("in_smart"), "baseline_rank", "smart_rank")


def overlap(rows: DataFrame, by: list[str]) -> DataFrame:
    g = rows.groupBy(*by).agg(F.count_if(F.col("in_baseline") & F.col("in_smart")).alias("both"), F.count(F.lit(1)).alias("either"), F.count_if("in_baseline").alias("n_baseline"), F.count_if("in_smart").alias("n_smart"))
    return g.withColumns({"jaccard": F.try_divide("both", "either"), "ratio_baseline": F.try_divide("both", "n_baseline"), "ratio_smart": F.try_divide("both", "n_smart")})


def spatial_metrics(chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Bounding box, pair distances and nearest-neighbour distances of each selection of k rows."""
    c = chosen.select(*keys, "candidate_id", (F.col("x_level0") + F.col("patch_size") / 2).alias("cx"), (F.col("y_level0") + F.col("patch_size") / 2).alias("cy"))
    box = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), ((F.max("cx") - F.min("cx")) * (F.max("cy") - F.min("cy"))).alias("bbox_area"))
    a, b = c.alias("a"), c.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a.candidate_id") != F.col("b.candidate_id")]
    away = F.sqrt(F.pow(F.col("a.cx") - F.col("b.cx"), 2) + F.pow(F.col("a.cy") - F.col("b.cy"), 2))
    both = a.join(b, on).select(*[F.col(f"a.{k}") for k in keys], F.col("a.candidate_id").alias("i"), (F.col("a.candidate_id") < F.col("b.candidate_id")).alias("once"), away.alias("d"))
    near = both.groupBy(*keys, "i").agg(F.min("d").alias("nn"))
    nn = near.groupBy(*keys).agg(F.avg("nn").alias("nn_mean"), F.percentile("nn", F.lit(0.5)).alias("nn_median"), F.min("nn").alias("nn_min"))
    pairs = both.where("once").groupBy(*keys).agg(F.avg("d").alias("pair_mean"), F.percentile("d", F.lit(0.5)).alias("pair_median"), F.min("d").alias("pair_min"))
    return box.join(pairs, keys, "left").join(nn, keys, "left")


def metric_rows(values: DataFrame, spec: DataFrame, method: str = "method") -> DataFrame:
    """values (method, metric, value) beside the list of metrics: both values, difference, relative difference, and how to read it."""
    p = values.groupBy("metric").pivot(method, ["baseline", "smart"]).agg(F.first("value"))
    d = F.col("smart") - F.col("baseline")
    good = F.when(F.col("higher_is_better"), d > 0).otherwise(d < 0)
    said = F.when(d.isNull(), "missing").when(F.abs(d) <= 1e-12, "equal").when(good, "smart better").otherwise("baseline better")
    return F.broadcast(spec).join(p, "metric", "left").select("metric", F.col("baseline").alias("baseline_value"), F.col("smart").alias("smart_value"), d.alias("delta_smart_minus_baseline"), relative_delta(F.col("smart"), F.col("baseline")).alias("relative_delta"), "higher_is_better", said.alias("interpretation"))


def untraceable(chosen: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """Chosen rows without exactly one row of the pool."""
    n = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("pool_rows"))
    return chosen.join(n, keys, "left").withColumn("pool_rows", F.coalesce("pool_rows", F.lit(0))).where("pool_rows <> 1")


def recovered_ids(chosen: DataFrame, pool: DataFrame, by: list[str]) -> DataFrame:
    """candidate_id of chosen rows that lost it: the pool's at the place (the last, if several), else the row's own, else x..._y...."""
    at = [*by, "x_level0", "y_level0"]
    there = pool.groupBy(*at).agg(F.max("candidate_id").alias("found"))
    name = F.concat(F.lit("x"), F.col("x_level0"), F.lit("_y"), F.col("y_level0"))
    own = F.col("candidate_id") if "candidate_id" in chosen.columns else F.lit(None).cast("string")
    return chosen.join(there, at, "left").withColumn("candidate_id", F.coalesce("found", own, name)).drop("found")


def same_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on one side alone, as sets: 0 and 0 where equal."""
    return _sides(a.distinct().exceptAll(b.distinct()), b.distinct().exceptAll(a.distinct()))


def same_multisets(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sides(a.exceptAll(b), b.exceptAll(a))


def _sides(left: DataFrame, right: DataFrame) -> DataFrame:
    both = left.select(F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(F.lit(0).alias("l"), F.lit(1).alias("r")))
    g = both.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("only_first"), F.coalesce(F.sum("r"), F.lit(0)).alias("only_second"))
    return g.withColumn("equal", (F.col("only_first") == 0) & (F.col("only_second") == 0))


def config_matches(a: dict, b: dict, fields: list[str]) -> tuple[dict[str, bool], list[str]]:
    """Which fields two runs share, and a warning for each they don't."""
    same = {f: a.get(f) == b.get(f) for f in fields}
    return same, [f"{f} differs: {a.get(f)!r} and {b.get(f)!r}" for f, ok in same.items() if not ok]


def class_counts(rows: DataFrame, cell: str = "class_pixel_counts", keys: list[str] = ["method"]) -> DataFrame:  # noqa: B006
    """Pixels of each class over rows of JSON cells."""
    each = rows.where("status = 'completed'").select(*keys, F.explode(json_counts(F.col(cell))).alias("class_id", "pixels"))
    return each.groupBy(*keys, "class_id").agg(F.sum("pixels").alias("pixels"))


def class_comparison(counts: DataFrame) -> DataFrame:
    """Both methods' counts and shares of each class; 0 for one that a method lacks."""
    p = counts.groupBy("class_id").pivot("method", ["baseline", "smart"]).agg(F.sum("pixels")).fillna(0, ["baseline", "smart"])
    all_ = Window.partitionBy()  # as many rows as classes
    p = p.withColumns({"baseline_ratio": F.try_divide("baseline", F.sum("baseline").over(all_)), "smart_ratio": F.try_divide("smart", F.sum("smart").over(all_))})
    return p.select("class_id", F.col("baseline").alias("baseline_pixel_count"), F.col("smart").alias("smart_pixel_count"), "baseline_ratio", "smart_ratio", (F.col("smart_ratio") - F.col("baseline_ratio")).alias("delta_smart_minus_baseline"), relative_delta(F.col("smart_ratio"), F.col("baseline_ratio")).alias("relative_delta"))


def dominant_class(counts: Column) -> Column:
    """Class with most pixels of a map; ties to the highest class."""
    pairs = F.transform(F.map_entries(counts), lambda e: F.struct(e["value"].alias("n"), e["key"].try_cast("int").alias("k")))
    return F.array_max(pairs)["k"].cast("string")


def recommendation(agreement: Column, seam_ratio: Column, uncovered: Column, seam_better: Column) -> Column:
    """Which stitching to use, from the share of pixels that disagree, the cost ratio, uncovered pixels, and whether the
    overlapping seams are below nine tenths of the others."""
    return (
        F.when(uncovered.isNull(), "inconclusive")
        .when(uncovered > 0, "no_overlap")
        .when(agreement.isNull(), "inconclusive")
        .when((agreement < 0.01) & (seam_ratio.isNull() | (seam_ratio > 1.5)), "no_overlap")
        .when(seam_better & (seam_ratio.isNull() | (seam_ratio < 3.5)), "overlap_aware")
        .when(agreement < 0.03, "similar")
        .otherwise("inconclusive")
    )


def class_legend(counts: DataFrame, names: DataFrame, colours: int = 8) -> DataFrame:
    """Observed and known classes with name, pixels and share, and the place in the palette; a class without a name is ``class <id>``."""
    both = counts.join(F.broadcast(names), "class_id", "full")
    n = F.coalesce("pixels", F.lit(0))
    share = F.try_divide(n, F.sum(n).over(Window.partitionBy()))  # as many rows as classes
    return both.select("class_id", F.coalesce("name", F.concat(F.lit("class "), F.col("class_id").cast("string"))).alias("name"), n.cast("long").alias("pixels"), share.alias("ratio"), F.pmod("class_id", F.lit(colours)).cast("int").alias("palette_index"))


def slide_dimensions(summary: DataFrame, rows: DataFrame, by: str = "slide_id") -> DataFrame:
    """slide_width, slide_height of each slide in ``rows``: the summary's if it has both, else the first that the rows (in order of ``position``) have of
    each, if they have both, else how far their tiles reach, 1 at least. 0 counts as missing."""
    real = lambda c: F.nullif(F.col(c).cast("double"), F.lit(0.0))
    first = lambda c: F.min_by(real(c), F.when(real(c).isNotNull(), F.col("position")))
    reach = lambda c: F.greatest(F.lit(1.0), F.max(F.col(c) + F.coalesce("patch_size", F.lit(0)))).cast("double")
    seen = rows.groupBy(by).agg(first("slide_width").alias("w1"), first("slide_height").alias("h1"), reach("x_level0").alias("w2"), reach("y_level0").alias("h2"))
    both = seen.join(summary.select(by, real("slide_width").alias("w0"), real("slide_height").alias("h0")), by, "left")
    known, told = F.col("w0").isNotNull() & F.col("h0").isNotNull(), F.col("w1").isNotNull() & F.col("h1").isNotNull()
    pick = lambda a, b, c: F.when(known, F.col(a)).when(told, F.col(b)).otherwise(F.col(c))
    return both.select(by, pick("w0", "w1", "w2").alias("slide_width"), pick("h0", "h1", "h2").alias("slide_height"))


def input_validation_counts(rows: DataFrame) -> DataFrame:
    """Ten counters over rows whose validation has a status; cells are text, true or false."""
    checked = rows.where("coalesce(input_validation_status, '') <> ''")
    true = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).isin("true", "1", "yes")
    false = lambda c: F.col(c) == "false"
    counters = {
        "num_rows_with_input_validation": F.lit(True),
        "num_rgb_converted": true("converted_to_rgb"),
        "num_input_shape_matches": true("input_shape_matches_model"),
        "num_input_shape_mismatches": false("input_shape_matches_model"),
        "num_uint8_inputs": true("is_uint8"),
        "num_valid_range_inputs": true("range_looks_valid"),
        "num_mpp_available": true("mpp_available"),
        "num_mpp_unavailable": false("mpp_available"),
        "num_mpp_within_tolerance": true("mpp_within_tolerance"),
        "num_mpp_outside_tolerance": (F.col("mpp_available") == "true") & false("mpp_within_tolerance"),
    }
    return checked.agg(*[F.count_if(test).alias(name) for name, test in counters.items()])
