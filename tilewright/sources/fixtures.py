"""Slides, candidates, masks, tiles, labels and runs derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.sources.tables import table

TILE, THUMB = 1024, 256
#: Quantisation of embedding components: 0 at LOW, 1 at LOW + SPAN.
LOW, SPAN = -0.4, 0.8


def slides(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("slide_id"),
        F.when(k % 10 == 9, 900).otherwise(8192 + 1024 * (k % 17)).cast("long").alias("slide_width"),
        (6144 + 512 * (k % 13)).cast("long").alias("slide_height"),
        F.when(k % 7 != 0, F.lit(0.20) + F.lit(0.02) * (F.col("s_nationkey") % 6)).alias("mpp_x"),
        F.when(k % 2 == 0, "40").otherwise("20").alias("objective_power"),
    )


def candidates(spark: SparkSession, d: str, dealt: bool = False) -> DataFrame:
    """Tiles of the pool. ``part`` is a tile's number: candidate_id has six places, so that numbers beyond a million share ids. With
    ``dealt`` the narrow rows are dealt out by slide first, and neither the tiles nor windows on their slide need another exchange."""
    p = F.col("l_partkey")
    rows = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "slide_id")
    x = (rows.repartition("slide_id") if dealt else rows).groupBy("slide_id", "l_partkey").agg(
        (F.max("l_quantity") / 50.0).alias("tissue_ratio"),
        (F.max("l_discount") * 10.0).alias("nuclear_signal"),
        (F.max("l_tax") / 0.08).alias("visual_entropy"),
        F.max("l_extendedprice").alias("blur_score"),
        F.min("l_discount").alias("artifact_penalty"),
    )
    return x.select(
        "slide_id",
        p.alias("part"),
        F.concat(F.lit("candidate_"), F.lpad(p.cast("string"), 6, "0")).alias("candidate_id"),
        ((p % 40) * TILE).cast("long").alias("x_level0"),
        (F.floor(p / 40) * TILE).cast("long").alias("y_level0"),
        F.lit(TILE).cast("long").alias("patch_size"),
        "tissue_ratio",
        "nuclear_signal",
        "visual_entropy",
        "blur_score",
        "artifact_penalty",
    )


def extents(spark: SparkSession, d: str) -> DataFrame:
    """How far the tiles of each slide reach: slide_id, slide_width, slide_height, from the highest part alone."""
    high = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("slide_id")).agg(F.max("l_partkey").alias("part"))
    return high.select("slide_id", F.lit(40 * TILE).cast("long").alias("slide_width"), (F.floor(F.col("part") / 40) * TILE + TILE).cast("long").alias("slide_height"))


def mask(spark: SparkSession, d: str) -> DataFrame:
    """Thumbnail cells of every slide: slide_id, tx, ty, tissue (0 or 1). Slides are dealt out before they become cells: a small file
    is one partition, and windows on a slide's cells need no other exchange."""
    s = slides(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "slide_id")
    last = lambda c: F.ceil(F.col(c) / THUMB).cast("long") - 1
    cells = s.select("slide_id", F.explode(F.sequence(F.lit(0).cast("long"), last("slide_width"))).alias("tx"), last("slide_height").alias("h"))
    cells = cells.select("slide_id", "tx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h"))).alias("ty"))
    return cells.withColumn("tissue", ((F.col("tx") * 7 + F.col("ty") * 13 + F.col("slide_id") * 31) % 11 < 6).cast("int"))


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select(
        "vec_id",
        F.format_string("candidate_%06d", v).alias("candidate_id"),
        (v % 25 * TILE).cast("long").alias("x_level0"),
        (F.floor(v / 25) * TILE).cast("long").alias("y_level0"),
        F.col("label").alias("cluster_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
    )


def _stacked(spark: SparkSession, d: str, n: int, name: str) -> DataFrame:
    """Groups of n consecutive vectors, whole groups only: <name>, v0 .. v(n-1)."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / n).alias(name), (F.col("vec_id") % n).alias("k"), "embedding")
    v = [F.max(F.when(F.col("k") == i, F.transform("embedding", lambda x: x.cast("double")))).alias(f"v{i}") for i in range(n)]
    return e.groupBy(name).agg(F.count(F.lit(1)).alias("n"), *v).where(f"n = {n}").drop("n")


def _scaled(v: str, levels: int, most: int):
    return F.transform(v, lambda x: F.least(F.lit(most), F.greatest(F.lit(0), F.floor((x - LOW) / SPAN * levels))).cast("int"))


def tile_planes(spark: SparkSession, d: str) -> DataFrame:
    """8 x 8 RGB tiles: tile_id, r, g, b (arrays in row order)."""
    return _stacked(spark, d, 3, "tile_id").select("tile_id", *[_scaled(f"v{i}", 255, 255).alias(c) for i, c in enumerate("rgb")])


def tiles(spark: SparkSession, d: str) -> DataFrame:
    """8 x 8 RGB tiles: tile_id, h, w, rgb (bytes in row order)."""
    pixels = F.transform(F.arrays_zip("r", "g", "b"), lambda z: F.format_string("%02X%02X%02X", z["r"], z["g"], z["b"]))
    return tile_planes(spark, d).select("tile_id", F.lit(8).alias("h"), F.lit(8).alias("w"), F.unhex(F.array_join(pixels, "")).alias("rgb"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """8 x 8 label masks: mask_id, y_true, y_pred (arrays in row order, classes 0-4)."""
    t = _stacked(spark, d, 2, "mask_id")
    return t.select("mask_id", _scaled("v0", 5, 4).alias("y_true"), _scaled("v1", 5, 4).alias("y_pred"))


def label_pixels(spark: SparkSession, d: str) -> DataFrame:
    """mask_id, y, x, y_true, y_pred."""
    z = labels(spark, d).select("mask_id", F.posexplode(F.arrays_zip("y_true", "y_pred")).alias("p", "z"))
    return z.select("mask_id", F.floor(F.col("p") / 8).alias("y"), (F.col("p") % 8).cast("long").alias("x"), "z.y_true", "z.y_pred")


def cubes(spark: SparkSession, d: str) -> DataFrame:
    """8 x 8 probability cubes: cube_id, p (64 arrays of 5 class probabilities)."""
    t = _stacked(spark, d, 5, "cube_id")
    odds = [F.transform(f"v{c}", lambda x: F.exp(x * 8)) for c in range(5)]
    t = t.select("cube_id", F.arrays_zip(*[o.alias(f"e{c}") for c, o in enumerate(odds)]).alias("z"))
    total = lambda z: z["e0"] + z["e1"] + z["e2"] + z["e3"] + z["e4"]
    return t.select("cube_id", F.transform("z", lambda z: F.array(*[z[f"e{c}"] / total(z) for c in range(5)])).alias("p"))


def probabilities(spark: SparkSession, d: str) -> DataFrame:
    """cube_id, y, x, class, p."""
    z = cubes(spark, d).select("cube_id", F.posexplode("p").alias("i", "q")).select("cube_id", "i", F.posexplode("q").alias("class", "p"))
    return z.select("cube_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("long").alias("x"), "class", "p")


def segmentation(spark: SparkSession, d: str) -> DataFrame:
    """Per-tile segmentation rows with JSON cells."""
    e = F.col("event_id")
    props = F.regexp_replace("props", "[^0-9]", "").cast("long")
    counts = F.format_string('{"%d": %d, "%d": %d}', e % 5, F.floor(F.col("value") * 10), (e + 1 + e % 3) % 5, props)
    return table(spark, d, "events").select(
        e.alias("row_id"),
        F.when(e % 2 == 0, "baseline").otherwise("smart").alias("method"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "skipped").otherwise("completed").alias("status"),
        F.col("value").alias("runtime_seconds"),
        counts.alias("class_pixel_counts"),
        F.when(e % 4 == 0, "[512, 512]").otherwise("[1024, 1024]").alias("prediction_shape"),
        F.when(e % 3 == 0, '["resized for visualization", "low contrast"]').when(e % 3 == 1, "[]").alias("patch_warnings"),
    )
