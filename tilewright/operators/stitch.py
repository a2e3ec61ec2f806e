"""Window geometry, padding, stitching and blending of windowed predictions. Boxes are half open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def padding(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> dict[str, Column]:
    """What of a box lies outside the slide on each side, and the box that can be read."""
    zero = F.lit(0).cast("long")
    return {
        "pad_left": F.greatest(zero, -x0),
        "pad_top": F.greatest(zero, -y0),
        "pad_right": F.greatest(zero, x1 - width),
        "pad_bottom": F.greatest(zero, y1 - height),
        "read_x0": F.greatest(zero, F.least(x0, width)),
        "read_y0": F.greatest(zero, F.least(y0, height)),
        "read_x1": F.greatest(zero, F.least(x1, width)),
        "read_y1": F.greatest(zero, F.least(y1, height)),
    }


def context_windows(tiles: DataFrame, window_in: int = 1024, window_out: int = 512, tile: int = 1024) -> DataFrame:
    """Four windows of each tile: its context is the tile and a margin of half of what a window loses; each window reads window_in and
    predicts the window_out in its middle. Adds the context's padding."""
    if window_in < window_out or (window_in - window_out) % 2 or tile != 2 * window_out:
        raise ValueError("windows must be larger than their output by an even number, and two outputs must make a tile")
    margin = (window_in - window_out) // 2
    x0, y0 = F.col("x_level0") - margin, F.col("y_level0") - margin
    size = tile + 2 * margin
    rows = tiles.withColumns({"context_x0": x0, "context_y0": y0, "context_x1": x0 + size, "context_y1": y0 + size})
    rows = rows.withColumns(padding(F.col("context_x0"), F.col("context_y0"), F.col("context_x1"), F.col("context_y1"), F.col("slide_width"), F.col("slide_height")))
    quad = F.array(*[F.struct(F.lit(2 * r + c).alias("window"), F.lit(c * window_out).cast("long").alias("dx"), F.lit(r * window_out).cast("long").alias("dy")) for r in (0, 1) for c in (0, 1)])
    rows = rows.withColumn("q", F.explode(quad)).select("*", "q.*").drop("q")
    return rows.withColumns({"in_x0": F.col("context_x0") + F.col("dx"), "in_y0": F.col("context_y0") + F.col("dy"), "out_x0": F.col("x_level0") + F.col("dx"), "out_y0": F.col("y_level0") + F.col("dy")})


def overlap_windows(tiles: DataFrame, window_in: int = 1024, window_out: int = 512, tile: int = 1024, stride: int = 450) -> DataFrame:
    """Overlapping output boxes over each tile at a stride; inputs centred on them; boxes beyond the tile are clipped."""
    margin = (window_in - window_out) // 2
    zero, last, step = (F.lit(v).cast("long") for v in (0, tile - 1, stride))
    axis = F.sequence(zero, last, step)
    rows = tiles.withColumn("oy", F.explode(axis)).withColumn("ox", F.explode(axis))
    rows = rows.withColumns({"out_x1": F.least(F.col("ox") + window_out, F.lit(tile).cast("long")), "out_y1": F.least(F.col("oy") + window_out, F.lit(tile).cast("long"))})
    return rows.withColumns({"in_x0": F.col("x_level0") + F.col("ox") - margin, "in_y0": F.col("y_level0") + F.col("oy") - margin})


def stitched(windows: DataFrame, key: str) -> DataFrame:
    """Pixels of windows (key, dx, dy, y, x, label) in the tile's place."""
    return windows.select(key, (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "label")


def argmax(probabilities: DataFrame, keys: list[str]) -> DataFrame:
    """The class of the largest probability; the first of equal ones."""
    return probabilities.groupBy(*keys).agg(F.min_by("class", F.struct(-F.col("p"), F.col("class"))).alias("label"), F.max("p").alias("p"))


def hann(i: Column, n: Column) -> Column:
    """The symmetric Hann window at place i of n; 1 for a single place."""
    return F.when(n > 1, F.lit(0.5) - F.cos(i * 2 * F.pi() / (n - 1)) * 0.5).otherwise(1.0)


def feather(y: Column, x: Column, h: Column, w: Column, top: Column, floor: float = 0.05) -> Column:
    """Weight of a place in an output box: the product of two Hann windows over the largest of them, with a floor."""
    return F.greatest(F.lit(floor), hann(y, h) * hann(x, w) / top)


def hann_top(n: Column) -> Column:
    """Largest value of the window of n places: 1 for odd n."""
    return hann(F.floor((n - 1) / 2), n)


def blend(parts: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Weighted mean of overlapping probabilities (keys, class, p, weight): one grouped sum."""
    return parts.groupBy(*keys, "class").agg((F.sum(F.col("p") * F.col(weight)) / F.sum(weight)).alias("p"))


def coverage(places: DataFrame, size: int, key: str) -> DataFrame:
    """places (key, y, x, n windows, weight) of covered pixels of size * size: least, most and mean windows, uncovered, share of more than one."""
    g = places.groupBy(key).agg(F.count(F.lit(1)).alias("covered"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("all"), F.count_if(F.col("n") > 1).alias("several"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"))
    whole = float(size * size)
    return g.select(key, F.when(F.col("covered") < size * size, F.lit(0)).otherwise(F.col("least")).cast("long").alias("min_count"), F.col("most").cast("long").alias("max_count"), (F.col("all") / whole).alias("mean_count"), (F.lit(size * size) - F.col("covered")).cast("long").alias("uncovered"), (F.col("several") / whole * 100).alias("multi_covered_percent"), "min_weight", "max_weight")


def seams(pixels: DataFrame, key: str, at: list[int], band: int, size: int, label: str = "label") -> DataFrame:
    """At each vertical seam: share of places in the band left of it whose label differs from the same column of the band right of it; a
    seam whose bands leave the image is skipped."""
    inside = [s for s in sorted(set(at)) if s - band >= 0 and s + band <= size]
    p = pixels.select(key, "y", "x", F.col(label).alias("l"))
    seam = F.explode(F.array(*map(F.lit, inside)))
    left = p.select(key, "y", "x", "l", seam.alias("seam")).where((F.col("x") >= F.col("seam") - band) & (F.col("x") < F.col("seam")))
    right = p.select(F.col(key), "y", (F.col("x") - band).alias("x"), F.col("l").alias("m"))
    return left.join(right, [key, "y", "x"]).groupBy(key, "seam").agg(F.avg((F.col("l") != F.col("m")).cast("double")).alias("disagreement"))


def offset_search(truth: DataFrame, told: DataFrame, key: str, reach: int) -> DataFrame:
    """Agreement of a mask with another at every shift up to reach: shifted rows meet by an equal join, counts are combined before the shuffle.
    Both sides are often generated, which Spark's size estimates don't see, so a broadcast is ruled out."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)])
    moved = told.select(key, "y", "x", F.col("label").alias("told"), F.explode(steps).alias("s")).select(key, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "told", "s.dy", "s.dx")
    both = truth.select(key, "y", "x", F.col("label").alias("truth")).join(moved.hint("merge"), [key, "y", "x"])
    return both.groupBy(key, "dy", "dx").agg(F.count(F.lit(1)).alias("compared"), F.avg((F.col("truth") == F.col("told")).cast("double")).alias("agreement"))


def nearest_pixels(pixels: DataFrame, key: str, h: int, w: int, to_h: int, to_w: int, label: str) -> DataFrame:
    """Nearest-neighbour resize of label masks in long form: targets are generated for each key, sources looked up."""
    zero = F.lit(0).cast("long")
    keys = pixels.select(key).distinct()
    rows = keys.withColumn("ty", F.explode(F.sequence(zero, F.lit(to_h - 1).cast("long")))).withColumn("tx", F.explode(F.sequence(zero, F.lit(to_w - 1).cast("long"))))
    rows = rows.withColumns({"y": F.floor((F.col("ty") + 0.5) * h / to_h), "x": F.floor((F.col("tx") + 0.5) * w / to_w)})
    return rows.join(pixels.select(key, "y", "x", label), [key, "y", "x"]).select(key, F.col("ty").alias("y"), F.col("tx").alias("x"), label)


def probability_summary(probabilities: DataFrame, key: str, classes: int) -> DataFrame:
    """Over pixels: mean, median, least and largest of the largest probability, mean and median of the entropy over its maximum."""
    e = F.when(F.col("p") > 0, -F.col("p") * F.log2("p")).otherwise(0.0)
    px = probabilities.groupBy(key, "y", "x").agg(F.max("p").alias("m"), (F.sum(e) / F.log2(F.lit(float(classes)))).alias("h"))
    q = lambda c: F.percentile(c, F.lit(0.5))
    return px.groupBy(key).agg(F.avg("m").alias("mean_max"), q("m").alias("median_max"), F.min("m").alias("min_max"), F.max("m").alias("max_max"), F.avg("h").alias("mean_entropy"), q("h").alias("median_entropy"))
