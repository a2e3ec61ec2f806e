"""Tile grids, thumbnail boxes, tissue ratios, tissue thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid(slides: DataFrame, tile: int, stride: int | None = None) -> DataFrame:
    """Every whole tile of each slide in row-major order: the slide's columns, grid_index, x_level0, y_level0.

    A slide smaller than a tile has none; it is filtered before the sequences, which would raise on it."""
    step = stride or tile
    axis = lambda size: F.sequence(F.lit(0).cast("long"), F.col(size) - tile, F.lit(step).cast("long"))
    fits = slides.where((F.col("slide_width") >= tile) & (F.col("slide_height") >= tile))
    cols = (F.floor((F.col("slide_width") - tile) / step) + 1).cast("long")
    rows = fits.withColumn("y_level0", F.explode(axis("slide_height"))).withColumn("x_level0", F.explode(axis("slide_width")))
    return rows.withColumn("grid_index", (F.col("y_level0") / step).cast("long") * cols + (F.col("x_level0") / step).cast("long"))


def axis_positions(size: Column, tile: int, stride: int, edge: str) -> Column:
    """Starts along an axis. ``drop``: whole tiles only; ``overlap``: one more that ends at the border; ``pad``: tiles
    that start inside, the last one padded. For the last two the stride is at most the tile."""
    if edge not in ("drop", "overlap", "pad"):
        raise ValueError(f"unknown edge policy: {edge}")
    step = stride if edge == "drop" else min(stride, tile)
    zero = F.lit(0).cast("long")
    whole = F.sequence(zero, F.greatest(size - tile, zero), F.lit(step).cast("long"))
    if edge == "drop":
        return F.when(size >= tile, whole).otherwise(F.array().cast("array<bigint>"))
    if edge == "overlap":
        return F.when(size >= tile, F.array_union(whole, F.array(size - tile))).otherwise(F.array(zero))
    return F.when(size > 0, F.sequence(zero, F.greatest(size - 1, zero), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def edge_grid(slides: DataFrame, tile: int, stride: int, edge: str) -> DataFrame:
    """Tiles by edge policy, with what of each lies inside the slide."""
    rows = slides.withColumn("y_level0", F.explode(axis_positions(F.col("slide_height"), tile, stride, edge)))
    rows = rows.withColumn("x_level0", F.explode(axis_positions(F.col("slide_width"), tile, stride, edge)))
    w = F.least(F.lit(tile).cast("long"), F.col("slide_width") - F.col("x_level0"))
    h = F.least(F.lit(tile).cast("long"), F.col("slide_height") - F.col("y_level0"))
    return rows.withColumns({"original_width": w, "original_height": h, "padded": (w < tile) | (h < tile)})


def covered(tiles: DataFrame, key: str, start: str, length: str, size: str) -> DataFrame:
    """Along an axis: the furthest end that tiles reach without a gap, and whether that is the whole. Gaps and islands:
    a running maximum of the ends before each start."""
    ends = tiles.select(key, F.col(start).alias("s"), (F.col(start) + F.col(length)).alias("e"), F.col(size).alias("n")).distinct()
    before = Window.partitionBy(key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("reach", F.coalesce(F.max("e").over(before), F.lit(0)))
    first_gap = F.min(F.when(F.col("s") > F.col("reach"), F.col("reach")))
    g = ends.groupBy(key, "n").agg(first_gap.alias("gap"), F.max("e").alias("far"))
    g = g.withColumn("covered_to", F.coalesce("gap", "far"))
    return g.select(key, "covered_to", (F.col("covered_to") >= F.col("n")).alias("fully_covered"))


def thumbnail_box(df: DataFrame, slide_w: str, slide_h: str, thumb_w: Column, thumb_h: Column, tile: str = "patch_size") -> DataFrame:
    """The tile's box on the thumbnail: floor and ceiling, clamped, one pixel at least."""
    x0 = F.floor(F.col("x_level0") * thumb_w / F.col(slide_w))
    y0 = F.floor(F.col("y_level0") * thumb_h / F.col(slide_h))
    x1 = F.ceil((F.col("x_level0") + F.col(tile)) * thumb_w / F.col(slide_w))
    y1 = F.ceil((F.col("y_level0") + F.col(tile)) * thumb_h / F.col(slide_h))
    zero = F.lit(0).cast("long")
    left, top = F.greatest(zero, F.least(x0, thumb_w - 1)), F.greatest(zero, F.least(y0, thumb_h - 1))
    return df.withColumns({"bx0": left, "by0": top, "bx1": F.greatest(left + 1, F.least(x1, thumb_w)), "by1": F.greatest(top + 1, F.least(y1, thumb_h))})


def tissue_ratio(boxes: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the mask cells in each box, through a two-way running sum: four equal joins instead of a range join, so the
    work is a row a cell and four lookups a box however large boxes are. Cells never go to the driver: both sides are generated,
    which Spark's size estimates don't see, so a broadcast is ruled out. ``keys``, slide_id among them, name a box."""
    per_column = Window.partitionBy("slide_id", "tx").orderBy("ty")
    per_row = Window.partitionBy("slide_id", "ty").orderBy("tx")
    sums = mask.withColumn("c", F.sum("tissue").over(per_column)).withColumn("area", F.sum("c").over(per_row)).select("slide_id", "tx", "ty", "area")
    corner = F.explode(
        F.array(
            F.struct((F.col("bx1") - 1).alias("tx"), (F.col("by1") - 1).alias("ty"), F.lit(1).alias("sign")),
            F.struct((F.col("bx0") - 1).alias("tx"), (F.col("by1") - 1).alias("ty"), F.lit(-1).alias("sign")),
            F.struct((F.col("bx1") - 1).alias("tx"), (F.col("by0") - 1).alias("ty"), F.lit(-1).alias("sign")),
            F.struct((F.col("bx0") - 1).alias("tx"), (F.col("by0") - 1).alias("ty"), F.lit(1).alias("sign")),
        )
    )
    size = ((F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0"))).alias("size")
    corners = boxes.select(*keys, size, corner.alias("k")).select(*keys, "size", "k.*").where("tx >= 0 and ty >= 0")
    found = corners.join(sums.hint("merge"), ["slide_id", "tx", "ty"], "left")
    inside = F.sum(F.coalesce("area", F.lit(0)) * F.col("sign"))
    return found.groupBy(*keys, "size").agg(inside.alias("inside")).select(*keys, (F.col("inside") / F.col("size")).alias("thumbnail_tissue_ratio"))


def named(df: DataFrame) -> DataFrame:
    """candidate_id from the grid index before any filter."""
    return df.withColumn("candidate_id", F.format_string("candidate_%06d", "grid_index"))


def otsu(histogram: DataFrame, key: str) -> DataFrame:
    """histogram (key, level, n) -> (key, threshold): the level that maximises the variance between classes; ties to the lower.
    Values up to the threshold are one class. A single level is its own threshold."""
    up = Window.partitionBy(key).orderBy("level")
    whole = Window.partitionBy(key)
    h = histogram.withColumns({"w0": F.sum("n").over(up), "s0": F.sum(F.col("n") * F.col("level")).over(up), "w": F.sum("n").over(whole), "s": F.sum(F.col("n") * F.col("level")).over(whole)})
    w1, s1 = F.col("w") - F.col("w0"), F.col("s") - F.col("s0")
    apart = F.try_divide(F.col("s0"), F.col("w0")) - F.try_divide(s1, w1)
    between = F.round(F.coalesce(F.col("w0") * w1 * apart * apart, F.lit(-1.0)), 6)
    return h.withColumn("between", between).groupBy(key).agg(F.max_by("level", F.struct("between", (-F.col("level")).alias("l"))).alias("threshold"))


def accept_until(df: DataFrame, by: str, order: list[Column], accepted: Column, k: int) -> DataFrame:
    """Rows read, in order, until k are accepted: with whether each is, and its number among the accepted or the rejected."""
    ahead = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ok = accepted.cast("int")
    rows = df.withColumns({"before": F.coalesce(F.sum(ok).over(ahead), F.lit(0)), "read": F.count(F.lit(1)).over(ahead), "accepted": accepted})
    number = F.when(F.col("accepted"), F.col("before")).otherwise(F.col("read") - F.col("before"))
    return rows.where(F.col("before") < k).withColumn("number", number).drop("before", "read")


def limit_valid(df: DataFrame, by: str, order: list[Column], valid: Column, k: int) -> DataFrame:
    """The first k valid rows, and the rows that aren't valid and come before the k + 1st: a limit they don't use up."""
    ahead = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(valid.cast("int")).over(ahead), F.lit(0))).where(~valid | (F.col("before") < k)).drop("before")
