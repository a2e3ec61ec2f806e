"""Label masks: class distributions, agreement, accuracy and intersection over union. Long form: key, y, x, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_distribution(pixels: DataFrame, key: str, label: str) -> DataFrame:
    n = pixels.groupBy(key, F.col(label).alias("class_id")).agg(F.count(F.lit(1)).alias("pixels"))
    return n.withColumn("ratio", F.col("pixels") / F.sum("pixels").over(Window.partitionBy(key)))


def accuracy(truth: Column, told: Column, ignore: int | None = None) -> Column:
    """Share of equal labels where the truth isn't ignored; null if there is none."""
    same = (truth == told).cast("double")
    return F.avg(same if ignore is None else F.when(truth != ignore, same))


def iou_by_class(pixels: DataFrame, key: str, truth: str, told: str, ignore: int | None = None) -> DataFrame:
    """Intersection over union of every class that either mask holds: one pass over pixels, then a few counts a key."""
    p = pixels if ignore is None else pixels.where(F.col(truth) != ignore)
    pairs = p.groupBy(key, F.col(truth).alias("t"), F.col(told).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    each = pairs.select(key, "n", F.explode(F.array_distinct(F.array("t", "p"))).alias("class_id"), (F.col("t") == F.col("p")).alias("hit"))
    return each.groupBy(key, "class_id").agg((F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)) / F.sum("n")).alias("iou"))


def mean_iou(pixels: DataFrame, key: str, truth: str, told: str, classes: int, ignore: int | None = None) -> DataFrame:
    """Mean over the first classes with a union."""
    return iou_by_class(pixels, key, truth, told, ignore).where((F.col("class_id") >= 0) & (F.col("class_id") < classes)).groupBy(key).agg(F.avg("iou").alias("mean_iou"))


def agreement(pixels: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Share of equal labels, macro IoU over observed classes, and the largest difference of class shares."""
    iou = iou_by_class(pixels, key, a, b).groupBy(key).agg(F.avg("iou").alias("macro_iou"))
    left = class_distribution(pixels, key, a).select(key, "class_id", F.col("ratio").alias("ra"))
    right = class_distribution(pixels, key, b).select(key, "class_id", F.col("ratio").alias("rb"))
    far = left.join(right, [key, "class_id"], "full").groupBy(key).agg(F.max(F.abs(F.coalesce("ra", F.lit(0.0)) - F.coalesce("rb", F.lit(0.0)))).alias("largest_ratio_difference"))
    return pixels.groupBy(key).agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement")).join(iou, key).join(far, key)
