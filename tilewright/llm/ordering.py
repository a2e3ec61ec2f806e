"""Cutting an integer id into even ranges, so that a global order never meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pieces(spark: SparkSession) -> int:
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bounds(df: DataFrame, id_col: str, parts: int) -> list[int]:
    """At most parts - 1 rising cut points of even ranges, from the id column alone."""
    if parts < 2:
        return []
    found = df.select(F.col(id_col).cast("double").alias("x")).where("x is not null").approxQuantile("x", [i / parts for i in range(1, parts)], 0.25 / parts)
    return sorted({int(x) for x in found})


def bucket(id_col: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the id (0 for a null), by binary search inside the JVM."""
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.lit(b).cast("long") for b in bounds]) if len(bounds) < 2 else F.expr(f"array({','.join(f'{b}L' for b in bounds)})")
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    at = F.lit(0)
    n = len(bounds)
    walk = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        at,
        lambda low, step: F.when((low + step <= n) & (F.get(cuts, F.least(low + step, F.lit(n)) - 1) <= id_col), low + step).otherwise(low),
    )
    return F.coalesce(walk, F.lit(0))


def ranges_of(df: DataFrame, id_col: str, spread: list[Column], rows: int) -> tuple[Column, int]:
    """(part, number of parts): ranges of rising ids with about so many rows each at most, as many as tasks at least. Rows
    without an id come first; they are dealt by a hash of ``spread``, so that however many they are, none is large."""
    n, ids = df.agg(F.count(F.lit(1)), F.count(id_col)).first()
    bounds = id_bounds(df, id_col, max(pieces(df.sparkSession), -(-ids // rows)))
    first = max(1, -(-(n - ids) // rows))
    part = F.when(F.col(id_col).isNull(), F.pmod(F.xxhash64(*spread), F.lit(first))).otherwise(bucket(F.col(id_col), bounds) + first)
    return part.cast("int"), first + len(bounds) + 1
