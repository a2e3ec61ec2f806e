"""Descriptive statistics, hashes and cohort aggregates."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def describe(x: Column, sample: bool = False) -> list[Column]:
    """n, mean, median, min, max, sd of the non-null values; the population's sd, or the sample's (0 for one value)."""
    sd = F.when(F.count(x) == 1, 0.0).otherwise(F.stddev_samp(x)) if sample else F.stddev_pop(x)
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"), sd.alias("sd")]


def distribution(x: Column) -> list[Column]:
    """n, mean, sample sd, median, quartiles and their distance."""
    q = lambda p: F.percentile(x, F.lit(p))
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.when(F.count(x) == 1, 0.0).otherwise(F.stddev_samp(x)).alias("sd"), q(0.5).alias("median"), q(0.25).alias("q1"), q(0.75).alias("q3"), (q(0.75) - q(0.25)).alias("iqr")]


def unpivoted(df: DataFrame, keys: list[str], values: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """One row for each value column."""
    return df.unpivot(keys, values, name, value)


def pool_hash(pool: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Digest of the pool's rows in canonical order, and their number: the same for any order of the rows."""
    line = F.concat_ws("|", "candidate_id", "x_level0", "y_level0", "patch_size")
    lines = F.array_sort(F.collect_list(line))
    return pool.groupBy(*(by or [])).agg(F.sha2(F.concat(F.array_join(lines, "\n"), F.lit("\n")), 256).alias("pool_hash"), F.count(F.lit(1)).alias("n"))


def canonical_hash(document: dict) -> str:
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def one_hash_only(df: DataFrame, column: str) -> str:
    """The single value of a column; an error if cases differ."""
    got = [r[0] for r in df.select(column).distinct().limit(2).collect()]
    if len(got) != 1:
        raise ValueError(f"{column} differs between cases")
    return got[0]


def counted_map(df: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """Counts by key as JSON text, keys in order."""
    n = df.groupBy(*(by or []), F.col(key).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*(by or [])).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n"))))).alias("counts"))


def paired(df: DataFrame, case: str, method: str, value: str, first: str, second: str) -> DataFrame:
    """One row a case: the value of both methods and their difference."""
    p = df.groupBy(case).pivot(method, [first, second]).agg(F.first(value))
    return p.select(case, F.col(first).alias("baseline"), F.col(second).alias("smart"), (F.col(second) - F.col(first)).alias("delta"))


def wins(delta: Column, band: float = 1e-12) -> list[Column]:
    return [F.count_if(delta > band).alias("wins"), F.count_if(delta < -band).alias("losses"), F.count_if(F.abs(delta) <= band).alias("ties")]
