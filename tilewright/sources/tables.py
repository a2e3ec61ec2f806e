"""Scans of run folders: manifests as CSV, documents as JSON, tables as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv_manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV manifest by declared columns; an empty cell is null, a malformed row an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with every column as text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


REQUIRED = {"selector": ["all_candidates.csv", "selected_patches.csv", "selection_summary.json", "method_config.json"], "segmentation": ["segmentation_results.csv", "segmentation_summary.json"]}


def run_files(spark: SparkSession, folder: str, kind: str = "selector") -> dict[str, str]:
    """Paths of a run's files by name; raises when one is missing."""
    jvm = spark.sparkContext._jvm
    found, missing = {}, []
    for name in REQUIRED[kind]:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            found[name] = str(path)
        else:
            missing.append(name)
    if missing:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
    return found


def load_run(spark: SparkSession, label: str, folder: str) -> dict[str, DataFrame]:
    """A selector run: candidates, selected, summary, config, each with its label."""
    files = run_files(spark, folder)
    tag = lambda df: df.withColumn("run", F.lit(label))
    return {
        "candidates": tag(csv_strings(spark, files["all_candidates.csv"])),
        "selected": tag(csv_strings(spark, files["selected_patches.csv"])),
        "summary": tag(json_document(spark, files["selection_summary.json"])),
        "config": tag(json_document(spark, files["method_config.json"])),
    }


def slides_in(spark: SparkSession, folder: str, expected: int | None = None, suffixes: tuple[str, ...] = (".svs", ".tif", ".tiff", ".ndpi", ".mrxs", ".scn", ".bif")) -> DataFrame:
    """path, length of the slide files of a folder, without reading them; raises if there aren't as many as expected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    files = files.where(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    if expected is not None and (n := files.count()) != expected:
        raise ValueError(f"{n} slides in {folder}, {expected} expected")
    return files


def reusable_cache(cache: DataFrame, pool: DataFrame, fields: list[str], feature_size: int) -> DataFrame | None:
    """Cached feature rows of a pool, if they serve all of it: every id there once, every field filled, the same feature size. Else None."""
    if any(f not in cache.columns for f in (*fields, "feature_size", "candidate_id", "slide_id")):
        return None
    keys = ["slide_id", "candidate_id"]
    rows = pool.select(*keys).join(cache, keys, "left")
    whole = F.lit(True)
    for f in fields:
        whole = whole & F.col(f).isNotNull()
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*keys).alias("d"), F.bool_and(whole & (F.col("feature_size") == feature_size)).alias("ok")).first()
    return rows.select(*keys, *fields) if found["ok"] and found["n"] == found["d"] else None


def nth_selected(selected: DataFrame, index: int, by: str = "slide_id") -> DataFrame:
    """The row of each slide at an ordinal from 0; an error if a slide has too few."""
    if index < 0:
        raise ValueError("index must not be negative")
    n = selected.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    if not n.where(F.col("n") <= index).isEmpty():
        raise IndexError(f"fewer than {index + 1} selected rows")
    return selected.where(F.col("rank") == index + 1)
