"""New cases as they arrive: a file stream of candidate manifests, scored and selected batch by batch.

The batch engine's normalisation and selection are over whole slides, so a case is one file set that arrives at once; each
micro-batch runs the batch plan on the cases it holds and writes them under its own number, which makes a repeated batch replace itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.plans import selectors


def case_stream(spark: SparkSession, folder: str, schema: T.StructType, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def select_as_they_come(stream: DataFrame, slides: DataFrame, out: str, checkpoint: str, selector: str = "greedy_spatial", **changes):
    """Starts the query; picks go to ``out``/batch=<number>."""

    def batch(df: DataFrame, number: int) -> None:
        picks = selectors.run(selector, df, slides, **changes).where("selected")
        picks.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows and mean runtime of segmentation events in tumbling windows, late ones up to the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
