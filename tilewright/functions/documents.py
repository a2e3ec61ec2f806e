"""Documents and messages around a run: column lists, times, JSON-safe values, model outputs, metric tables read back."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from datetime import UTC, datetime
from itertools import chain
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Under what names a model's output holds labels and probabilities, the first wins.
LABEL_KEYS = ("predictions", "prediction", "labels", "label", "mask", "masks")
PROBABILITY_KEYS = ("probabilities", "probability", "probs")


def ordered_unique(*lists: Iterable[str]) -> list[str]:
    """All names in the order in which they first come."""
    return list(dict.fromkeys(chain.from_iterable(lists)))


def utc_now() -> str:
    return datetime.now(UTC).isoformat()


def is_memory_fault(message: Column) -> Column:
    """Whether an error's text says that memory ran out."""
    return F.coalesce(F.lower(message).rlike("out of memory|cannot allocate|memoryerror"), F.lit(False))


def json_safe(value: Any) -> Any:
    """The value as JSON gives it back: arrays and numbers of NumPy as lists and numbers, keys and what is unknown as text."""
    whole = {str(k): json_safe(v) for k, v in value.items()} if isinstance(value, Mapping) else value
    return json.loads(json.dumps(whole, default=lambda x: x.tolist() if isinstance(x, (np.ndarray, np.generic)) else str(x)))


def shown(value: float | None, digits: int = 6, missing: str = "") -> str:
    """A number with fixed decimals, rounded by its exact value, as Python does; for the last step of a report."""
    return missing if value is None or not np.isfinite(value) else f"{value:.{digits}f}"


def shown_column(value: Column, digits: int = 6, missing: str = "") -> Column:
    """``shown`` for a column, in Arrow batches."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def run(column):
        import pyarrow as pa

        return pa.array([shown(v, digits, missing) for v in column.to_pylist()], pa.string())

    return run(value.cast("double"))


def metric_values(table: DataFrame) -> DataFrame:
    """metric and its three numbers from a written metric table, all text; what is no number is null, and a metric's last row holds."""
    fields = ("baseline_value", "smart_value", "delta_smart_minus_baseline")
    numbers = [F.col(f).try_cast("double").alias(f) for f in fields]
    rows = table.withColumn("row", F.monotonically_increasing_id()).select("metric", "row", *numbers)
    return rows.groupBy("metric").agg(F.max_by(F.struct(*fields), "row").alias("v")).select("metric", "v.*")


def nested(output: Any, names: tuple[str, ...]) -> tuple[Any, str | None]:
    """(value, path) of the first of these names that isn't empty in nested mappings and lists, outer levels first; name by name in each."""
    level = [("", output)]
    while level:
        maps = [(at, x) for at, x in level if isinstance(x, Mapping)]
        for name in names:
            for at, x in maps:
                if x.get(name) is not None:
                    return x[name], f"{at}.{name}".lstrip(".")
        inner = [(f"{at}.{k}", v) for at, x in maps for k, v in x.items()]
        level = inner + [(f"{at}[{i}]", v) for at, x in level if isinstance(x, (list, tuple)) for i, v in enumerate(x)]
    return None, None


def model_output(output: Mapping) -> tuple[np.ndarray, np.ndarray, str, str]:
    """Labels (h, w), probabilities (h, w, classes), and where both were found. Without labels they are the likeliest classes;
    without probabilities, or with shapes that don't agree, it is an error."""
    from tilewright.operators.segment import label_mask

    chance, chance_at = nested(output, PROBABILITY_KEYS)
    if chance is None:
        raise ValueError(f"no probabilities among {', '.join(map(str, output))}")
    label, label_at = nested(output, LABEL_KEYS)
    label, label_at = (chance, f"argmax of {chance_at}") if label is None else (label, label_at)
    labels, p = label_mask(label), np.squeeze(np.asarray(chance, np.float32))
    for axis in (2, 0):
        if p.ndim == 3 and np.moveaxis(p, axis, 2).shape[:2] == labels.shape:
            return labels, np.moveaxis(p, axis, 2), label_at, chance_at
    raise ValueError(f"probabilities {p.shape} don't fit labels {labels.shape}")


def in_order(left: DataFrame, right: DataFrame, order: str = "position") -> DataFrame:
    """Rows of both tables side by side by their position; an error where one has a position that the other lacks."""
    both = left.withColumn("in_left", F.lit(True)).join(right.withColumn("in_right", F.lit(True)), order, "full")
    whole = F.col("in_left").isNotNull() & F.col("in_right").isNotNull()
    return both.withColumn(order, F.when(whole, F.col(order)).otherwise(F.raise_error(F.concat(F.lit("no partner at position "), F.col(order).cast("string"))))).drop("in_left", "in_right")
