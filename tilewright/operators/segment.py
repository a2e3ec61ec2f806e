"""Segmentation of selected tiles: validation, context reads, windowed inference, stitching, and a row for each tile.

Pixels come from a ``SlideReader`` and labels from a ``Segmenter``, both opened once in a worker process. A tile that fails is a row with
its error; the rest of its partition goes on."""

from __future__ import annotations

import time
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.sources.slides import SlideReader, read_padded


class Segmenter(Protocol):
    """Class probabilities (h_out, w_out, classes) of the middle of a window."""

    window_in: int
    window_out: int
    classes: int

    def __call__(self, window: np.ndarray) -> np.ndarray: ...


class SyntheticSlides:
    """A stand-in for a codec: smooth colours from a slide's number and a place's coordinates."""

    def __init__(self, dims: dict[int, tuple[int, int]]):
        self.dims = dims

    def size(self, slide_id: int) -> tuple[int, int]:
        return self.dims[slide_id]

    def read(self, slide_id: int, x: int, y: int, w: int, h: int) -> np.ndarray:
        xs, ys = np.arange(x, x + w)[None, :], np.arange(y, y + h)[:, None]
        wave = lambda a, b, c: 127.5 * (1 + np.sin(xs / a + slide_id) * np.cos(ys / b + c))
        return np.stack([wave(97, 83, 0), wave(61, 71, 1), wave(53, 113, 2)], -1).astype(np.uint8)


class BrightnessSegmenter:
    """A stand-in for a network: odds of five classes from brightness alone."""

    classes = 5

    def __init__(self, window_in: int = 1024, window_out: int = 512):
        self.window_in, self.window_out = window_in, window_out

    def __call__(self, window: np.ndarray) -> np.ndarray:
        m = (self.window_in - self.window_out) // 2
        grey = window[m : m + self.window_out, m : m + self.window_out].mean(-1) / 255
        odds = np.exp(-40 * (grey[..., None] - (np.arange(self.classes) + 0.5) / self.classes) ** 2)
        return odds / odds.sum(-1, keepdims=True)


def label_mask(prediction: np.ndarray, most_classes: int = 32) -> np.ndarray:
    """A label mask of two dimensions: single axes dropped, a class axis (first or last, few long) reduced by argmax."""
    p = np.squeeze(np.asarray(prediction))
    if p.ndim == 3:
        axis = 0 if p.shape[0] <= most_classes and p.shape[0] < p.shape[-1] else 2
        if p.shape[axis] > most_classes:
            raise ValueError(f"no class axis in {p.shape}")
        p = p.argmax(axis)
    if p.ndim != 2:
        raise ValueError(f"a label mask has two dimensions, not {p.shape}")
    return p.astype(np.int32)


def hann_weights(h: int, w: int, floor: float = 0.05) -> np.ndarray:
    m = np.outer(np.hanning(h) if h > 1 else np.ones(1), np.hanning(w) if w > 1 else np.ones(1))
    return np.maximum(floor, m / m.max()) if m.max() > 0 else np.ones((h, w))


def segment_tile(reader: SlideReader, net: Segmenter, slide_id: int, x: int, y: int, tile: int, stride: int | None = None, feathered: bool = False) -> dict:
    """Probabilities of a tile blended from windows. Without a stride, windows lie side by side; with one, they overlap. Raises where a
    place stays uncovered."""
    m, out = (net.window_in - net.window_out) // 2, net.window_out
    context = read_padded(reader, slide_id, x - m, y - m, tile + net.window_in, tile + net.window_in)
    total, weight, count = np.zeros((tile, tile, net.classes)), np.zeros((tile, tile)), np.zeros((tile, tile), int)
    for oy in range(0, tile, stride or out):
        for ox in range(0, tile, stride or out):
            p = net(context[oy : oy + net.window_in, ox : ox + net.window_in])
            h, w = min(out, tile - oy), min(out, tile - ox)
            k = hann_weights(h, w) if feathered else np.ones((h, w))
            total[oy : oy + h, ox : ox + w] += p[:h, :w] * k[..., None]
            weight[oy : oy + h, ox : ox + w] += k
            count[oy : oy + h, ox : ox + w] += 1
    if not count.all():
        raise ValueError("windows leave places uncovered")
    p = total / weight[..., None]
    best, label = p.max(-1), p.argmax(-1)
    entropy = -(p * np.log2(np.maximum(p, 1e-300))).sum(-1) / np.log2(net.classes)
    ids, n = np.unique(label, return_counts=True)
    return {"label": label, "counts": dict(zip(ids.tolist(), n.tolist())), "mean_max_probability": float(best.mean()), "median_max_probability": float(np.median(best)), "mean_entropy": float(entropy.mean()), "median_entropy": float(np.median(entropy)), "overlap": float((count > 1).mean())}


RESULT = "slide_id long, candidate_id string, status string, error string, prediction_shape array<int>, class_pixel_counts map<string,bigint>, class_pixel_ratios map<string,double>, mean_max_probability double, median_max_probability double, mean_entropy double, median_entropy double, runtime_seconds double"


def segment(selected: DataFrame, make_reader, make_net, tile: int = 1024, stride: int | None = None, feathered: bool = False) -> DataFrame:
    """One row a tile (slide_id, candidate_id, x_level0, y_level0). Tiles come by slide, so a slide is opened once a partition;
    ``make_reader()`` and ``make_net()`` run once a partition."""
    numbers = ("mean_max_probability", "median_max_probability", "mean_entropy", "median_entropy")

    def run(batches):
        reader = net = None
        for b in batches:
            rows = []
            for slide, candidate, x, y in zip(*(b.column(c).to_pylist() for c in ("slide_id", "candidate_id", "x_level0", "y_level0"))):
                began = time.perf_counter()
                row = {"slide_id": slide, "candidate_id": candidate}
                try:
                    if None in (slide, x, y):
                        row |= {"status": "skipped", "error": "no place"}
                    else:
                        reader, net = reader or make_reader(), net or make_net()
                        s = segment_tile(reader, net, slide, x, y, tile, stride, feathered)
                        n = sum(s["counts"].values())
                        row |= {"status": "completed", "prediction_shape": list(s["label"].shape), "class_pixel_counts": [(str(k), v) for k, v in s["counts"].items()], "class_pixel_ratios": [(str(k), v / n) for k, v in s["counts"].items()], **{k: s[k] for k in numbers}}
                except Exception as e:  # a failed tile is a result
                    row |= {"status": "failed", "error": f"{type(e).__name__}: {e}"}
                rows.append(row | {"runtime_seconds": time.perf_counter() - began})
            kinds = {"slide_id": pa.int64(), "candidate_id": pa.string(), "status": pa.string(), "error": pa.string(), "prediction_shape": pa.list_(pa.int32()), "class_pixel_counts": pa.map_(pa.string(), pa.int64()), "class_pixel_ratios": pa.map_(pa.string(), pa.float64()), **{k: pa.float64() for k in (*numbers, "runtime_seconds")}}
            yield pa.RecordBatch.from_pydict({k: pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()})

    dealt = selected.select("slide_id", "candidate_id", "x_level0", "y_level0").repartition("slide_id").sortWithinPartitions("slide_id", "y_level0", "x_level0")
    return dealt.mapInArrow(run, RESULT)


def input_faults(height: Column, width: Column, channels: Column, low: Column, high: Column, mpp: Column, tile: int = 1024, target_mpp: float = 0.25, tolerance: float = 0.05) -> Column:
    """What is wrong with a tile, as a list of warnings."""
    said = lambda test, text: F.when(test, F.lit(text))
    m = F.nullif(mpp, F.lit(0.0))
    every = F.array(
        said((height != tile) | (width != tile), "size differs from the tile"),
        said(channels != 3, "not three channels"),
        said((low < 0) | (high > 255), "values outside 0 to 255"),
        said(low == high, "constant tile"),
        said(m.isNull(), "resolution unknown"),
        said(F.abs(m - target_mpp) > tolerance, "resolution outside the tolerance"),
    )
    return F.filter(every, lambda w: w.isNotNull())


def metadata(selected: DataFrame, summary: DataFrame, config: DataFrame, fields: list[str], by: str = "slide_id") -> DataFrame:
    """Fields of each row by the first source that has them: row, summary, configuration; with the list of those that none has."""
    s, c = (d.select(by, *[F.col(f).cast("string").alias(f"{p}_{f}") for f in fields if f in d.columns]) for p, d in (("s", summary), ("c", config)))
    rows = selected.join(s, by, "left").join(c, by, "left")
    value = {}
    for f in fields:
        found = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in (f, f"s_{f}", f"c_{f}") if n in rows.columns]
        value[f] = F.coalesce(*found) if found else F.lit(None).cast("string")
    rows = rows.withColumns(value)
    missing = F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return rows.withColumn("missing_fields", missing).drop(*[n for n in rows.columns if n[:2] in ("s_", "c_") and n[2:] in fields])
