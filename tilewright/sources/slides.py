"""Scans of whole-slide images: headers, thumbnails and regions as DataFrames.

A slide is read through a ``SlideReader``; codecs plug in there. Readers are made once a partition, and rows come by slide, so that a
slide is opened once for consecutive rows. Pixels are bytes in row order (h, w, rgb), never arrays of numbers."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

HEADER = "slide_id long, slide_width long, slide_height long, level_count int, objective_power string, mpp_x double, mpp_y double, error string"


class SlideReader(Protocol):
    """Reads a level-0 box of a slide as (h, w, 3) bytes; called with boxes inside the slide only. ``header`` may lack any name but the
    sizes, ``thumbnail`` may be missing, and so may ``read_many``: small boxes of one size at once, (n, h, w, 3) by arrays of their corners."""

    def size(self, slide_id: int) -> tuple[int, int]: ...

    def read(self, slide_id: int, x: int, y: int, w: int, h: int) -> np.ndarray: ...

    def header(self, slide_id: int) -> dict: ...


#: What a pattern's channels add to its first, mod 256.
_STEPS = np.array([0, 71, 142], np.uint8)
#: A product of two numbers below 13, mod 13.
_REST = (np.arange(145) % 13).astype(np.uint8)


class PatternSlides:
    """A stand-in for a codec: whole numbers of a place's coordinates, and slides as wide and high as their number says."""

    def size(self, slide_id: int) -> tuple[int, int]:
        return 8192 + 1024 * (slide_id % 17), 6144 + 512 * (slide_id % 13)

    def read(self, slide_id: int, x: int, y: int, w: int, h: int) -> np.ndarray:
        xs, ys = np.arange(x, x + w), np.arange(y, y + h)[:, None]
        first = xs // 4 * 37 + (ys // 4 * 53 + slide_id * 29) + xs * ys % 13
        return (first.astype(np.uint8)[:, :, None] + _STEPS).astype(np.uint8)  # bytes wrap round: mod 256

    def read_many(self, slide_id: int, x: np.ndarray, y: np.ndarray, w: int, h: int) -> np.ndarray:
        xs, ys = x[:, None] + np.arange(w), y[:, None] + np.arange(h)
        first = _REST[(xs % 13).astype(np.uint8)[:, None, :] * (ys % 13).astype(np.uint8)[:, :, None]]
        first += (xs // 4 * 37).astype(np.uint8)[:, None, :]
        first += (ys // 4 * 53 + slide_id * 29).astype(np.uint8)[:, :, None]
        return first[..., None] + _STEPS

    def header(self, slide_id: int) -> dict:
        return {"level_count": 1 + slide_id % 4, "objective_power": None if slide_id % 5 == 0 else "40", "mpp": None if slide_id % 7 == 0 else (0.25, 0.25 + slide_id % 3 / 100)}


class NoSuchSlide(ValueError):
    pass


def header_of(reader: SlideReader, slide_id: int) -> dict:
    """A slide's header: level-0 sizes, and what the reader knows besides; a pair ``mpp`` fills mpp_x and mpp_y where they are missing."""
    known = dict(getattr(reader, "header", lambda _: {})(slide_id))
    width, height = reader.size(slide_id)
    pair = known.get("mpp") or (None, None)
    text = known.get("objective_power")
    return {
        "slide_id": slide_id,
        "slide_width": width,
        "slide_height": height,
        "level_count": known.get("level_count"),
        "objective_power": None if text is None else str(text),
        "mpp_x": known.get("mpp_x", pair[0]),
        "mpp_y": known.get("mpp_y", pair[1]),
    }


def read_padded(reader: SlideReader, slide_id: int, x: int, y: int, w: int, h: int) -> np.ndarray:
    """A box that may reach beyond the slide; what is outside is white."""
    width, height = reader.size(slide_id)
    out = np.full((h, w, 3), 255, np.uint8)
    x0, y0, x1, y1 = max(0, x), max(0, y), min(width, x + w), min(height, y + h)
    if x1 > x0 and y1 > y0:
        out[y0 - y : y1 - y, x0 - x : x1 - x] = reader.read(slide_id, x0, y0, x1 - x0, y1 - y0)
    return out


def read_clamped(reader: SlideReader, slide_id: int, x: int, y: int, w: int, h: int) -> np.ndarray:
    """The box moved inside the slide, as far as the slide is large enough, else the part inside."""
    width, height = reader.size(slide_id)
    x, y = max(0, min(x, width - w)), max(0, min(y, height - h))
    return reader.read(slide_id, x, y, min(w, width - x), min(h, height - y))


def resized(p: np.ndarray, size: int | None) -> np.ndarray:
    """The box as it is, or with ``size`` pixels a side."""
    if size is None or p.shape[:2] == (size, size):
        return p
    from tilewright.functions.raster import triangle

    return np.floor(np.clip(triangle(p.astype(float), size, size), 0, 255) + 0.5).astype(np.uint8)


def thumbnail(reader: SlideReader, slide_id: int, most: int) -> np.ndarray:
    """At most ``most`` cells a side: the reader's own, or else the pixel in the middle of each cell."""
    if hasattr(reader, "thumbnail"):
        return reader.thumbnail(slide_id, most)
    width, height = reader.size(slide_id)
    scale = max(1.0, max(width, height) / most)
    h, w = max(1, int(height / scale)), max(1, int(width / scale))
    place = lambda n, size: [min(size - 1, int((i + 0.5) * size / n)) for i in range(n)]
    return np.stack([np.concatenate([reader.read(slide_id, x, y, 1, 1)[0] for x in place(w, width)]) for y in place(h, height)])


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_HEADER = pa.schema([("slide_id", pa.int64()), ("slide_width", pa.int64()), ("slide_height", pa.int64()), ("level_count", pa.int32()), ("objective_power", pa.string()), ("mpp_x", pa.float64()), ("mpp_y", pa.float64()), ("error", pa.string())])


def scan_headers(slides: DataFrame, make_reader: Callable[[], SlideReader]) -> DataFrame:
    """A header row for each slide_id; a slide that can't be opened has its error instead."""

    def run(batches):
        reader = make_reader()
        for b in batches:
            rows = []
            for i in b.column("slide_id").to_pylist():
                try:
                    if i is None:
                        raise NoSuchSlide("no slide id")
                    rows.append(header_of(reader, i))
                except Exception as e:  # a slide that fails is a result
                    rows.append({"slide_id": i, "error": f"{type(e).__name__}: {e}"})
            yield _rows(rows, _HEADER)

    return slides.select("slide_id").mapInArrow(run, HEADER)


def scan_thumbnails(slides: DataFrame, make_reader: Callable[[], SlideReader], most: int = 1024) -> DataFrame:
    """slide_id, h, w, rgb of each slide."""

    def run(batches):
        reader = make_reader()
        for b in batches:
            for i in b.column("slide_id").to_pylist():  # a batch a slide: thumbnails are large
                t = thumbnail(reader, i, most)
                yield pa.RecordBatch.from_pydict({"slide_id": pa.array([i], pa.int64()), "h": pa.array([t.shape[0]], pa.int32()), "w": pa.array([t.shape[1]], pa.int32()), "rgb": pa.array([t.tobytes()], pa.binary())})

    return slides.select("slide_id").mapInArrow(run, "slide_id long, h int, w int, rgb binary")


def scan_regions(boxes: DataFrame, make_reader: Callable[[], SlideReader], margin: int = 0, size: int | None = None, clamp: bool = False) -> DataFrame:
    """All columns of the boxes (slide_id, x_level0, y_level0, patch_size, ..), and the pixels h, w, rgb of each: with ``margin`` more on every side, white
    beyond the slide, or moved inside with ``clamp``; resized to ``size`` a side if given. Rows stream by; a batch of results is a few MB."""
    columns = boxes.columns
    schema = StructType([*boxes.schema.fields, StructField("h", IntegerType()), StructField("w", IntegerType()), StructField("rgb", BinaryType())])
    reads = read_clamped if clamp else read_padded

    def run(batches):
        reader = make_reader()
        for b in batches:
            done, pixels, weight = 0, [], 0

            def out(upto):
                part = b.slice(done, upto - done)
                columns_ = {n: part.column(n) for n in columns}
                return pa.RecordBatch.from_pydict(columns_ | {"h": pa.array([p.shape[0] for p in pixels], pa.int32()), "w": pa.array([p.shape[1] for p in pixels], pa.int32()), "rgb": pa.array([p.tobytes() for p in pixels], pa.binary())})

            for k, (i, x, y, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("slide_id", "x_level0", "y_level0", "patch_size")))):
                p = resized(reads(reader, i, x - margin, y - margin, n + 2 * margin, n + 2 * margin), size)
                pixels.append(p)
                weight += p.size
                if weight > 4 << 20:
                    yield out(k + 1)
                    done, pixels, weight = k + 1, [], 0
            if pixels:
                yield out(b.num_rows)

    return by_band(boxes).mapInArrow(run, schema)


def by_band(boxes: DataFrame) -> DataFrame:
    """The boxes dealt out for reading: a large slide is many tasks, bands of it."""
    return boxes.repartition("slide_id", F.floor(F.col("y_level0") / 65536)).sortWithinPartitions("slide_id", "y_level0", "x_level0")


def tiles_of(reader: SlideReader, slides: np.ndarray, xs: np.ndarray, ys: np.ndarray, sides: np.ndarray, size: int | None = None) -> Iterator[np.ndarray | list[np.ndarray]]:
    """The boxes of ``scan_regions`` in their order, a few MB at once: small ones of a slide that follow one another, are of one size and lie inside it as an
    array, if the reader has ``read_many``, others as a list."""
    from tilewright.functions.raster import SMALL

    many = getattr(reader, "read_many", None)
    starts = np.flatnonzero(np.append(True, (slides[1:] != slides[:-1]) | (sides[1:] != sides[:-1])))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(slides)]):
        i, n = int(slides[a]), int(sides[a])
        width, height = reader.size(i)
        inside = (xs[a:b] >= 0) & (ys[a:b] >= 0) & (xs[a:b] + n <= width) & (ys[a:b] + n <= height)
        at_once = max(1, (4 << 20) // max(1, 3 * max(n * n, (size or 0) ** 2)))
        for k in range(a, b, at_once):
            m = min(b, k + at_once)
            if many is not None and n * n <= SMALL and size in (None, n) and inside[k - a : m - a].all():
                yield many(i, xs[k:m], ys[k:m], n, n)
            else:
                yield [resized(read_padded(reader, i, x, y, n, n), size) for x, y in zip(xs[k:m].tolist(), ys[k:m].tolist())]


def measured(boxes: DataFrame, make_reader: Callable[[], SlideReader], size: int | None = None) -> DataFrame:
    """The boxes with all 34 features of their pixels, as ``scan_regions`` reads them and ``with_features`` measures them, in one pass: no pixels go
    through the JVM. Rows stay where they are, and what has dealt them out holds for what follows; rows of a slide should lie together."""
    from tilewright.functions import raster

    @F.arrow_udf(StructType([StructField(f, DoubleType()) for f in raster.ALL_FEATURES]))
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        reader = make_reader()
        for columns in batches:
            parts = [raster.remembered(t) for t in tiles_of(reader, *[c.to_numpy() for c in columns], size)] if len(columns[0]) else []
            found = np.concatenate(parts, 1) if parts else np.zeros((len(raster.ALL_FEATURES), 0))
            yield pa.StructArray.from_arrays([pa.array(x) for x in found], raster.ALL_FEATURES)

    place = [F.col(c).cast("long") for c in ("slide_id", "x_level0", "y_level0", "patch_size")]
    return boxes.withColumn("__f", run(*place)).select(*boxes.columns, "__f.*")


class SlideSource(DataSource):
    """``spark.read.format("slides").option("reader", "module:factory").option("ids", "1,2,5-9").load()``: a header row a slide, a
    task for each run of ids. Register it with ``spark.dataSource.register(SlideSource)``."""

    @classmethod
    def name(cls) -> str:
        return "slides"

    def schema(self) -> str:
        return HEADER

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SlideSourceReader(self.options)


class _SlideSourceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.factory, self.ids = options["reader"], options["ids"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(part.strip()) for part in self.ids.split(",") if part.strip()]

    def read(self, partition: InputPartition):
        module, _, name = self.factory.partition(":")
        reader = getattr(importlib.import_module(module), name)()
        low, _, high = partition.value.partition("-")
        for i in range(int(low), int(high or low) + 1):
            h = header_of(reader, i)
            yield tuple(h.get(n) for n in _HEADER.names)
