"""Pixel and array files: tiles as PNG, arrays as .npy, written by tasks under an attempt's own name and moved into place; and scans of them."""

from __future__ import annotations

import io
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def store(uri: str):
    """(file system, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def put(uri: str, data: bytes) -> None:
    """Readers see the whole file or none."""
    files, path = store(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    mine = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(mine) as out:
        out.write(data)
    files.move(mine, path)


def get(uri: str) -> bytes:
    files, path = store(uri)
    with files.open_input_file(path) as f:
        return f.read()


def png(pixels: np.ndarray) -> bytes:
    """An RGB picture (h, w, 3) of bytes: one chunk of unfiltered rows."""
    h, w, _ = pixels.shape
    rows = np.zeros((h, 1 + 3 * w), np.uint8)
    rows[:, 1:] = pixels.reshape(h, 3 * w)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def png_pixels(data: bytes) -> np.ndarray:
    """The pixels (h, w, 3) of a PNG of eight-bit grey, RGB or RGBA that isn't interlaced; transparency is dropped."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
        body += part if kind == b"IDAT" else b""
        at += n + 12
    w, h, depth, colour, _, _, interlace = head
    bands = {0: 1, 2: 3, 6: 4}.get(colour)
    if depth != 8 or bands is None or interlace:
        raise ValueError("only eight-bit grey, RGB and RGBA pictures, not interlaced")
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * bands)
    out = np.zeros((h + 1, w + 1, bands), np.int32)  # a row and a column of zeros before the picture
    for y in range(h):
        kind, line = int(raw[y, 0]), raw[y, 1:].reshape(w, bands).astype(np.int32)
        up = out[y, 1:]
        if kind == 0:
            out[y + 1, 1:] = line
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line, 0) % 256
        elif kind == 2:
            out[y + 1, 1:] = (line + up) % 256
        else:
            for x in range(w):
                a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = np.stack([np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)])
                    guess = np.choose(p.argmin(0), [a, b, c])
                out[y + 1, x + 1] = (line[x] + guess) % 256
    picture = out[1:, 1:].astype(np.uint8)
    return np.repeat(picture, 3, 2) if bands == 1 else picture[..., :3].copy()


def export_tiles(tiles: DataFrame, folder: str, key: tuple[str, ...] = ("slide_id", "candidate_id")) -> DataFrame:
    """Writes a PNG for each row (key, rank, x_level0, y_level0, h, w, rgb), in a folder for each slide; returns key, path and bytes."""
    from tilewright.functions.raster import rasters

    name = F.format_string("slide_%s/patch_%04d_x%d_y%d.png", F.col(key[0]).cast("string"), F.col("rank") - 1, "x_level0", "y_level0")
    kinds = tiles.select(*key).schema.fields

    def run(batches):
        for b in batches:
            paths, sizes = [f"{folder}/{n}" for n in b.column("name").to_pylist()], []
            for path, pixels in zip(paths, rasters(b)):
                data = png(pixels)
                put(path, data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in key} | {"path": pa.array(paths, pa.string()), "n_bytes": pa.array(sizes, pa.int64())})

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kinds] + ["path string", "n_bytes long"])
    return tiles.select(*key, name.alias("name"), "h", "w", "rgb").mapInArrow(run, schema)


def scan_pictures(files: DataFrame) -> DataFrame:
    """path, h, w, rgb, error of PNG files (path); a file that can't be read has its error."""

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                try:
                    p, error = png_pixels(get(path)), None
                except Exception as e:  # a file that fails is a result
                    p, error = None, f"{type(e).__name__}: {e}"
                h, w, rgb = (None, None, None) if p is None else (p.shape[0], p.shape[1], p.tobytes())
                yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "h": pa.array([h], pa.int32()), "w": pa.array([w], pa.int32()), "rgb": pa.array([rgb], pa.binary()), "error": pa.array([error], pa.string())})

    return files.select("path").mapInArrow(run, "path string, h int, w int, rgb binary, error string")


def export_arrays(rows: DataFrame, folder: str, key: str, values: str) -> DataFrame:
    """Writes key.npy for each row, an array<double>; returns key and path."""

    def run(batches):
        for b in batches:
            paths = []
            for k, v in zip(b.column(key).to_pylist(), b.column(values).to_pylist()):
                out = io.BytesIO()
                np.save(out, np.array(v, float))
                paths.append(f"{folder}/{k}.npy")
                put(paths[-1], out.getvalue())
            yield pa.RecordBatch.from_pydict({key: b.column(key), "path": pa.array(paths, pa.string())})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, values).mapInArrow(run, f"{key} {kind}, path string")


def scan_arrays(files: DataFrame, shape: tuple[int, ...] | None = None) -> DataFrame:
    """path, shape, values of .npy files (path); an array of another shape than the one given is an error."""

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                a = np.load(io.BytesIO(get(path)), allow_pickle=False)
                if shape is not None and a.shape != shape:
                    raise ValueError(f"{path} has shape {a.shape}, not {shape}")
                yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "shape": pa.array([list(a.shape)], pa.list_(pa.int32())), "values": pa.array([a.astype(float).ravel()], pa.list_(pa.float64()))})

    return files.select("path").mapInArrow(run, "path string, shape array<int>, values array<double>")


def copy_files(files: DataFrame, folder: str) -> DataFrame:
    """Copies each file (path) into a folder, the bytes compared by digest; returns path, copy, n_bytes."""

    def run(batches):
        for b in batches:
            paths, copies, sizes = b.column("path").to_pylist(), [], []
            for path in paths:
                data = get(path)
                copies.append(f"{folder}/{path.rpartition('/')[2]}")
                put(copies[-1], data)
                if zlib.crc32(get(copies[-1])) != zlib.crc32(data):
                    raise OSError(f"{copies[-1]} differs from {path}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_pydict({"path": b.column("path"), "copy": pa.array(copies, pa.string()), "n_bytes": pa.array(sizes, pa.int64())})

    return files.select("path").mapInArrow(run, "path string, copy string, n_bytes long")
