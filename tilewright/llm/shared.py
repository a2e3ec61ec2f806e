"""Shared storage, and views of Arrow text columns as byte arrays.

Tables that cut lineage go to the folder the cluster names in ``spark.checkpoint.dir``; the driver and all
executors see it, so a lost executor costs a retry and not the data.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a single machine without one, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="tilewright-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return f"file://{_own['dir']}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and is computed once."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``keep`` wrote, once nothing reads them any more; only folders in the shared one are touched."""
    for df in tables:
        spark = df.sparkSession
        place, conf = spark._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        base = place(shared_dir(spark))
        base = base.getFileSystem(conf).makeQualified(base)
        for folder in {place(f).getParent().toString() for f in df.inputFiles()}:
            if place(folder).getParent().equals(base):
                place(folder).getFileSystem(conf).delete(place(folder), True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, whatever the case of letters."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch, on both sides of the pipe to a Python worker; a longer row is a batch of its own. Spark's
#: default of 64 MB, several times over in each of two workers, would fill a small executor.
BATCH_BYTES = 2 << 20


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES):
    """Within it, actions send batches of about so many bytes to Python."""
    before = spark.conf.get(BYTES)
    spark.conf.set(BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(BYTES, before)


def use_small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """For results that are computed later, by whoever writes them: the session goes on with small batches. No result depends on it."""
    spark.conf.set(BYTES, str(size))


def filesystem(uri: str):
    """(file system, path) of a shared-folder URI, for code on executors that writes binary files."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


@contextmanager
def publishing(uri: str):
    """A stream to a file under a name of this attempt, moved into place at the end: retries and speculative copies of a
    task leave one whole file, whichever ends last. What is written must be deterministic."""
    files, path = filesystem(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    mine = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(mine) as out:
        yield out
    files.move(mine, path)


def text_bytes(array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string column; a null is an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()).fill_null("")
    _, offsets, data = array.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, edges[:-1], edges[1:]


def runs_of(starts: np.ndarray, ends: np.ndarray, most: int):
    """Consecutive ranges (i, j) of texts with about ``most`` bytes each; a longer text stands alone."""
    i = 0
    while i < len(starts):
        j = i + 1
        while j < len(starts) and ends[j] - starts[i] <= most:
            j += 1
        yield i, j
        i = j
