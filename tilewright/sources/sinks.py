"""Sinks: Parquet tables first; CSV manifests, JSON documents and Markdown reports for what people read."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.sources.schemas import POOL, conform


def _stored(uri: str):
    """(file system, path) by Spark's own connectors, for paths that name one."""
    spark = SparkSession.getActiveSession()
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(path: str) -> bool:
    if "://" not in path:
        return Path(path).exists()
    files, p = _stored(path)
    return files.exists(p)


def guarded(path: str, overwrite: bool = False, forbidden: tuple[str, ...] = ()) -> str:
    """The path, if it may be written: not a root, a home or a forbidden folder, and empty unless to be overwritten."""
    if "://" in path:
        files, p = _stored(path)
        whole = lambda x: files.makeQualified(x).toString().rstrip("/")
        kept = {whole(files.getHomeDirectory())} | {whole(_stored(f)[1]) for f in forbidden if "://" in f}
        if p.getParent() is None or whole(p) in kept:
            raise ValueError(f"{path} must not be cleared")
        if not overwrite and files.exists(p) and len(files.listStatus(p)):
            raise FileExistsError(f"{path} isn't empty")
        return path
    p = Path(path).resolve()
    if p == Path(p.anchor) or p == Path.home().resolve() or str(p) in {str(Path(f).resolve()) for f in forbidden}:
        raise ValueError(f"{p} must not be cleared")
    if p.exists() and any(p.iterdir()) and not overwrite:
        raise FileExistsError(f"{p} isn't empty")
    return str(p)


def csv_manifest(df: DataFrame, path: str, schema: T.StructType, overwrite: bool = False) -> None:
    """Declared columns in order; a null is an empty cell, a list or map JSON text."""
    flat = conform(df, schema)
    flat = flat.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in schema.fields])
    flat.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("emptyValue", "").csv(path)


def parquet(df: DataFrame, path: str, by: list[str] | None = None, overwrite: bool = False) -> None:
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    (w.partitionBy(*by) if by else w).parquet(path)


def _text(text: str, path: str) -> None:
    """Written beside its place and moved there, so that readers see all or nothing."""
    if "://" in path:
        files, p = _stored(path)
        mine = p.suffix(f".{uuid.uuid4().hex}.part")
        out = files.create(mine, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        files.delete(p, False)
        if not files.rename(mine, p):
            raise OSError(f"{path} can't be written")
        return
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=Path(path).parent, suffix=".part")
    with os.fdopen(fd, "w") as f:
        f.write(text)
    os.replace(name, path)


def json_document(document: dict, path: str) -> None:
    """A small document, keys in order."""
    _text(json.dumps(document, indent=2, sort_keys=True) + "\n", path)


def shared_pool(pool: DataFrame, folder: str, case: str) -> str:
    """Pool rows in generation order, and a document with their digest; returns the digest."""
    from pyspark.sql import Window

    from tilewright.operators.stats import pool_hash

    rows = pool.withColumns({"case_id": F.lit(case), "generation_order": F.row_number().over(Window.partitionBy("slide_id").orderBy("candidate_id")), "level": F.lit(0)})
    parquet(conform(rows, POOL), f"{folder}/pool")
    got = pool_hash(pool).first()
    json_document({"case_id": case, "pool_hash": got["pool_hash"], "candidates": got["n"]}, f"{folder}/pool.json")
    return got["pool_hash"]


def embedding_cache(df: DataFrame, path: str, meta: dict, local: str | None = None) -> str:
    """Vectors by backend, model and case. A cache outside the run's folder is never replaced: where one is there, the rows go to
    ``local``. Returns the path written."""
    target = path
    if local is not None and exists(path):
        target = local
    parquet(df, f"{target}/vectors", overwrite=target == local)
    json_document(meta, f"{target}/meta.json")
    return target


def markdown_table(df: DataFrame, columns: list[str], most: int = 100) -> str:
    """The first rows as a Markdown table: made in Spark, at most ``most`` lines reach the driver."""
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rows = [r[0] for r in df.select(line).limit(most).collect()]
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *rows]) + "\n"


def report(title: str, sections: dict[str, str], path: str) -> None:
    _text(f"# {title}\n\n" + "\n".join(f"## {name}\n\n{text}\n" for name, text in sections.items()), path)
