"""Document fingerprints as a homomorphic multiset hash.

A paragraph (a line that isn't blank) is hashed into a wide vector of three parts: 8 words modulo 2**64 from its digest, the
number of its sentences modulo 2**64, and 192 counters modulo 2**32, each the sum over its sentences of a rounded Cauchy
variate drawn by the sentence's hash. A document's fingerprint is the sum of its paragraphs' vectors, so it doesn't depend on
their order, and paragraphs are put in or taken out by adding or subtracting their vectors. Blank lines are no
paragraphs: they alone don't change a fingerprint.

The words make equality reliable. The counters keep distance: the Cauchy distribution is 1-stable, so the median size of
the counters' differences estimates how many sentences the multiset difference has, each repeat counted once, to about
11 % of itself. Likeness is 1 less that number over the sentences of both: twice the shared sentences over all. Differences
are right up to some 2**27 sentences, from where the counters' modulus hides more.

Defined cases: a null text is empty; an empty or blank text has the zero vector and likeness 1 to another such
text, 0 to any other; rows are ordered by descending doc_id (null last), rows of one doc_id by their text; with
one row, the next document is the row itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.ordering import bucket, id_bounds, pieces
from tilewright.llm.shingles import U, mix

WORDS, COUNTERS = 8, 192
#: Quantiles of the Cauchy distribution, and what a variate of 1 counts.
UNIT = 16
CAUCHY = np.rint(UNIT * np.tan(np.pi * ((np.arange(1 << 16) + 0.5) / (1 << 16) - 0.5))).astype(np.int32)
DRAWS = np.arange(1, COUNTERS // 4 + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
#: Words (the last one counts sentences), counters.
Vector = tuple[np.ndarray, np.ndarray]


def paragraphs(text: str) -> list[str]:
    return [p for p in text.split("\n") if p.strip()]


def sentences(paragraph: str) -> list[str]:
    return paragraph.split(". ")


def vector(parts: list[str]) -> Vector:
    """Sum of the vectors of these paragraphs."""
    digests = b"".join(hashlib.blake2b(p.encode(), digest_size=8 * WORDS).digest() for p in parts)
    hashes = np.frombuffer(b"".join(hashlib.blake2b(s.encode(), digest_size=8).digest() for p in parts for s in sentences(p)), "<u8")
    words = np.append(np.frombuffer(digests, "<u8").reshape(-1, WORDS).sum(0, dtype=np.uint64), U(len(hashes)))
    counters = np.zeros(COUNTERS, np.int64)
    for i in range(0, len(hashes), 4096):
        draws = mix(hashes[i : i + 4096, None] ^ DRAWS)
        counters += CAUCHY[draws.view(np.uint16)].sum(0, dtype=np.int64)
    return words, counters.astype(np.uint32)


def insert(v: Vector, parts: list[str]) -> Vector:
    w = vector(parts)
    return v[0] + w[0], v[1] + w[1]


def delete(v: Vector, parts: list[str]) -> Vector:
    w = vector(parts)
    return v[0] - w[0], v[1] - w[1]


def render(v: Vector) -> str:
    return base64.b64encode(v[0].astype("<u8").tobytes() + v[1].astype("<u4").tobytes()).decode()


def parse(text: str) -> Vector:
    raw = base64.b64decode(text)
    return np.frombuffer(raw[: 8 * WORDS + 8], "<u8"), np.frombuffer(raw[8 * WORDS + 8 :], "<u4")


def likeness(a: Vector, b: Vector) -> float:
    """0 to 1: twice the shared sentences over all sentences, repeats counted, estimated from the counters; 1 for equal fingerprints."""
    if (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    apart = float(np.median(np.abs((a[1] - b[1]).astype(np.int32).astype(np.float64)))) / UNIT
    mine, theirs = int(a[0][WORDS]), int(b[0][WORDS])
    apart = min(mine + theirs, max(abs(mine - theirs), apart))  # what the numbers of sentences leave possible
    return 1 - apart / max(1, mine + theirs)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every document row (the operator by itself: no shuffle)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "fingerprint": pa.array([render(vector(paragraphs(t or ""))) for t in b.column("text").to_pylist()], pa.string())})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(batches):
    """Rows come by part, in order; a halo row only ends a part."""
    rows = []

    def flush():
        b = pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())))})
        rows.clear()
        return b

    last = None
    for b in batches:
        for part, halo, doc, text in zip(*(b.column(n).to_pylist() for n in ("part", "halo", "doc_id", "text"))):
            text = text or ""
            own = vector(paragraphs(text))
            if last is not None and last[0] == part:
                _, d, t, v = last
                half = len(t) // 2
                edited = t[: len(t) - half] + text[:half]
                w = vector(paragraphs(edited))
                rows.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), render(v), render(w), likeness(v, w), likeness(v, own)))
            last = None if halo else (part, doc, text, own)
        if rows:
            yield flush()
    if rows:
        yield flush()


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each document beside its successor by descending doc_id, and beside its own text with the last half replaced
    by the start of the successor's.

    The ids are cut into even ranges; a range is one task, sorted there, and gets one row more: the first document
    of the next range. So no order over the whole table meets in one task, and each text moves once."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    count = pieces(docs.sparkSession)
    bounds = id_bounds(narrow, "doc_id", count)
    part = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(bucket(F.col("doc_id"), bounds))
    # From the id column alone: the largest id of each range. At most as many rows as there are ranges.
    tops = {r[0]: r[1] for r in narrow.select(part.alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id")).collect()}
    order = sorted(tops, reverse=True)
    goes = {tops[p]: order[i - 1] for i, p in enumerate(order)}  # the first of range p ends the range before it
    rows = narrow.select(part.alias("part"), F.lit(0).alias("halo"), "doc_id", "text")
    halo = None
    if goes:
        ids = [i for i in goes if i is not None]
        to = F.create_map(*[x for i in ids for x in (F.lit(i).cast("long"), F.lit(goes[i]))]) if ids else None
        firsts = narrow.where(F.col("doc_id").isin(ids)) if ids else narrow.where("false")
        firsts = firsts.groupBy("doc_id").agg(F.min("text").alias("text")).select(to[F.col("doc_id")].alias("part"), F.lit(1).alias("halo"), "doc_id", "text") if ids else None
        if None in goes:
            blank = narrow.where("doc_id is null").groupBy().agg(F.min("text").alias("text")).select(F.lit(goes[None]).alias("part"), F.lit(1).alias("halo"), F.lit(None).cast("long").alias("doc_id"), "text")
            firsts = blank if firsts is None else firsts.unionByName(blank)
        halo = firsts
    if halo is not None:
        rows = rows.unionByName(halo)
    placed = rows.withColumn("at", F.col("part") + 1).repartitionById(len(bounds) + 2, F.col("at")).sortWithinPartitions("part", "halo", F.desc_nulls_last("doc_id"), "text")
    return placed.select("part", "halo", "doc_id", "text").mapInArrow(_neighbours, OUT)
