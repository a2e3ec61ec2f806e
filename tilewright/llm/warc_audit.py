"""WARC archives and their Merkle fixity audit.

``write_archive`` stores pages as WARC/1.0 ``resource`` records, one gzip member each, in files by range of page_id. Each file has
a Merkle tree over its records in order of offset: a leaf hashes the record's range (offset, length) and its stored
bytes, a node its two children; an odd node goes up as it is. Trees are kept apart from the files. Files number with the records,
so that what a task holds of one is bounded; records themselves stream by.

``audit`` hashes a replica's files at the recorded ranges, file by file and a record at a time, compares the roots, and only for files
whose roots differ goes down the tree, only into branches that differ, to the damaged records.

Defined cases: a null html is an empty payload; a null url leaves out its header line, and line ends in one are
percent-encoded; null page_ids come first, in files of their own; rows that repeat a page_id are records of their own, in order of their digests; an
empty table writes no file and gives an empty result; a replica without a file, or that ends early, has its records
``missing``; other columns of the input are ignored; payloads of any length are stored whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.ordering import pieces, ranges_of
from tilewright.llm.shared import filesystem, fresh_path, keep, publishing

#: Fixed value: the date of all records, so that archives are the same on every run.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
#: Records of a file, about: a task holds 64 bytes of tree and 16 of ranges for each.
RECORDS = 1 << 16

MANIFEST = "part int, path string, seq int, page_id long, offset long, length long, n_bytes long, record_sha256 string, tree binary"


def record(page_id, url, html) -> bytes:
    body = (html or "").encode()
    uri = "" if url is None else "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A") + "\r\n"
    head = f"WARC/1.0\r\nWARC-Type: resource\r\n{uri}WARC-Date: {DATE}\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    """One gzip member without name or time."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def leaf(offset: int, stored: bytes | None, length: int) -> bytes:
    if stored is None or len(stored) < length:
        return b"\0" * 32  # no digest: the range isn't there
    return hashlib.sha256(b"\0" + struct.pack("<QQ", offset, length) + stored).digest()


def levels(leaves: list[bytes]) -> list[list[bytes]]:
    """From the leaves up to the root."""
    out = [leaves]
    while len(out[-1]) > 1:
        below = out[-1]
        out.append([hashlib.sha256(b"\1" + below[i] + below[i + 1]).digest() if i + 1 < len(below) else below[i] for i in range(0, len(below), 2)])
    return out


def pack_tree(tree: list[list[bytes]]) -> bytes:
    """Root first."""
    return struct.pack("<I", len(tree[0])) + b"".join(chain.from_iterable(reversed(tree)))


def unpack_tree(raw: bytes) -> list[list[bytes]]:
    (n,) = struct.unpack_from("<I", raw)
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // 2))
    tree, at = [], 4
    for size in reversed(sizes):
        tree.append([raw[at + 32 * i : at + 32 * i + 32] for i in range(size)])
        at += 32 * size
    return tree


def differing_leaves(a: list[list[bytes]], b: list[list[bytes]]) -> tuple[list[int], int]:
    """Places of leaves that differ, and how many nodes were compared: trees come root first and only
    branches that differ are entered."""
    if len(a[-1]) != len(b[-1]):
        raise ValueError("trees of different ranges")
    at, seen = [0], 0
    for depth, (x, y) in enumerate(zip(a, b)):
        seen += len(at)
        at = [i for i in at if x[i] != y[i]]
        if depth + 1 < len(a):
            at = [c for i in at for c in (2 * i, 2 * i + 1) if c < len(a[depth + 1])]
    return at, seen


def _pack(batches):
    for b in batches:
        whole = [record(*r) for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")))]
        yield pa.RecordBatch.from_pydict({"part": b.column("part"), "page_id": b.column("page_id"), "stored": pa.array(map(packed, whole), pa.binary()), "n_bytes": pa.array(map(len, whole), pa.int64()), "record_sha256": pa.array([hashlib.sha256(w).hexdigest() for w in whole])})


def _write(folder: str):
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    listed = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    def run(batches):
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        part = first.column("part")[0].as_py()
        name, rows, leaves, at = f"{folder}/pages-{part:07d}.warc.gz", [], [], 0
        with publishing(name) as out:
            for b in chain([first], batches):
                if rows:
                    yield listed(rows)
                rows = []
                for page, stored, size, sha in zip(*(b.column(c).to_pylist() for c in ("page_id", "stored", "n_bytes", "record_sha256"))):
                    out.write(stored)
                    rows.append((part, name, len(leaves), page, at, len(stored), size, sha, None))
                    leaves.append(leaf(at, stored, len(stored)))
                    at += len(stored)
        rows[-1] = (*rows[-1][:-1], pack_tree(levels(leaves)))
        yield listed(rows)

    return run


def write_archive(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the files; returns the manifest, a row a record; the last record of a file carries its tree."""
    narrow = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    part, count = ranges_of(narrow, "page_id", [F.col("url"), F.col("html")], RECORDS)
    # Records are compressed before the shuffle, which moves less.
    stored = narrow.select(part.alias("part"), "page_id", "url", "html").mapInArrow(_pack, "part int, page_id long, stored binary, n_bytes long, record_sha256 string")
    dealt = stored.repartitionById(count, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("page_id"), "record_sha256")
    return keep(dealt.mapInArrow(_write(folder), MANIFEST), "warc-manifest")


def ranges(manifest: DataFrame) -> DataFrame:
    """One row a file: its name and its ranges in order."""
    spans = F.array_sort(F.collect_list(F.struct("offset", "length")))
    return manifest.groupBy("part").agg(F.first("path").alias("path"), spans.alias("spans"))


def _place(folder: str, path: str) -> str:
    return f"{folder}/{path.rpartition('/')[2]}"


def replicate(manifest: DataFrame, folder: str, damaged: Column) -> int:
    """Copies every file; in the records that ``damaged`` names, one byte of the stored range is changed. Returns the number of files."""
    spans = F.array_sort(F.collect_list(F.when(damaged, F.col("offset") + F.floor(F.col("length") / 2))))
    files = manifest.groupBy("part").agg(F.first("path").alias("path"), spans.alias("flips"))

    def run(batches):
        for b in batches:
            for path, flips in zip(b.column("path").to_pylist(), b.column("flips").to_pylist()):
                fs, name = filesystem(path)

                with fs.open_input_file(name) as f, publishing(_place(folder, path)) as out:
                    at, size, k = 0, f.size(), 0
                    while at < size:
                        data = bytearray(f.read(min(1 << 20, size - at)))
                        while k < len(flips) and flips[k] < at + len(data):
                            data[flips[k] - at] ^= 0x20
                            k += 1
                        out.write(bytes(data))
                        at += len(data)
            yield pa.RecordBatch.from_pydict({"copied": pa.array([b.num_rows], pa.int64())})

    spread = files.repartition(pieces(manifest.sparkSession), "part").select("path", "flips")
    return keep(spread.mapInArrow(run, "copied long"), "warc-copies").agg(F.coalesce(F.sum("copied"), F.lit(0))).first()[0]


def replica_trees(manifest: DataFrame, folder: str) -> DataFrame:
    """part, tree of each file of the replica, from its bytes at the recorded ranges."""

    def run(batches):
        for b in batches:
            out = []
            for path, spans in zip(b.column("path").to_pylist(), b.column("spans").to_pylist()):
                fs, name = filesystem(_place(folder, path))
                try:
                    with fs.open_input_file(name) as f:
                        size = f.size()
                        leaves = [leaf(s["offset"], f.read_at(s["length"], s["offset"]) if s["offset"] < size else None, s["length"]) for s in spans]
                except FileNotFoundError:
                    leaves = [leaf(s["offset"], None, s["length"]) for s in spans]
                out.append(pack_tree(levels(leaves)))
            yield pa.RecordBatch.from_pydict({"part": b.column("part"), "tree": pa.array(out, pa.binary())})

    spread = ranges(manifest).repartition(pieces(manifest.sparkSession), "part")
    return keep(spread.mapInArrow(run, "part int, tree binary"), "warc-trees")


def _descend(batches):
    for b in batches:
        part, seq, gone = [], [], []
        for p, mine, theirs in zip(*(b.column(c).to_pylist() for c in ("part", "mine", "theirs"))):
            a, t = unpack_tree(mine), unpack_tree(theirs)
            for i in differing_leaves(a, t)[0]:
                part.append(p)
                seq.append(i)
                gone.append(t[-1][i] == b"\0" * 32)
        yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "seq": pa.array(seq, pa.int32()), "gone": pa.array(gone, pa.bool_())})


def audit(manifest: DataFrame, folder: str) -> DataFrame:
    """The manifest's records with ``status``: ok, corrupt or missing in the replica."""
    mine = manifest.where("tree is not null").select("part", F.col("tree").alias("mine"))
    both = mine.join(replica_trees(manifest, folder).withColumnRenamed("tree", "theirs"), "part")
    root = lambda c: F.substring(c, 5, 32)
    bad = both.where(root("mine") != root("theirs")).select("part", "mine", "theirs").mapInArrow(_descend, "part int, seq int, gone boolean")
    status = F.when(F.col("gone").isNull(), "ok").when(F.col("gone"), "missing").otherwise("corrupt")
    return manifest.drop("tree").join(bad, ["part", "seq"], "left").select("page_id", "path", "seq", "offset", "length", "n_bytes", "record_sha256", status.alias("status"))


def archive_and_audit(pages: DataFrame, damaged: Column) -> DataFrame:
    """Archives the pages, makes a replica with damage in the records that ``damaged`` names, and audits it."""
    base = fresh_path(pages.sparkSession, "warc")
    manifest = write_archive(pages, f"{base}/primary")
    replicate(manifest, f"{base}/replica", damaged)
    return audit(manifest, f"{base}/replica")
