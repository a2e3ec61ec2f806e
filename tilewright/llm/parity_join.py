"""N-gram Jaccard self-join by parity sketches.

A document's sketch has one bit a cell, the parity of the shingles that hash there: it is their cells' exclusive or. It is kept at
two widths. The wide one has 2**64 cells, few of them set; it is cut into classes, ranges of cells in order, and a
class is known by its key, the exclusive or of its set cells' numbers. The narrow one is the wide one folded modulo a power of two, and is
stored as bits. Two properties carry the join:

* A shingle that only one of two sets has flips one cell, at either width. So at most |A ^ B| classes differ, and the Hamming
  distance of the narrow sketches is at most |A ^ B|. A similarity of t bounds |A ^ B| by
  d = (1 - t) / (1 + t) * (|A| + |B|), a ninth of both sizes at 0.8.
* Pigeonhole: take the classes that are not empty in order. The first one that is the same in both documents comes
  after at most d classes that differ, so it is among the first d + 1 of each. A document's keys are those d + 1
  classes; documents that link share a key. If no class were the same, both documents would have at most d classes that
  are not empty; documents with so few have one more key in common, so that none is lost.

The number of classes is fixed for a band of sizes, so that both documents have the same classes; a document is
keyed in its own band, and in the band below if a partner could be there. The number of classes leaves all but one document
in 1e15 with more than d that aren't empty.

Copies and hot keys: documents of one set are linked to the least of them at once. A key's documents first form a
star around the least, not all pairs; after the links found are contracted, only keys that still hold several
components go on. Their rows meet in cells of at most two blocks, with their sketches; a cell gives out only the pairs across
components whose Hamming distance allows a link, and where these are many, first the closest of each row. So groups
of near copies cost rows in proportion to their size, and no link between components is lost.

Every candidate is verified on the sets of 64-bit shingle hashes, made again from the two whole texts: sizes and intersections are exact
but for two shingles of a pair with one hash (1e-12 for a pair of long texts). A star's center travels once for each
block of its members, and its set is held while they stream by.

Defined cases: a null or empty text has an empty set and links with nothing; a null doc_id takes no part and is its
own row (component null); rows that repeat a doc_id are one node, linked by any of their texts, and are returned
one by one; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.components import components
from tilewright.llm.ordering import pieces
from tilewright.llm.shared import drop, keep, small_batches, text_bytes, unused
from tilewright.llm.shingles import U, mix, shingle_sets

#: Similarity in hundredths, and words of a shingle.
SIMILARITY, WORDS = 80, 5
#: Sizes below this share a band with 2**20 classes; above, a band's sizes grow by half.
SMALL = 32
#: Members of a star that are verified with one copy of the center's text; rows of a block of a hot key.
STAR_BLOCK, KEY_BLOCK = 128, 512
#: Rows of ids up to which they are broadcast to the texts (8 to 24 bytes each); beyond, both sides shuffle.
MAX_BROADCAST_ROWS = 100_000
#: Key of documents with few classes that aren't empty, in each band.
FEW_CLASSES = 1 << 39

PROFILE = "doc_id long, n_shingles long, h1 long, h2 long, sketch binary, keys array<long>"


def band_of(size: int) -> int:
    """0 for sizes under SMALL, then k for [SMALL * 1.5**(k-1), SMALL * 1.5**k)."""
    band = 0
    while size >= band_top(band):
        band += 1
    return band


@cache
def band_top(band: int) -> int:
    """The size at which a band ends."""
    top = SMALL
    for _ in range(band):
        top = -(-3 * top // 2)
    return top


@cache
def classes_of(band: int) -> int:
    """The least number of classes, so that classes are large and select well, that leaves documents of the band's least, middle
    and largest size at least their keys' number of classes that aren't empty, with eight standard deviations to spare."""
    if band == 0:
        return 1 << 20
    low, high = band_top(band - 1), band_top(band) - 1
    r = max(4, high // 4)
    while True:
        for size in (low, (low + high) // 2, high):
            empty = math.exp(-size / r)
            spread = math.sqrt(r * empty * max(0.0, 1 - (1 + size / r) * empty))
            if r * (1 - empty) - most_apart(size, size * 100 // SIMILARITY) < 8 * spread:
                break
        else:
            return r
        r += 1


def most_apart(a: int, b: int) -> int:
    """Largest |A ^ B| of linked sets of these sizes."""
    return (100 - SIMILARITY) * (a + b) // (100 + SIMILARITY)


def cells_of(size: int) -> int:
    """Bits of the parity sketch: a power of two, at least two for a shingle."""
    return max(64, 1 << (2 * size - 1).bit_length())


def keys_of(s: np.ndarray) -> np.ndarray:
    """Keys of a sorted set of shingle hashes."""
    n = len(s)
    own, out = band_of(n), []
    for band in (own, own - 1):
        if band < 0:
            break
        high = band_top(band)
        if band == own:
            d = most_apart(n, n * 100 // SIMILARITY)
        else:
            if -(-n * SIMILARITY // 100) >= high:
                break
            d = most_apart(n, high - 1)
        if n == 0 or (d == 0 and n > 0):
            continue  # only equal sets are that like, and they are linked already
        r = classes_of(band)
        cls = ((s >> U(32)) * U(r)) >> U(32)  # rising with s, so a class is a run
        first = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))[: d + 2]
        upto = first[d + 1] if len(first) > d + 1 else n
        first = first[: d + 1]
        xor = np.bitwise_xor.reduceat(s[:upto], first)
        out.append(mix(xor ^ mix(cls[first] + U((band + 1) << 40))))
        if len(first) <= d:
            out.append(mix(np.array([FEW_CLASSES + band], np.uint64)))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def sketch_of(s: np.ndarray) -> bytes:
    m = cells_of(len(s))
    return np.packbits((np.bincount((s & U(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def _profile(batches):
    for b in batches:
        n, h1, h2, sketch, keys, edge = [], [], [], [], [], [0]
        for s, doc in zip(shingle_sets(*text_bytes(b.column("text")), WORDS), b.column("doc_id").to_pylist()):
            n.append(len(s))
            h1.append(int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0)
            h2.append(int(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
            sketch.append(sketch_of(s) if len(s) else None)
            k = keys_of(s) if doc is not None else np.zeros(0, np.int64)
            keys.append(k)
            edge.append(edge[-1] + len(k))
        lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_shingles": pa.array(n, pa.int64()), "h1": pa.array(h1, pa.int64()), "h2": pa.array(h2, pa.int64()), "sketch": pa.array(sketch, pa.binary()), "keys": lists})


def _stars(batches):
    """Rows (key, doc_id) come sorted, ranges of them by partition. Emits (key, center, doc_id) for the documents of each key that
    has two or more here, and the centers of the partition's first and last key, which may go on in another."""
    names = ["key", "center", "doc_id", "edge"]

    def rows(key, center, doc, edge):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(center, pa.int64()), pa.array(doc, pa.int64()), pa.array(edge, pa.bool_())], names=names)

    held = None  # key, center, last document, whether the center is out
    for b in batches:
        key, doc = (b.column(n).to_numpy(zero_copy_only=False) for n in ("key", "doc_id"))
        if not len(key):
            continue
        if held is None:
            yield rows(key[:1], doc[:1], doc[:1], [True])
        else:
            key, doc = np.concatenate([[held[0], held[0]], key]), np.concatenate([[held[1], held[2]], doc])
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        key, doc = key[new], doc[new]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.concatenate([at, [len(key)]]))
        center = np.repeat(doc[at], n)
        out = np.repeat(n > 1, n)
        if held is not None:
            if held[3]:
                out[0] = False
            if held[2] != held[1]:
                out[1] = False  # the last document of the batch before is out
        yield rows(key[out], center[out], doc[out], np.zeros(int(out.sum()), bool))
        more = n[-1] > 1 or (held is not None and len(at) == 1 and held[3])
        held = (key[-1], doc[at[-1]], doc[-1], bool(more))
    if held is not None:
        yield rows([held[0]], [held[1]], [held[1]], [True])


def _verify(batches):
    """Rows by star block: the center's text first, then its members'."""
    at, sets = None, []
    for b in batches:
        a, b_id, left, right = [], [], b.column("center").to_pylist(), b.column("doc_id").to_pylist()
        for center, salt, member, doc, s in zip(left, b.column("salt").to_pylist(), b.column("member").to_pylist(), right, shingle_sets(*text_bytes(b.column("text")), WORDS)):
            if (center, salt) != at:
                at, sets = (center, salt), []
            if not member:
                sets.append(s)
            else:
                for c in sets:
                    both = len(np.intersect1d(c, s, assume_unique=True))
                    if both and 100 * both >= SIMILARITY * (len(c) + len(s) - both):
                        a.append(center)
                        b_id.append(doc)
                        break
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b_id, pa.int64())})


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole texts link, by one shuffle of the texts that pairs name."""
    blocks = keep(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR_BLOCK).alias("blocks")).where("blocks > 1"), "blocks")
    salt = F.coalesce(F.pmod(F.xxhash64("b"), "blocks"), F.lit(0)).cast("int")
    salted = pairs.join(blocks, "a", "left").select(F.col("a").alias("center"), F.col("b").alias("doc_id"), salt.alias("salt"))
    salted = keep(salted, "pairs")
    heads = salted.select("center", "salt").distinct().select("center", "salt", F.lit(0).alias("member"), F.col("center").alias("doc_id"))
    wanted = heads.unionByName(salted.select("center", "salt", F.lit(1).alias("member"), "doc_id"))
    wanted = F.broadcast(wanted) if salted.count() <= MAX_BROADCAST_ROWS else wanted
    texts = docs.where("doc_id is not null").join(wanted, "doc_id")
    n = pieces(docs.sparkSession)
    dealt = texts.repartition(n, "center", "salt").sortWithinPartitions("center", "salt", "member", "doc_id")
    found = keep(dealt.select("center", "salt", "member", "doc_id", "text").mapInArrow(_verify, "a long, b long"), "verified")
    drop(salted, blocks)
    return found


def _folded(sketch: int, cells: int, to: int) -> int:
    """The sketch with its cells modulo a smaller power of two."""
    while cells > to:
        cells //= 2
        sketch = (sketch ^ (sketch >> cells)) & ((1 << cells) - 1)
    return sketch


def _could_link(n: int, a: bytes, m: int, b: bytes) -> bool:
    """Whether sizes and sketches allow a link."""
    if 100 * min(n, m) < SIMILARITY * max(n, m):
        return False
    to = 8 * min(len(a), len(b))
    x, y = (_folded(int.from_bytes(s, "little"), 8 * len(s), to) for s in (a, b))
    return (x ^ y).bit_count() <= most_apart(n, m)


def _sieve(batches):
    for b in batches:
        keep_ = [_could_link(*row) for row in zip(*(b.column(c).to_pylist() for c in ("n_a", "s_a", "n_b", "s_b")))]
        yield b.select(["a", "b"]).filter(pa.array(keep_, pa.bool_()))


def sieved(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs that their sizes and sketches allow to link."""
    side = lambda c: known.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "s_a", "n_b", "s_b")
    return both.mapInArrow(_sieve, "a long, b long")


#: A cell of rows that holds more possible pairs than this times its rows first tries only the closest of each row.
MANY = 32


def _cell_pairs(node, root, side, n, sketch, one: bool, every: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of a cell across components that could link; and whether there are more than were given out."""
    m = len(node)
    if m <= 8:
        found = [(node[i], node[j]) for i in range(m) for j in range(i + 1, m) if root[i] != root[j] and (one or side[i] != side[j]) and _could_link(n[i], sketch[i], n[j], sketch[j])]
        a, b = (np.array([p[k] for p in found], np.int64) for k in (0, 1))
        return a, b, False
    cells = 8 * min(map(len, sketch))
    bits = np.stack([np.frombuffer(_folded(int.from_bytes(s, "little"), 8 * len(s), cells).to_bytes(cells // 8, "little"), np.uint8) for s in sketch])
    d, r, z, w = np.array(node, np.int64), np.array(root, np.int64), np.array(n, np.int64), np.array(side, np.int8)
    rows, partners, closest, total = [], [], [], 0
    for i in range(m - 1):
        j = np.arange(i + 1, m, dtype=np.int32)
        ok = (r[j] != r[i]) & (100 * np.minimum(z[j], z[i]) >= SIMILARITY * np.maximum(z[j], z[i]))
        j = j[ok if one else ok & (w[j] != w[i])]
        if not len(j):
            continue
        far = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
        near = far <= (100 - SIMILARITY) * (z[j] + z[i]) // (100 + SIMILARITY)
        if near.any():
            closest.append((i, int(j[np.argmin(far)])))
            total += int(near.sum())
            if every or total <= MANY * m:
                rows.append(i)
                partners.append(j[near])
    if every or total <= MANY * m:
        i = np.repeat(np.array(rows, np.int32), [len(x) for x in partners])
        j = np.concatenate(partners) if partners else i
        return d[i], d[j], False
    i, j = np.array(closest).T
    return d[i], d[j], True


def _cells(every: bool):
    """Rows (key, ci, cj, node, root, side, n_shingles, sketch) come sorted by cell; a cell has at most two blocks of a key."""
    names = ("key", "ci", "cj", "node", "root", "side", "n_shingles", "sketch")

    def run(batches):
        held, cell = [[] for _ in names[3:]], None

        def close():
            if cell is None or len(held[0]) < 2:
                return []
            a, b, more = _cell_pairs(*held, one=cell[1] == cell[2], every=every)
            return [(cell[0], np.minimum(a, b), np.maximum(a, b), more)] if len(a) else []

        for batch in batches:
            out: list = []
            key, ci, cj = (batch.column(c).to_numpy() for c in names[:3])
            rest = [batch.column(c).to_pylist() for c in names[3:]]
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (ci[1:] != ci[:-1]) | (cj[1:] != cj[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if i == j:
                    continue
                at = (int(key[i]), int(ci[i]), int(cj[i]))
                if at != cell:
                    out += close()
                    held, cell = [[] for _ in names[3:]], at
                    if sum(len(x[1]) for x in out[-1:]) > 10_000 or len(out) > 10_000:
                        yield _pair_rows(out)
                        out = []
                for h, x in zip(held, rest):
                    h += x[i:j]
            yield _pair_rows(out)
        yield _pair_rows(close())

    return run


def _pair_rows(out: list) -> pa.RecordBatch:
    n = [len(x[1]) for x in out]
    join = lambda k: np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64)
    columns = [pa.array(np.repeat(np.array([x[0] for x in out], np.int64), n)), pa.array(join(1)), pa.array(join(2)), pa.array(np.repeat(np.array([x[3] for x in out], bool), n))]
    return pa.RecordBatch.from_arrays(columns, names=["key", "a", "b", "more"])


def _block_pairs(left: DataFrame, known: DataFrame, every: bool) -> DataFrame:
    """Rows (key, n, node, root) to key, a, b, more: possible pairs across components within each key. The key's n rows are cut into blocks; each pair of blocks is a
    cell, so no task holds more than two blocks of a key."""
    sketches = known.select(F.col("doc_id").alias("node"), "n_shingles", "sketch")
    sized = left.withColumn("blocks", F.ceil(F.col("n") / KEY_BLOCK).cast("int"))
    placed = sized.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("key", "node", "root", F.least("block", "other").alias("ci"), F.greatest("block", "other").alias("cj"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    dealt = cells.join(sketches, "node").repartition(pieces(left.sparkSession), "key", "ci", "cj").sortWithinPartitions("key", "ci", "cj", "node")
    return dealt.select("key", "ci", "cj", "node", "root", "side", "n_shingles", "sketch").mapInArrow(_cells(every), "key long, a long, b long, more boolean").where("a <> b")


def _edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("root").alias("a"), F.col("node").alias("b"))


def similar_documents(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    with small_batches(docs.sparkSession):
        return _similar(docs)


def _similar(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = pieces(docs.sparkSession)
    profile = keep(docs.mapInArrow(_profile, PROFILE), "profile")
    known = profile.where("n_shingles > 0 and doc_id is not null")

    # Documents of equal sets hang on the least of them.
    least = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    least = keep(least, "equal-sets")  # read again, it is broadcast where small, and else the join can split a hot set
    equal = known.select("doc_id", "h1", "h2").join(least, ["h1", "h2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    equal = keep(equal, "equal")
    reps = keep(equal.groupBy("b").agg(F.min("a").alias("rep")), "reps")  # a doc_id may repeat

    def to_rep(df: DataFrame, col: str) -> DataFrame:
        return df.join(reps.withColumnRenamed("b", col), col, "left").withColumn(col, F.coalesce("rep", col)).drop("rep")

    # Stars of the keys; a key cut by a partition's edge has several centers, and these form a star again.
    keyed = known.where("size(keys) > 0").select(F.explode("keys").alias("key"), "doc_id")
    stars = keyed.repartitionByRange(n, "key", "doc_id").sortWithinPartitions("key", "doc_id").mapInArrow(_stars, "key long, center long, doc_id long, edge boolean")
    stars = keep(stars, "stars")
    edges = stars.where("edge").select("key", "center").distinct()
    edges = edges.join(edges.groupBy("key").agg(F.min("center").alias("first")), "key").where("center <> first").select(F.col("first").alias("a"), F.col("center").alias("b"))
    pairs = stars.where("not edge and center <> doc_id").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct().unionByName(edges)
    pairs = to_rep(to_rep(pairs, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = keep(sieved(pairs, known), "tried")
    links = verified(tried, docs)
    roots = components(links)
    drop(links)

    # Keys that still hold several components; of keys with the same documents, one.
    keys, every = None, False
    while True:
        rooted = lambda df: to_rep(df.withColumnRenamed("doc_id", "node"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).distinct()  # noqa: E731, B023
        left = stars.select("key", "doc_id") if keys is None else stars.select("key", "doc_id").join(keys, "key", "left_semi")
        mark = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"m{i}") for i in (0, 1)]
        several = rooted(left).groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), *mark).where("low < high")
        several = keep(several.groupBy("m0", "m1", "n").agg(F.min("key").alias("key")).select("key", "n"), "several")
        found = keep(_block_pairs(rooted(stars.select("key", "doc_id").join(several, "key")), known, every), "possible")
        new = keep(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "tried")
        some, more = not new.isEmpty(), keep(found.where("more").select("key").distinct(), "keys")
        drop(several, found, *([keys] if keys is not None else []))
        keys, before = more, roots
        if some:
            fresh = verified(new, docs)
            roots = components(_edges(before).unionByName(fresh))
            tried = tried.unionByName(new)
            drop(fresh)
        if every or keys.isEmpty():
            break
        every = not some or roots.count() == before.count()  # the closest pairs bring nothing more: try all

    # Components of all nodes, named by their least doc_id; a node without links is its own.
    everyone = profile.select("doc_id", "n_shingles")
    whole = components(_edges(roots).unionByName(equal))
    drop(least, equal, reps, stars, tried, roots, keys)
    return everyone.join(whole.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def drop_similar(docs: DataFrame) -> DataFrame:
    """The documents, less all but the one with the least doc_id of each component; all columns stay. Of rows that repeat a doc_id
    one stays, the least by text; documents without words, and rows with a null doc_id, stay."""
    found = keep(similar_documents(docs), "similar")
    losers = keep(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    losers = F.broadcast(losers) if losers.count() <= MAX_BROADCAST_ROWS else losers  # beyond, the texts shuffle once
    rest = docs.join(losers, "doc_id", "left_anti").select(docs.columns)
    twice = keep(found.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return rest
    rank = unused(docs, "rank")
    one = rest.join(twice, "doc_id", "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(rank) == 1)
    return rest.join(twice, "doc_id", "left_anti").unionByName(one.select(rest.columns)).select(docs.columns)
