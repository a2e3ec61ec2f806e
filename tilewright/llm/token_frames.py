"""Token ids in binary files of independent zstandard frames with a trailing seek table.

A file holds the documents of one range of ids in ascending order, each in a frame of its own: its token ids as little-endian unsigned
32-bit integers. Two skippable frames end the file:

* the document table (magic 0x184D2A50): for each frame the doc_id as int64, then one byte, 1 where it is null;
* the seek table (magic 0x184D2A5E): for each frame the compressed size, the decompressed size and a checksum
  (the low 32 bits of XXH64 of the decompressed bytes), each an unsigned 32-bit integer; then the number of frames, a
  descriptor byte (0x80: with checksums) and the magic number 0x8F92EAB1.

Any zstandard reader decompresses a file as a whole; :class:`FrameFile` reads the tables from the end and decompresses only the
documents asked for, each checked.

Defined cases: a null or empty text has only the end id; null doc_ids come first, in files of their own; rows that repeat a doc_id go by their frames, in one file; an empty
table writes no file and gives an empty result; other columns of the input are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import os
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.ordering import pieces, ranges_of
from tilewright.llm.shared import filesystem, fresh_path, keep, publishing, runs_of, text_bytes
from tilewright.llm.shingles import LOWER, word_bounds, word_hashes

SEEK_MAGIC, TABLE_MAGIC, FOOT_MAGIC, CHECKSUMS = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80
LEVEL = 1
#: Pieces that a worker remembers (some 60 bytes each), and bytes of theirs; beyond that it forgets and starts again.
REMEMBERED, REMEMBERED_BYTES = 800_000, 1 << 24
#: Documents of a file, about; what a reader holds of a file is its tables, 21 bytes a document.
DOCUMENTS = 1 << 18
#: Bytes of the texts that are cut into pieces at once; a longer text stands alone.
RUN = 1 << 21
#: Bytes that part a text, bytes that only the library can judge, and kinds of the others.
CUTS, ODD = np.zeros(256, bool), np.zeros(256, bool)
CUTS[[0x20, 0x0A]] = True
ODD[[*range(0x20), 0x27, 0x7F, *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True
ODD[0x0A] = False
LETTER, DIGIT, SIGN = 1, 2, 3
KIND = np.full(256, SIGN, np.int8)
KIND[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = LETTER
KIND[0x30:0x3A] = DIGIT

_tokenizers: dict = {}


class Encoder:
    """The library's ids of whole texts, by way of the pieces that it encodes apart.

    It drops white space, lowers letters, and cuts a text into runs of letters, single digits and runs of signs. Where all bytes
    between two spaces are ASCII or Latin-1 letters, and none is an apostrophe or a control character, these cuts are found on the
    bytes; anything else between two spaces, and whatever could hold a special token, is one piece, for the library to cut. The distinct
    pieces of a run of texts are found by their bytes; each is encoded by the library and remembered, a bounded number of them, in flat arrays. Pieces
    of letters are encoded many at a time and told apart by the tokens that end a word.

    As the library does, a special token's string in a text becomes that token; with ``special_as_text`` it is ordinary text."""

    def __init__(self, path: str, end_id: int | None = None, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread a worker
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if special_as_text:
            self.library.encode_special_tokens = True
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.last = np.array([] if end_id is None else [end_id], "<u4")
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # of remembered pieces, by hash
        self.text, self.text_at = np.zeros(0, np.uint8), np.zeros(2, np.int64)  # piece i is text[text_at[i]:text_at[i + 1]]
        self.ids, self.ids_at = self.last, np.array([0, len(self.last)])  # piece 0 ends a text

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, pieces_: list[bytes]) -> list[bytes]:
        texts, out = [w.decode() for w in pieces_], [b""] * len(pieces_)
        plain = [w.isalpha() and (w.isascii() or w.lower().isalpha()) for w in texts]
        letters, rest = [i for i, x in enumerate(plain) if x], [i for i, x in enumerate(plain) if not x]
        for at in range(0, len(letters), 4096):
            some = letters[at : at + 4096]
            (packed,) = self._library([" ".join([texts[i] for i in some])])
            cut = (4 * np.flatnonzero(self.ends[np.frombuffer(packed, "<u4")]) + 4).tolist()
            if len(cut) != len(some):
                rest += some
                continue
            for i, x, y in zip(some, [0, *cut], cut):
                out[i] = packed[x:y]
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for i, packed in zip(some, self._library([texts[i] for i in some])):
                out[i] = packed
        return out

    def _number(self, distinct: pa.LargeBinaryArray) -> np.ndarray:
        """Numbers of distinct pieces. A hash finds a remembered piece, its bytes decide; new ones are learnt."""
        if len(self.text_at) + len(distinct) > REMEMBERED or len(self.text) > REMEMBERED_BYTES:
            self._forget()
        _, offsets, data = distinct.buffers()
        edge, data = np.frombuffer(offsets, np.int64)[: len(distinct) + 1], np.frombuffer(data, np.uint8)
        found = word_hashes(data, edge[:-1], edge[1:])
        slot = np.searchsorted(self.hashes, found)
        number = np.full(len(found), -1)
        held = np.flatnonzero(slot < len(self.hashes))
        held = held[self.hashes[slot[held]] == found[held]]
        taken = np.zeros(len(found), bool)
        taken[held] = True
        known = self.numbers[slot[held]]
        same = equal_slices(data, edge[held], edge[held + 1], self.text, self.text_at[known], self.text_at[known + 1])
        number[held[same]] = known[same]
        new = np.flatnonzero(number < 0)
        if len(new):
            pieces_ = distinct.take(pa.array(new)).to_pylist()
            ids = self._ids_of(pieces_)
            number[new] = len(self.text_at) - 1 + np.arange(len(new))
            grown = lambda at, lengths: np.concatenate([at, at[-1] + np.cumsum(np.fromiter(lengths, np.int64, len(new)))])
            self.text_at, self.text = grown(self.text_at, map(len, pieces_)), np.concatenate([self.text, np.frombuffer(b"".join(pieces_), np.uint8)])
            self.ids_at, self.ids = grown(self.ids_at, (len(x) // 4 for x in ids)), np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])
            add = new[~taken[new]]
            add = add[np.unique(found[add], return_index=True)[1]]
            self.hashes, self.numbers = np.insert(self.hashes, slot[add], found[add]), np.insert(self.numbers, slot[add], number[add])
        return number

    def encode_bytes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Ids of each text raw[start:end], and the end id, as little-endian unsigned 32-bit integers; texts lie one after the other."""
        out: list[bytes] = []
        for i, j in runs_of(starts, ends, RUN):
            base = int(starts[i])
            data, first, end = byte_pieces(raw[base : int(ends[j - 1])], starts[i:j] - base, ends[i:j] - base)
            edge = np.concatenate([[0], np.cumsum(end - first)])  # pieces lie close together without the white space between them
            column = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(edge), pa.py_buffer(data[~CUTS[data]])]).dictionary_encode()
            number = np.concatenate([[0], self._number(column.dictionary)]) if len(first) else np.zeros(1, np.int64)
            begin, sizes = self.ids_at[number].astype(np.int32), (self.ids_at[number + 1] - self.ids_at[number]).astype(np.int32)
            upto = np.searchsorted(first, ends[i:j] - base)  # pieces before each text's end
            order = np.insert(column.indices.to_numpy() + 1, upto, 0)
            size = sizes[order]
            edge = np.cumsum(size, dtype=np.int64)
            place = np.repeat((begin[order] - edge + size).astype(np.int32), size)
            place += np.arange(len(place), dtype=np.int32)
            packed = self.ids[place].tobytes()
            cut = [0, *(4 * edge[upto + np.arange(len(upto))]).tolist()]
            out += [packed[cut[k] : cut[k + 1]] for k in range(len(upto))]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_bytes(*text_bytes(pa.array(texts, pa.string())))


def equal_slices(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether a[start:end] and b[start:end] hold the same bytes, for each pair of slices; none is empty."""
    same = (a_end - a_start) == (b_end - b_start)
    at = np.flatnonzero(same)
    if len(at):
        n = a_end[at] - a_start[at]
        edge = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(edge, n)
        apart = a[np.repeat(a_start[at], n) + step] != b[np.repeat(b_start[at], n) + step]
        same[at] = ~np.logical_or.reduceat(apart, edge)
    return same


def byte_pieces(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with lowered letters, first bytes, ends) of the pieces of texts."""
    after_c3 = np.concatenate([[False], raw[:-1] == 0xC3])
    data = LOWER[raw]
    capital = after_c3 & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
    data = np.where(capital, raw + np.uint8(0x20), data)
    first, end = word_bounds(data, starts, ends, CUTS)
    odd = ODD[raw] | (after_c3 & ((raw == 0x97) | (raw == 0xB7)))
    odd[1:] |= (raw[1:] == 0x7C) & (raw[:-1] == 0x3C)  # <| may begin a special token
    if odd.any():
        count = np.concatenate([[0], np.cumsum(odd, dtype=np.int32)], dtype=np.int32)
        strange = (count[end] > count[first]).astype(np.int8)
        mark = np.zeros(len(raw) + 1, np.int8)
        mark[first] += strange
        mark[end] -= strange
        whole = np.cumsum(mark[:-1], dtype=np.int8) > 0
        data = np.where(whole, raw, data)  # the library lowers it
    else:
        whole = np.zeros(len(raw), bool)
    kind = KIND[data]
    solid = ~CUTS[data]
    start = np.zeros(len(raw) + 1, bool)
    start[1:-1] = solid[1:] & solid[:-1] & ~whole[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    start[first] = True
    at = np.flatnonzero(start)
    stop = np.zeros(len(raw) + 2, bool)
    stop[end] = True
    stop[at] |= start[at] & np.concatenate([[False], solid])[at]
    edges = np.flatnonzero(stop)
    return data, at, edges[np.searchsorted(edges, at, "right")]


def encoder(path: str, end_id: int | None, special_as_text: bool = False) -> Encoder:
    """One encoder per worker process."""
    key = path, end_id, special_as_text
    if key not in _tokenizers:
        _tokenizers[key] = Encoder(*key)
    return _tokenizers[key]


def frame_of(raw: bytes, packer: zstandard.ZstdCompressor) -> tuple[bytes, int, int]:
    """A document's frame, its decompressed size and its checksum."""
    return packer.compress(raw), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


def packer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)


def write_frames(out, documents) -> tuple[int, int]:
    """Write (doc_id, frame, size, checksum) in the given order; returns the numbers of documents and of tokens."""
    seek, ids, nulls, tokens = bytearray(), [], bytearray(), 0
    for doc, frame, size, check in documents:
        out.write(frame)
        seek += struct.pack("<III", len(frame), size, check)
        ids.append(doc or 0)
        nulls.append(doc is None)
        tokens += size // 4
    table = np.array(ids, "<i8").tobytes() + bytes(nulls)
    out.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)
    foot = struct.pack("<IBI", len(ids), CHECKSUMS, FOOT_MAGIC)
    out.write(struct.pack("<II", SEEK_MAGIC, len(seek) + len(foot)) + bytes(seek) + foot)
    return len(ids), tokens


class FrameFile:
    """Reads the tables at the end of a file, then single frames."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        foot = file.read_at(9, end - 9)
        n, flags, magic = struct.unpack("<IBI", foot)
        if magic != FOOT_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        start = end - 9 - 12 * n
        if struct.unpack("<II", file.read_at(8, start - 8)) != (SEEK_MAGIC, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.seek = np.frombuffer(file.read_at(12 * n, start), "<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.seek[:, 0], dtype=np.int64)])
        at = start - 8 - 9 * n
        if struct.unpack("<II", file.read_at(8, at - 8)) != (TABLE_MAGIC, 9 * n) or at - 8 != self.offsets[-1]:
            raise ValueError("the document table is damaged")
        table = file.read_at(9 * n, at)
        self.doc_ids = [None if z else int(d) for d, z in zip(np.frombuffer(table[: 8 * n], "<i8"), table[8 * n :])]
        self.unpacker = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def read(self, i: int) -> bytes:
        """Ids of the i-th document; only its frame is read."""
        size, whole, check = (int(x) for x in self.seek[i])
        raw = self.unpacker.decompress(self.file.read_at(size, int(self.offsets[i])), max_output_size=max(1, whole))
        if len(raw) != whole or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return raw


def _encode(path: str, end_id: int):
    def run(batches):
        e, pack = encoder(path, end_id), packer()
        for b in batches:
            frames = [frame_of(raw, pack) for raw in e.encode_bytes(*text_bytes(b.column("text")))]
            column = lambda k, kind: pa.array([f[k] for f in frames], kind)
            yield pa.RecordBatch.from_pydict({"part": b.column("part"), "doc_id": b.column("doc_id"), "frame": column(0, pa.binary()), "size": column(1, pa.int64()), "check": column(2, pa.int64())})

    return run


def _write(folder: str):
    def run(batches):
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        part = first.column("part")[0].as_py()  # a partition is one file, written as its rows stream by
        rows = (r for b in chain([first], batches) for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "frame", "size", "check"))))
        name = f"{folder}/tokens-{part:07d}.zst"
        with publishing(name) as out:
            documents, tokens = write_frames(out, rows)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": pa.array([name]), "documents": pa.array([documents], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1) -> DataFrame:
    """Writes the files and returns their list: part, path, documents, tokens, start (tokens in all files before)."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    part, count = ranges_of(narrow, "doc_id", [F.col("text")], DOCUMENTS)
    # Frames are made before the shuffle: they are what moves, a third of the ids' bytes.
    frames = narrow.select(part.alias("part"), "doc_id", "text").mapInArrow(_encode(tokenizer, end_id), "part int, doc_id long, frame binary, size long, check long")
    dealt = frames.repartitionById(count, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "frame")
    files = keep(dealt.mapInArrow(_write(folder), "part int, path string, documents long, tokens long"), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read(batches):
    for b in batches:
        for path, at in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
            files, name = filesystem(path)
            with files.open_input_file(name) as f:
                frames = FrameFile(f)
                for i in range(0, len(frames), 4096):
                    docs, starts, sizes, sums = [], [], [], []
                    for k in range(i, min(i + 4096, len(frames))):
                        raw = frames.read(k)
                        docs.append(frames.doc_ids[k])
                        starts.append(at)
                        sizes.append(len(raw) // 4)
                        sums.append(zlib.crc32(raw))
                        at += len(raw) // 4
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})


def read_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    spread = files.select("part", "path", "start").repartition(pieces(files.sparkSession), "part")
    return spread.select("path", "start").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    return read_digests(write_tokens(docs, tokenizer, fresh_path(docs.sparkSession, "token-frames"), end_id))
