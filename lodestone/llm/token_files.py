"""Token ids in files of shuffled planes.

Encoding. Texts are cut around each added token of the vocabulary (a special token's string
is that token's id, as the library has it), and before each single space between two
characters that are no white space; no pre-token of a byte-level BPE crosses such a cut, so
ids of the pieces are the ids of the text. Each worker encodes a distinct piece once, with
the tokenizers library.

File format (all little-endian). ``LPLANE01``; then the chunks; then a footer and its place.
A chunk is ``CHUNK_IDS`` ids as unsigned 32-bit integers (the last one fewer), transposed
into 4 byte planes or 32 bit planes, each compressed with zstandard on its own: the high
planes of small ids are nearly free. The footer is zstandard-compressed and holds the chunk
index (offset, ids, crc32 of the ids, size of each plane) and the documents (id, whether it
is null, ids). A reader seeks to the chunks it needs and checks each one's crc32.

Documents are range-partitioned by id once, as texts; a task writes files of consecutive ids
and returns their index rows. A lost task leaves an orphan file that no index row names.
Starts are sums over the table of files (one row each), not over documents.

Defined results: a null text is empty (one end id); a null id sorts first; repeated rows are
written one after another; a very long text spans chunks (its worker holds the text and its
ids); an empty table writes no file; other columns, of any name, are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import new_folder, staged

MAGIC = b"LPLANE01"
CHUNK_IDS = 1 << 16
FILE_IDS = 1 << 26
LEVEL = 3
END_ID = 0
KNOWN_PIECES = 2_000_000
PIECES_CHUNK = 4 << 20


# ---------------------------------------------------------------- encoding

_SPACE = ~words.NOT_SPACE
for _b in (0x1C, 0x1D, 0x1E, 0x1F):
    _SPACE[_b] = True
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # the first bytes of all white space beyond ASCII


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK[48:58] = False
_MARK &= ~_LETTER


def cuts(data: np.ndarray) -> np.ndarray:
    """Places where a pre-token begins for certain.

    These are single spaces with no white space (nor what may be) on either side, and marks
    right after an ASCII letter.
    """
    d = data[:-8]
    at = np.flatnonzero(d == 32)
    at = at[(at > 3) & (at + 1 < len(d))]
    marks = np.flatnonzero(_LETTER[d[:-1]] & _MARK[d[1:]]) + 1
    after, before = d[at + 1], d[at - 1]
    wide = before >= 128
    fine = ~_SPACE[after] & ~_LEADS[after] & ~_SPACE[before]
    fine &= ~(wide & ((d[at - 2] == 0xC2) | (_LEADS[d[at - 3]] & (d[at - 3] > 0xC2))))
    return np.concatenate([at[fine], marks])


class Encoder:
    """Encodes runs of texts; keeps the ids of pieces it has seen."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that take white space or whole words only aren't supported")
        # The longest of those that begin at a place, as the library matches them.
        strings = sorted((t.content.encode() for t in added if t.content), key=lambda t: (-len(t), t))
        self.added = re.compile(b"|".join(map(re.escape, strings))) if strings else None
        # In a byte-level vocabulary each character of a token stands for one byte.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.id_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.id_bytes[i] = len(token)
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def ids_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces, how many each has, and where they begin.

        Pieces of the shape space, ASCII letters are encoded as one text, where each space begins
        a piece again; the ids' bytes tell where. The others are encoded one by one.
        """
        plain = np.concatenate([[0], np.cumsum(_LETTER[data])])
        joined = (data[starts] == 32) & (ends - starts > 1) & (plain[ends] - plain[starts] == ends - starts - 1)
        size, parts = np.zeros(len(starts), np.int64), []
        some = np.flatnonzero(joined)
        for part in np.array_split(some, -(-len(some) // 20_000)) if len(some) else []:
            flat = words.gather(data, starts[part], ends[part])
            ids = np.array(self.tokenizer.encode_batch_fast([flat.buffers()[2].to_pybytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
            last = np.cumsum(ends[part] - starts[part])
            size[part] = np.diff(np.searchsorted(np.cumsum(self.id_bytes[ids]), last, "left") + 1, prepend=0)
            parts.append(ids)
        others = np.flatnonzero(~joined)
        for part in range(0, len(others), 4096):
            texts = [data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in others[part : part + 4096]]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            size[others[part : part + 4096]] = list(map(len, found))
            parts.append(np.array([i for x in found for i in x], np.uint32))
        order = np.concatenate([some, others])
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        at = np.empty(len(starts), np.int64)
        at[order] = np.cumsum(size[order]) - size[order]
        return ids, size, at

    def learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        ids, size, at = self.ids_of(data, starts, ends)
        at = at + len(self.ids)
        keys, at, size = np.concatenate([self.keys, keys]), np.concatenate([self.at, at]), np.concatenate([self.size, size])
        turn = np.argsort(keys, kind="stable")
        self.keys, self.at, self.size, self.ids = keys[turn], at[turn], size[turn], np.concatenate([self.ids, ids])

    def tokens_in(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Begin and end of each added token's string inside a text."""
        raw = data[: offsets[-1]].tobytes()
        if self.added and self.added.search(raw):
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                yield from (m.span() for m in self.added.finditer(raw, a, b))

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, and the number of ids of each text with it."""
        begins = np.zeros(len(data), bool)
        begins[cuts(data)] = True
        for a, b in self.tokens_in(data, offsets):
            begins[a + 1 : b] = False
            begins[[a, b]] = True
        begins[offsets[-1] :] = False
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], offsets[-1]) if len(starts) else starts
        keys, first, inverse = np.unique(words.hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            if len(self.keys) + len(new) > KNOWN_PIECES:  # begin anew, with all of this run's pieces
                self.clear()
                new = np.arange(len(keys))
            self.learn(keys[new], data, starts[first[new]], ends[first[new]])
            at = np.searchsorted(self.keys, keys)
        at = at[inverse]
        size = self.size[at]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.arange(total[-1]) + np.repeat(self.at[at] - total[:-1], size)] if len(at) else np.zeros(0, np.uint32)
        before = total[np.searchsorted(starts, offsets)]
        counts = np.diff(before)
        out = np.full(len(flat) + len(counts), end, np.uint32)
        out[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)] = flat
        return out, counts + 1


def encoder(path: str) -> Encoder:
    """The worker's encoder; it outlives the task."""
    kept = sys.__dict__.setdefault("_lodestone_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


# ---------------------------------------------------------------- files


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, j].tobytes() for j in range(4)]
    grid = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(grid[:, j], bitorder="little").tobytes() for j in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], 1).reshape(-1).view("<u4")
    grid = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], 1)
    return np.packbits(grid, axis=1, bitorder="little").reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file; ``close`` returns its number of documents and ids."""

    def __init__(self, out, bits: bool = False, level: int = LEVEL):
        self.out, self.bits, self.pack = out, bits, zstandard.ZstdCompressor(level=level)
        self.place, self.chunks, self.docs, self.nulls, self.counts = len(MAGIC), [], [], [], []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        out.write(MAGIC)

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(doc_ids.astype("<i8"))
        self.nulls.append(nulls.astype(np.uint8))
        self.counts.append(counts.astype("<i8"))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= CHUNK_IDS:
            self.flush(False)

    def flush(self, last: bool) -> None:
        flat, at = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32), 0
        while len(flat) - at >= CHUNK_IDS or last and at < len(flat):
            ids = flat[at : at + CHUNK_IDS]
            planes = [self.pack.compress(p) for p in to_planes(ids, self.bits)]
            self.chunks.append(struct.pack("<QII", self.place, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) + struct.pack(f"<{len(planes)}I", *map(len, planes)))
            for p in planes:
                self.out.write(p)
                self.place += len(p)
            at += len(ids)
        self.held, self.n_held = [flat[at:]], len(flat) - at

    def close(self) -> tuple[int, int]:
        self.flush(True)
        join = lambda parts: b"".join(x.tobytes() for x in parts)
        n_docs = sum(map(len, self.docs))
        footer = self.pack.compress(struct.pack("<QQI", len(self.chunks), n_docs, 32 if self.bits else 4) + b"".join(self.chunks) + join(self.docs) + join(self.nulls) + join(self.counts))
        self.out.write(footer + struct.pack("<QI", self.place, len(footer)) + MAGIC)
        self.out.close()
        return n_docs, self.n_ids


class PlaneReader:
    """Reads one file: ``docs``, ``nulls``, ``counts`` and any chunk."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        source.seek(end - 20)
        place, size, magic = struct.unpack("<QI8s", source.read(20))
        if magic != MAGIC:
            raise ValueError("not a plane file, or one that was not closed")
        source.seek(place)
        raw = zstandard.ZstdDecompressor().decompress(source.read(size))
        n_chunks, n_docs, self.planes = struct.unpack_from("<QQI", raw)
        at, self.index = 20, []
        for _ in range(n_chunks):
            self.index.append(struct.unpack_from(f"<QII{self.planes}I", raw, at))
            at += 16 + 4 * self.planes
        self.docs = np.frombuffer(raw, "<i8", n_docs, at)
        self.nulls = np.frombuffer(raw, np.uint8, n_docs, at + 8 * n_docs).astype(bool)
        self.counts = np.frombuffer(raw, "<i8", n_docs, at + 9 * n_docs)

    def chunk(self, i: int) -> np.ndarray:
        place, n, crc, *sizes = self.index[i]
        self.source.seek(place)
        unpack = zstandard.ZstdDecompressor()
        ids = from_planes([unpack.decompress(self.source.read(s), max_output_size=max(1, n)) for s in sizes], n)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"chunk {i} is damaged")
        return ids

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids of one document or any other range, from the chunks that hold it."""
        if not count:
            return np.zeros(0, np.uint32)
        first, last = start // CHUNK_IDS, (start + count - 1) // CHUNK_IDS
        return np.concatenate([self.chunk(i) for i in range(first, last + 1)])[start - first * CHUNK_IDS :][:count]


INDEX = "part int, nth int, path string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", bits: bool = False, file_ids: int = FILE_IDS) -> DataFrame:
    """Write all texts in ascending id order; returns the index of files with ``start`` (ids before), staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, done, writer, path = encoder(tokenizer_path), [], None, ""
        store, top = pyarrow.fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        for rows, data, offsets in words.chunks(batches, "text", PIECES_CHUNK):
            if writer is None:
                store.create_dir(top, recursive=True)
                path = f"{top}/{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.planes"
                writer = PlaneWriter(store.open_output_stream(path, compression=None), bits)
            ids, counts = encode.encode(data, offsets)
            column = rows.column("id")
            writer.add(column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False), counts, ids)
            if writer.n_ids >= file_ids:
                done.append((path, *writer.close()))
                writer = None
        if writer is not None:
            done.append((path, *writer.close()))
        for i, (path, n_docs, n_ids) in enumerate(done):
            yield pa.RecordBatch.from_pylist([{"part": part, "nth": i, "path": path, "n_docs": n_docs, "n_ids": n_ids}], schema=pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    index = staged(texts.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(run, INDEX), "token-index")
    before = F.sum("n_ids").over(Window.orderBy("part", "nth")) - F.col("n_ids")
    return staged(index.withColumn("start", before), "token-files")


def read_token_files(index: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row for each document, read from the files: id, start, n_tokens, ids_crc32."""
    schema = pa.schema([(id_col, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["path"]) as source:
                    file = PlaneReader(source)
                    ends = np.cumsum(file.counts)
                    crc, doc, done = np.zeros(len(ends), np.int64), 0, 0
                    for i in range(len(file.index)):
                        raw = file.chunk(i).tobytes()
                        to = done + len(raw) // 4
                        while doc < len(ends):
                            at = max(done, int(ends[doc] - file.counts[doc]))
                            stop = min(to, int(ends[doc]))
                            crc[doc] = zlib.crc32(memoryview(raw)[(at - done) * 4 : (stop - done) * 4], int(crc[doc]))
                            if ends[doc] > to:
                                break
                            doc += 1
                            if ends[doc - 1] == to:
                                break
                        done = to
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.docs, mask=file.nulls), pa.array(row["start"] + ends - file.counts), pa.array(file.counts), pa.array(crc)], schema=schema
                    )

    files = index.count()
    spread = index.repartition(max(1, min(files, 10_000)), "path")
    return spread.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    folder = new_folder(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, tokenizer_path, folder, id_col, text_col), folder, id_col)
