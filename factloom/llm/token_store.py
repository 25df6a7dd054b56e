"""Operator 1: token ids as independent zstandard frames with a trailing seek table and per-frame checksums.

A file is a sequence of zstandard frames any decoder can read:

- a skippable frame (0x184D2A50) with the header: b"TOKIDS1\\0", then the width of an id in bytes (2 or 4);
- data frames, each the ids of one or more whole documents, little-endian, width bytes each;
- a skippable frame (0x184D2A51) with the document index: for each document its id (signed 64 bits, the smallest
  value stands for null), frame (unsigned 32) and number of ids (unsigned 32), compressed;
- the seek table of the public seekable zstandard format (0x184D2A5E): compressed size, size and the low 32 bits of
  XXH64 of the content for each data frame, then number of frames, descriptor 0x80 and 0x8F92EAB1.

A reader reads the tail, finds a document's frame, and decompresses that frame alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .encoding import encoder

HEADER = b"TOKIDS1\0"
SKIP_HEADER, SKIP_INDEX, SKIP_SEEK = 0x184D2A50, 0x184D2A51, 0x184D2A5E
SEEK_END = 0x8F92EAB1
NULL_ID = -(2**63)
FRAME_BYTES = 1 << 16
#: A task goes on with another file at this size, so that files and their indexes are bounded.
FILE_BYTES = 1 << 27
#: Files that a task may write.
FILES = 1 << 12

MANIFEST = "file string, part int, documents long, tokens long, bytes long"
READ_BACK = "part int, doc_id long, before long, n_tokens long, ids binary"


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Writer:
    """Writes one file; holds one open frame and the index only."""

    def __init__(self, out, width: int, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.out, self.width, self.frame_bytes = out, width, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level)
        self.open: list[bytes] = []
        self.size = self.tokens = self.written = 0
        self.frames: list[tuple[int, int, int]] = []
        self.doc_ids: list[int] = []
        self.doc_frames: list[int] = []
        self.lengths: list[int] = []
        self._put(_skippable(SKIP_HEADER, HEADER + bytes([width])))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        data = ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        self.doc_ids.append(NULL_ID if doc_id is None else doc_id)
        self.doc_frames.append(len(self.frames))
        self.lengths.append(len(ids) // 4)
        self.tokens += len(ids) // 4
        self.open.append(data)
        self.size += len(data)
        if self.size >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        import xxhash

        content = b"".join(self.open)
        packed = self.packer.compress(content)
        self._put(packed)
        self.frames.append((len(packed), len(content), xxhash.xxh64(content).intdigest() & 0xFFFFFFFF))
        self.open, self.size = [], 0

    def close(self) -> None:
        if self.open:
            self._close_frame()
        index = np.array(self.doc_ids, "<i8").tobytes() + np.array(self.doc_frames, "<u4").tobytes() + np.array(self.lengths, "<u4").tobytes()
        self._put(_skippable(SKIP_INDEX, struct.pack("<I", len(self.doc_ids)) + self.packer.compress(index)))
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        self._put(_skippable(SKIP_SEEK, table + struct.pack("<IBI", len(self.frames), 0x80, SEEK_END)))


class Reader:
    """Reads one file. `read(i)` decompresses the frame of document number i only; `frames()` goes through all."""

    def __init__(self, source):
        import zstandard

        self.source = source
        self.unpacker = zstandard.ZstdDecompressor()
        size = source.size()
        n, flags, end = struct.unpack("<IBI", self._at(size - 9, 9))
        if end != SEEK_END or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        rows = self._at(size - 9 - 12 * n, 12 * n)
        self.table = [struct.unpack_from("<III", rows, 12 * i) for i in range(n)]
        head = self._at(0, 8 + len(HEADER) + 1)
        if head[8:-1] != HEADER:
            raise ValueError("not a token file")
        self.width = head[-1]
        self.places = np.cumsum([len(head), *(f[0] for f in self.table)])
        magic, length = struct.unpack("<II", self._at(int(self.places[-1]), 8))
        if magic != SKIP_INDEX:
            raise ValueError("no document index")
        index = self._at(int(self.places[-1]) + 8, length)
        docs = struct.unpack_from("<I", index)[0]
        raw = self.unpacker.decompress(index[4:])
        self.doc_ids = np.frombuffer(raw, "<i8", docs)
        self.doc_frames = np.frombuffer(raw, "<u4", docs, 8 * docs)
        self.lengths = np.frombuffer(raw, "<u4", docs, 12 * docs).astype(np.int64)
        starts = np.cumsum(self.lengths) - self.lengths
        first = np.searchsorted(self.doc_frames, self.doc_frames)  # the first document of the same frame
        self.before, self.within = starts, starts - starts[first] if docs else starts

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        data = self.source.read(n)
        if len(data) != n:
            raise ValueError("the file is too short")
        return data

    def frame(self, k: int) -> bytes:
        import xxhash

        packed, size, check = self.table[k]
        content = self.unpacker.decompress(self._at(int(self.places[k]), packed), max_output_size=size)
        if len(content) != size or xxhash.xxh64(content).intdigest() & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} does not match its checksum")
        return content

    def _ids(self, i: int, content: bytes) -> bytes:
        at = int(self.within[i]) * self.width
        own = content[at : at + int(self.lengths[i]) * self.width]
        return own if self.width == 4 else np.frombuffer(own, "<u2").astype("<u4").tobytes()

    def read(self, i: int) -> bytes:
        return self._ids(i, self.frame(int(self.doc_frames[i])))

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """doc_id, ids before it in the file, its ids as unsigned 32-bit."""
        k, content = -1, b""
        for i, (doc_id, frame) in enumerate(zip(self.doc_ids.tolist(), self.doc_frames.tolist(), strict=True)):
            if frame != k:
                k, content = frame, self.frame(frame)
            yield None if doc_id == NULL_ID else doc_id, int(self.before[i]), self._ids(i, content)


def write_tokens(documents: DataFrame, folder: str, vocabulary: str, end_id: int = 2, width: int = 2) -> DataFrame:
    """Encode every whole text, append end_id, and write the ids to files in `folder` in ascending doc_id order.

    Returns the manifest, one row a file: file, part (order of the files), documents, tokens, bytes; it is a saved
    table, and only files that it names count, so tasks that ran twice do no harm. Null texts are empty; a null
    doc_id comes first; equal doc_ids stay next to each other, ordered by text, in one task. Whole texts are encoded,
    however long; a file ends at about FILE_BYTES. No rows: an empty manifest. Other columns are not looked at.
    width: bytes an id, 2 where the vocabulary has at most 65,536 ids.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = _store(folder)
        first, encode, end = TaskContext.get().partitionId() * FILES, encoder(vocabulary), struct.pack("<I", end_id)
        part, writer, out, name = first, None, None, ""

        def closed() -> pa.RecordBatch:
            writer.close()
            out.close()
            row = [name], [part], [len(writer.doc_ids)], [writer.tokens], [writer.written]
            return pa.RecordBatch.from_arrays([pa.array(row[0]), pa.array(row[1], pa.int32()), *(pa.array(x, pa.int64()) for x in row[2:])], ["file", "part", "documents", "tokens", "bytes"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is not None and writer.written >= FILE_BYTES and part + 1 < first + FILES:
                    yield closed()
                    part, writer = part + 1, None
                if writer is None:
                    name = f"{base}/{part:010d}-{uuid.uuid4().hex}.zst"
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(name, compression=None)
                    writer = Writer(out, width)
                writer.add(doc_id, encode.one(text.as_py()) + end)
        if writer is not None:
            yield closed()

    common.ship(documents.sparkSession)
    ordered = documents.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return common.saved(ordered.mapInArrow(common.lean(write), MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the files in the manifest, checksums verified: part, doc_id, before (ids before it in its
    file), n_tokens, ids (little-endian unsigned 32-bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            for file, part in zip(batch.column("file").to_pylist(), batch.column("part").to_pylist(), strict=True):
                with store.open_input_file(file) as source:
                    rows, held = [], 0
                    for doc_id, before, ids in Reader(source).documents():
                        rows.append((part, doc_id, before, len(ids) // 4, ids))
                        held += len(ids)
                        if held > 1 << 23:
                            yield _rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "doc_id", "before", "n_tokens", "ids"])

    common.ship(manifest.sparkSession)
    files = max(1, manifest.count())
    return manifest.select("file", "part").repartition(files, "part").mapInArrow(common.lean(read), READ_BACK)


def read_document(file: str, doc_id: int) -> list[bytes]:
    """Ids of one document (of each of its rows) from one file; only its frames are decompressed."""
    store, path = _store(file)
    with store.open_input_file(path) as source:
        reader = Reader(source)
        return [reader.read(int(i)) for i in np.flatnonzero(reader.doc_ids == doc_id)]


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF


def token_digest(documents: DataFrame, vocabulary: str, folder: str) -> DataFrame:
    """Write the files, read them back and describe each document: doc_id, start, n_tokens, ids_crc32."""
    manifest = write_tokens(documents, folder, vocabulary)
    bases = manifest.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    found = read_tokens(manifest, folder).select("part", "doc_id", "before", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return found.join(common.broadcast_if_small(bases, 100_000), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
