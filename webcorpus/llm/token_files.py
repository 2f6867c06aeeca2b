"""Operator 7: token ids in seekable zstandard files.

A file holds independent zstandard frames of little-endian unsigned 32-bit ids (whole documents, in ascending order of
doc_id), then a skippable frame with the documents' index, then a skippable frame with the seek table: compressed
size, decompressed size and checksum (low 32 bits of XXH64 of the content) of every frame. A reader takes the two
tables from the file's end and decompresses only the frames that hold the documents asked for.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_path, slices, text_of
from .token_ids import SLICE_BYTES, Encoder, with_end

END = 2
LEVEL = 3
#: A frame is closed once it holds this many ids; a longer document has a frame of its own.
FRAME_IDS = 1 << 17
#: Fixed values of the zstandard seekable format and of skippable frames.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
#: A null doc_id is kept under this id; it sorts first.
NULL_ID = -(1 << 63)
FOOTER = struct.Struct("<IBI")
ENTRY = np.dtype([("compressed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
INDEX = np.dtype([("doc_id", "<i8"), ("n_tokens", "<u8")])


def checksum(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class Writer:
    """Writes documents, given in ascending order, to an open binary file."""

    def __init__(self, out, frame_ids: int = FRAME_IDS):
        self.out, self.frame_ids, self.pending, self.held = out, frame_ids, [], 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        self.entries: list[tuple[int, int, int]] = []
        self.index: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> None:
        self.index.append(np.rec.fromarrays([doc_ids, np.diff(offsets)], dtype=INDEX))
        first = 0
        for last in range(1, len(offsets)):
            if self.held + offsets[last] - offsets[first] >= self.frame_ids or last == len(offsets) - 1:
                part = ids[offsets[first] : offsets[last]]
                self.pending.append(part.astype("<u4").tobytes())
                self.held, first = self.held + len(part), last
                if self.held >= self.frame_ids:
                    self._close_frame()

    def _close_frame(self) -> None:
        content = b"".join(self.pending)
        packed = self.compressor.compress(content)
        self.out.write(packed)
        self.entries.append((len(packed), len(content), checksum(content)))
        self.pending, self.held = [], 0

    def close(self) -> None:
        if self.pending:
            self._close_frame()
        index = np.concatenate(self.index).tobytes() if self.index else b""
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(index)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(packed) + 8) + packed + struct.pack("<Q", len(packed)))
        table = np.array(self.entries, ENTRY).tobytes() + FOOTER.pack(len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class Reader:
    """Reads from an open binary file with seek; ``frames_read`` counts the frames decompressed so far."""

    def __init__(self, source):
        self.source, self.frames_read = source, 0
        size = source.seek(0, 2)
        source.seek(size - FOOTER.size)
        n, flags, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        table = size - FOOTER.size - n * ENTRY.itemsize
        source.seek(table - 8 - 8)
        length = struct.unpack("<Q", source.read(8))[0]
        if struct.unpack("<II", source.read(8)) != (SKIPPABLE_SEEK, n * ENTRY.itemsize + FOOTER.size):
            raise ValueError("the seek table is damaged")
        self.frames = np.frombuffer(source.read(n * ENTRY.itemsize), ENTRY)
        source.seek(table - 16 - length)
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(source.read(length)), INDEX) if length else np.zeros(0, INDEX)
        self.at = np.concatenate([[0], np.cumsum(self.frames["compressed"].astype(np.int64))])
        self.tokens = np.concatenate([[0], np.cumsum(self.frames["size"].astype(np.int64))]) // 4
        self.docs = np.concatenate([[0], np.cumsum(self.index["n_tokens"].astype(np.int64))])

    def frame(self, k: int) -> np.ndarray:
        self.source.seek(int(self.at[k]))
        entry = self.frames[k]
        content = zstandard.ZstdDecompressor().decompress(self.source.read(int(entry["compressed"])), max_output_size=int(entry["size"]))
        self.frames_read += 1
        if len(content) != entry["size"] or checksum(content) != entry["checksum"]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(content, "<u4")

    def documents(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every document with this id; only the frames that hold them are decompressed."""
        lo, hi = (int(np.searchsorted(self.index["doc_id"], doc_id, side)) for side in ("left", "right"))
        return [self._span(int(self.docs[i]), int(self.docs[i + 1])) for i in range(lo, hi)]

    def _span(self, a: int, b: int) -> np.ndarray:
        k = int(np.searchsorted(self.tokens, a, "right")) - 1
        parts = []
        while a < b:
            parts.append(self.frame(k)[a - self.tokens[k] : b - self.tokens[k]])
            a, k = a + len(parts[-1]), k + 1
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def open_uri(uri: str, mode: str):
    """A binary file of any store that pyarrow knows by its URI; plain paths are local ones."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    if mode == "w":
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path, compression=None)
    return store.open_input_file(path)


def write(documents: DataFrame, tokenizer: str, folder: str, end: int = END) -> DataFrame:
    """Write all documents to files in ``folder`` (a shared one) and return their manifest.

    Rows: part (ascending with doc_id), file, n_documents, n_tokens. Null text has only the end id; a null doc_id comes
    first; repeated rows are kept. A file bears its task attempt's number, and only files of attempts that succeeded
    are in the manifest, so lost executors and retries do no harm. An empty table gives no files.
    """
    from pyspark import TaskContext

    def run(batches):
        task = TaskContext.get()
        writer = out = None
        n_documents = n_tokens = 0
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.ids.zst"
        encoder = Encoder.of(tokenizer)
        for batch in slices(batches, "text", SLICE_BYTES):
            if writer is None:
                out = open_uri(name, "w")
                writer = Writer(out)
            offsets, ids = with_end(*encoder.ids(text_of(batch)), end)
            doc_ids = batch.column("doc_id").cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            writer.add(doc_ids, offsets, ids)
            n_documents, n_tokens = n_documents + len(doc_ids), n_tokens + len(ids)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "file": name, "n_documents": n_documents, "n_tokens": n_tokens}])

    ordered = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return cut(ordered.mapInArrow(run, "part long, file string, n_documents long, n_tokens long"), "token-manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """All documents of the manifest's files: doc_id, start (ids of all documents before it), n_tokens, ids (binary)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))  # one row per file

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open_uri(row["file"], "r") as source:
                    reader = Reader(source)
                    at = 0  # documents of the file before the frame
                    for k in range(len(reader.frames)):
                        ids, last = reader.frame(k), int(np.searchsorted(reader.docs, reader.tokens[k + 1], "right")) - 1
                        docs = reader.docs[at : last + 1]
                        bounds = ((docs - reader.tokens[k]) * 4).astype(np.int32)
                        doc_ids = reader.index["doc_id"][at:last]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(row["base"] + docs[:-1]), pa.array(np.diff(docs)), pa.Array.from_buffers(pa.binary(), last - at, [None, pa.py_buffer(bounds), pa.py_buffer(ids)])],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )
                        at = last

    n = max(1, manifest.count())
    return files.repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def lookup(file: str, doc_ids: list[int]) -> tuple[dict[int, list[np.ndarray]], int]:
    """Ids of the given documents of one file, and how many frames were decompressed for them."""
    with open_uri(file, "r") as source:
        reader = Reader(source)
        return {i: reader.documents(i) for i in doc_ids}, reader.frames_read


def write_and_read(documents: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    spark = documents.sparkSession
    return read(spark, write(documents, tokenizer, shared_path(spark, "token-files"), end))
