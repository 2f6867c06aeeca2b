"""Operator 5: best-fit packing of documents into sequences of a fixed number of tokens.

Best-fit decreasing over all pieces: longest first, each into the open sequence with the least room that still holds
it, found in a segment tree over the remaining capacities. Pieces of one length are alike, so the plan is made for
counts per length (at most ``capacity`` numbers, whatever the input) and gives runs of pieces; Spark numbers the pieces
of each length and looks up their runs.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, text_of
from .token_ids import SLICE_BYTES, Encoder, with_end

CAPACITY = 2048
#: The id after each document.
END = 0


class SegmentTree:
    """Which capacities 0..n have open sequences; ``first(k)`` is the least one of at least k, or -1, in log time."""

    def __init__(self, n: int):
        self.size = 1 << max(1, n.bit_length())
        self.some = np.zeros(2 * self.size, bool).tolist()

    def put(self, k: int, present: bool) -> None:
        i = k + self.size
        while i:
            if i >= self.size:
                self.some[i] = present
            else:
                self.some[i] = self.some[2 * i] or self.some[2 * i + 1]
            i >>= 1

    def first(self, k: int) -> int:
        i = k + self.size
        if self.some[i]:
            return k
        while i > 1:  # up to the next subtree on the right that has one
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing for ``counts`` (length to number of pieces): runs, in order of (length, first).

    A run's columns: length, first (its first piece's number among those of the length), sequence (of its first
    piece), each (pieces that one sequence takes in a row), offset (of a sequence's first piece). Piece first + k goes
    to sequence + k // each, at offset + (k % each) * length.
    """
    room: dict[int, deque] = {}  # remaining capacity to runs (sequence, number) of sequences
    tree, runs, opened = SegmentTree(capacity), [], 0

    def keep(r: int, sequence: int, number: int) -> None:
        queue = room.setdefault(r, deque())
        if queue and queue[-1][0] + queue[-1][1] == sequence:
            queue[-1] = (queue[-1][0], queue[-1][1] + number)
        else:
            queue.append((sequence, number))
        if r:
            tree.put(r, True)

    for length in sorted(counts, reverse=True):
        n, first = counts[length], 0
        while n:
            r = tree.first(length)
            if r < 0:
                r, number = capacity, -(-n // (capacity // length))
                sequence, opened = opened, opened + number
                fresh = True
            else:
                sequence, number = room[r].popleft()
                fresh = False
            each = r // length  # a sequence that was the tightest stays so while it holds another piece
            full = min(number, n // each)
            if full:
                runs.append((length, first, sequence, each, capacity - r))
                keep(r - each * length, sequence, full)
                first, n, sequence, number = first + full * each, n - full * each, sequence + full, number - full
            if n and n < each and number:
                runs.append((length, first, sequence, each, capacity - r))
                keep(r - n * length, sequence, 1)
                first, n, sequence, number = first + n, 0, sequence + 1, number - 1
            if number and not fresh:
                room[r].appendleft((sequence, number))
            if not fresh and not room[r]:
                tree.put(r, False)
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, checksums: bool = False) -> DataFrame:
    """Whole texts as ids (``tokenizer``: the content of a tokenizers JSON file), cut into pieces of ``capacity``.

    Columns: doc_id, piece (from 0), start, length, ids (little-endian unsigned 32-bit; with ``checksums`` their unsigned crc32 as
    ids_crc32 instead), and the place of the piece: part (its task) and nth (its number among pieces of its length in that
    task). Null text is empty: one piece with the end id alone. Map-only.
    """
    from pyspark import TaskContext

    def run(batches):
        encoder, part, seen = Encoder.of(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text", SLICE_BYTES):
            offsets, ids = with_end(*encoder.ids(text_of(batch)), end)
            sizes = np.diff(offsets)
            per = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), per)
            number = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
            start = number * capacity
            length = np.minimum(capacity, sizes[row] - start)
            order = np.argsort(length, kind="stable")
            nth, by = np.empty(len(length), np.int64), length[order]
            heads = np.flatnonzero(np.diff(by, prepend=-1))
            nth[order] = np.arange(len(by)) - np.repeat(heads, np.diff(np.append(heads, len(by)))) + seen[by]
            seen += np.bincount(length, minlength=capacity + 1)
            # ids of consecutive pieces lie one after another
            bounds = np.append(offsets[row] + start, offsets[-1]) * 4
            if checksums:
                data, edges = memoryview(ids).cast("B"), bounds.tolist()
                content = pa.array([zlib.crc32(data[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.int64())
            else:
                content = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), content, pa.array(np.full(len(row), part), pa.int64()), pa.array(nth)],
                ["doc_id", "piece", "start", "length", name, "part", "nth"],
            )

    kind = dict(documents.dtypes)["doc_id"]
    name, what = ("ids_crc32", "long") if checksums else ("ids", "binary")
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, {name} {what}, part long, nth long")


def assign(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut_pieces`` (a written table with part, length, nth) with sequence_id and offset in place of part and nth.

    Numbers of pieces per (part, length) are added up before; only one row per task and length is windowed.
    """
    spark = cut_pieces.sparkSession
    per = cut(cut_pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "pack-counts")
    counts = {int(r["length"]): int(r["n"]) for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs = spark.sparkContext.broadcast(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    names = [c for c in cut_pieces.columns if c not in ("part", "nth")]
    ranked = cut_pieces.join(base, ["length", "part"]).select(*names, (F.col("__base") + F.col("nth")).alias("__rank"))

    def run(batches):
        table = runs.value
        length, first, sequence, each, offset = table.T
        span = np.int64(1) << 40
        keys = length * span + first
        for batch in batches:
            if not batch.num_rows:
                continue
            rank, own = (batch.column(c).to_numpy() for c in ("__rank", "length"))
            at = np.searchsorted(keys, own * span + rank, "right") - 1
            k = rank - first[at]
            out = [sequence[at] + k // each[at], offset[at] + (k % each[at]) * own]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *map(pa.array, out)], [*names, "sequence_id", "offset"])

    types = dict(ranked.dtypes)
    return ranked.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names) + ", sequence_id long, offset long")


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, sequence_id, offset.

    Only documents of more than ``capacity`` ids are cut. Repeated rows are packed once each; other columns are ignored;
    an empty table gives no rows. The sequences themselves are the pieces' ids in order of (sequence_id, offset).
    """
    return assign(cut(pieces(documents, tokenizer, capacity, end), "pack-pieces"), capacity)
