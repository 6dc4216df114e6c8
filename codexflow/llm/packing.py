"""Best-fit packing of documents into sequences of a fixed number of tokens.

Each task packs its own documents as they come: an open bin is found by the
smallest free space that still takes the piece, with a bitset whose bit f says
that some open bin has f tokens free.  At most ``open_bins`` are open; when one
more is needed the fullest is closed.  The pieces of the bins still open at the end
of a task are a stream again, which is packed by the same rule together with those
of other tasks (``fan_in`` tasks at a time, in as many rounds as that takes).  So no
task sees more than ``fan_in`` times ``open_bins`` bins of the round before, however
many tasks there were, and none holds more than ``open_bins`` of them at once.

Rows
    Null and empty texts are one end id long.  A document over the capacity is cut
    into full sequences, the first piece taking what remains.  Repeated rows are
    packed as often as they occur.  Ties: of bins with the same free space the one
    that got it last is used first.  An empty table gives no rows.  Columns other
    than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder
from .storage import Scratch, lean

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, task int, closed boolean"
_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "task", "closed"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]


class BestFit:
    """Bounded-space online best-fit.  A piece is any tuple; it is kept in its bin until that closes."""

    def __init__(self, capacity: int, open_bins: int, first_id: int = 0):
        self.capacity, self.most, self.next_id = capacity, open_bins, first_id
        self.free = 0  # bit f: an open bin with f tokens free
        self.bins: list[list[tuple[int, list]]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def _take(self, f: int) -> tuple[int, list]:
        held = self.bins[f]
        got = held.pop()
        if not held:
            self.free &= ~(1 << f)
        self.open -= 1
        return got

    def add(self, piece: tuple, length: int):
        """Place a piece; gives the bins (id, [(piece, offset)]) that this closes."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} tokens does not fit")
        fits = self.free >> length
        closed = []
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            number, content = self._take(f)
        else:
            f, number, content = self.capacity, self.next_id, []
            self.next_id += 1
        content.append((piece, self.capacity - f))
        f -= length
        if f == 0:
            return [(number, content)]
        if self.open == self.most:
            fullest = (self.free & -self.free).bit_length() - 1
            if f <= fullest:  # the new one is the fullest
                return [(number, content)]
            closed.append(self._take(fullest))
        self.bins[f].append((number, content))
        self.free |= 1 << f
        self.open += 1
        return closed

    def rest(self):
        for held in self.bins:
            yield from held
            held.clear()
        self.free = self.open = 0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def pack(documents: DataFrame, scratch: Scratch, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, open_bins: int = 256, fan_in: int = 32) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it."""

    def first(batches):
        from pyspark import TaskContext

        task, enc = TaskContext.get().partitionId(), encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        packer = BestFit(capacity, open_bins, task << 36)
        rows: list[tuple] = []

        def emit(bins, closed=True):
            for number, content in bins:
                for piece, offset in content:
                    rows.append((*piece, number, offset, task, closed))

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for doc, found in zip(part.column(0).to_pylist(), enc.batch(part.column(1).to_pylist()), strict=True):
                    ids = memoryview(found.astype("<u4", copy=False).tobytes() + end)
                    n, at, k = len(ids) // 4, 0, 0
                    while at < n:
                        size = (n - at) % capacity or capacity
                        piece = (doc, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]))
                        emit(packer.add(piece, size))
                        at, k = at + size, k + 1
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows.clear()
        emit(packer.rest(), closed=False)
        for at in range(0, len(rows), 50_000):
            yield _batch(rows[at : at + 50_000])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done = scratch.keep(rows.mapInArrow(lean(first), PIECES), "packed")
    parts = [done.where("closed")]
    left = done.where("not closed")
    last = left.agg(F.max("task")).first()[0]
    level = 0
    while last is not None:
        level += 1
        groups = last // fan_in + 1
        final = groups == 1
        base = level << 58

        def again(batches, base=base, final=final):
            """Streams of one group after another."""
            group, packer = None, None
            rows: list[tuple] = []

            def emit(bins, closed=True):
                for number, content in bins:
                    rows.extend((*piece, number, offset, group, closed) for piece, offset in content)

            for batch in batches:
                for found, *piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if found != group:
                        if packer is not None:
                            emit(packer.rest(), closed=final)
                        group, packer = found, BestFit(capacity, open_bins, base + (found << 36))
                    emit(packer.add(tuple(piece), piece[3]))
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows.clear()
            if packer is not None:
                emit(packer.rest(), closed=final)
            if rows:
                yield _batch(rows)

        stream = left.withColumn("pack_group", F.floor(F.col("task") / fan_in).cast("int"))
        stream = stream.repartition(groups, "pack_group").sortWithinPartitions("pack_group", "task", "sequence_id", "offset").select("pack_group", *_NAMES[:5])
        packed = scratch.keep(stream.mapInArrow(lean(again), PIECES), f"repacked{level}")
        parts.append(packed.where("closed"))
        left, last = packed.where("not closed"), None if final else groups - 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("task", "closed")
