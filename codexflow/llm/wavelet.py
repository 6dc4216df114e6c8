"""Token-id output: one compressed wavelet-matrix file per shard.

A file holds the ids of consecutive documents.  The symbols that occur are
renumbered densely, and the sequence is kept as bit-planes from the highest bit
down; each plane is the stable partition of the one before it.  Planes are stored in
blocks of ``BLOCK`` bits, compressed one by one, and the file holds for every plane
where its blocks begin and how many ones lie before each.  With these ``rank`` and
``select`` read one block of a plane, so the id at a place (``access``), the number of
times an id occurs in a range (``count``) and its places (``occurrences``) cost a block
or two of each plane, and the rest of the file is neither read nor decoded.

Rows
    Null texts count as empty; every document ends with the end id, so none is
    without ids.  Documents are written in ascending ``doc_id``, null ids first;
    repeated ids stand in the order of their texts.  An empty table gives no
    files and no rows.  Columns other than the id and the text are not read, whatever
    their names.  Long texts are encoded whole.  A range of ids is a task's; rows that
    share an id, or have none, are cut into ranges by the beginnings of their texts.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder
from .storage import Scratch, open_in, open_out, spread

MAGIC = b"CFWM\x02"
KEPT = 256  # blocks that an open file keeps decoded
BLOCK = 1 << 16  # bits that are compressed together, with an entry in the rank directory

MANIFEST = "pid int, shard int, path string, docs long, tokens long, before long"
RECORDS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_matrix(out, ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> None:
    """Write one shard: its ids, and the ids and lengths of its documents."""
    import zstandard

    n = len(ids)
    seen = np.bincount(ids) if n else np.zeros(0, np.int64)
    alphabet = np.flatnonzero(seen).astype("<u4")
    bits = max(1, int(len(alphabet) - 1).bit_length()) if n else 0
    code = np.zeros(len(seen), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    code[alphabet] = np.arange(len(alphabet))
    cur = code[ids]
    blobs, zeros, before, ends = [], [], [], []
    thin = zstandard.ZstdCompressor(level=1).compress
    for b in range(bits - 1, -1, -1):
        one = (cur & (1 << b)) != 0
        plane = np.packbits(one, bitorder="little")
        parts = [thin(plane[at : at + BLOCK // 8].tobytes()) for at in range(0, len(plane), BLOCK // 8)]
        blobs.append(b"".join(parts))
        ends.append(np.cumsum([len(x) for x in parts]))
        ones = np.add.reduceat(one, np.arange(0, n, BLOCK), dtype=np.int64)
        before.append(np.cumsum(ones) - ones)
        low = cur[~one]
        zeros.append(len(low))
        cur = np.concatenate([low, cur[one]])
    squeeze = zstandard.ZstdCompressor(level=3).compress
    known = np.array([d is not None for d in doc_ids], bool)
    side = [
        squeeze(alphabet.tobytes()),
        squeeze(np.array([d or 0 for d in doc_ids], "<i8").tobytes()),
        squeeze(np.packbits(known, bitorder="little").tobytes()),
        squeeze(lengths.astype("<i8").tobytes()),
        squeeze(np.array(ends, "<u4").tobytes()),
        squeeze(np.array(before, "<u8").tobytes()),
    ]
    head = json.dumps({"n": n, "block": BLOCK, "docs": len(doc_ids), "bits": bits, "zeros": zeros, "planes": [len(x) for x in blobs], "side": [len(x) for x in side]}).encode()
    out.write(MAGIC + struct.pack("<I", len(head)) + head)
    for x in (*side, *blobs):
        out.write(x)


class WaveletMatrix:
    """A shard's file, opened for queries."""

    def __init__(self, file):
        import zstandard

        self.file = file
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        (size,) = struct.unpack("<I", file.read(4))
        head = json.loads(file.read(size))
        self.n, self.bits, self.zeros, self.docs = head["n"], head["bits"], head["zeros"], head["docs"]
        self._open = zstandard.ZstdDecompressor().decompress
        side = [self._open(file.read(x)) for x in head["side"]]
        self.alphabet = np.frombuffer(side[0], "<u4")
        known = np.unpackbits(np.frombuffer(side[2], np.uint8), count=self.docs, bitorder="little")
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(side[1], "<i8"), known, strict=True)]
        self.lengths = np.frombuffer(side[3], "<i8")
        self._size = head["block"]
        blocks = -(-self.n // self._size)
        self._ends = np.frombuffer(side[4], "<u4").reshape(self.bits, blocks).astype(np.int64)
        self._before = np.frombuffer(side[5], "<u8").reshape(self.bits, blocks).astype(np.int64)
        at = len(MAGIC) + 4 + size + sum(head["side"])
        self._where = (at + np.cumsum([0, *head["planes"]])).tolist()
        self._held: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()

    def _raw(self, level: int) -> np.ndarray:
        """All bytes of a plane."""
        self.file.seek(self._where[level])
        data = memoryview(self.file.read(self._where[level + 1] - self._where[level]))
        ends = [0, *self._ends[level].tolist()]
        return np.frombuffer(b"".join(self._open(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)), np.uint8)

    def _block(self, level: int, no: int) -> np.ndarray:
        """The bytes of a block of a plane; the last few that were used are kept."""
        key = level, no
        if key in self._held:
            self._held.move_to_end(key)
            return self._held[key]
        begin = int(self._ends[level, no - 1]) if no else 0
        self.file.seek(self._where[level] + begin)
        self._held[key] = np.frombuffer(self._open(self.file.read(int(self._ends[level, no]) - begin)), np.uint8)
        if len(self._held) > KEPT:
            self._held.popitem(last=False)
        return self._held[key]

    def _bit(self, level: int, i: int) -> int:
        i, no = i % self._size, i // self._size
        return int(self._block(level, no)[i >> 3]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        if i >= self.n:
            return self.n - self.zeros[level]
        no, i = i // self._size, i % self._size
        if i == 0:
            return int(self._before[level, no])
        raw = self._block(level, no)[: -(-i // 8)]
        last = int(raw[-1]) & ((1 << (i - 8 * (len(raw) - 1))) - 1)
        return int(self._before[level, no]) + int(np.bitwise_count(raw[:-1]).sum()) + last.bit_count()

    def _place(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of a kind in a plane."""
        before = self._before[level] if bit else np.arange(self._before.shape[1]) * self._size - self._before[level]
        no = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(self._block(level, no), count=min(self._size, self.n - no * self._size), bitorder="little")
        return no * self._size + int(np.flatnonzero(part == bit)[k - int(before[no])])

    def _code(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            code = code << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return int(self.alphabet[code])

    def _range(self, code: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if code >> (self.bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often an id occurs from place lo up to, but not at, place hi."""
        code, hi = self._code(token), self.n if hi is None else hi
        if code is None or lo >= hi:
            return 0
        a, b = self._range(code, max(lo, 0), min(hi, self.n))
        return b - a

    def rank(self, token: int, i: int) -> int:
        return self.count(token, 0, i)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of an id."""
        code = self._code(token)
        a, b = self._range(code, 0, self.n) if code is not None else (0, 0)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            bit = code >> (self.bits - 1 - level) & 1
            i = self._place(level, bit, i - self.zeros[level] * bit)
        return i

    def occurrences(self, token: int) -> Iterator[int]:
        for k in range(self.count(token)):
            yield self.select(token, k)

    def ids(self) -> np.ndarray:
        """The whole sequence, by undoing the partitions from the last plane up."""
        code = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self._raw(level), count=self.n, bitorder="little").view(bool)
            above = np.empty_like(code)
            above[~one] = code[: self.zeros[level]]
            above[one] = code[self.zeros[level] :] | (1 << (self.bits - 1 - level))
            code = above
        return self.alphabet[code]


def write_shards(documents: DataFrame, scratch: Scratch, tokenizer_path: str, end_id: int = 0, shard_tokens: int = 1 << 20) -> DataFrame:
    """Encode and write all documents in ascending doc_id; one row per file written.

    Partitions are ranges of doc_id.  ``pid`` and ``shard`` order the files;
    ``before`` is the number of ids before the file in its partition.  A task that
    runs again writes files of new names, and only the rows of the task that
    counts are in the manifest.
    """
    folder = scratch.path("shards")

    def write(batches):
        from pyspark import TaskContext

        pid, enc = TaskContext.get().partitionId(), encoder(tokenizer_path)
        end = np.array([end_id], np.uint32)
        attempt, shard, before = uuid.uuid4().hex[:8], 0, 0
        parts: list[np.ndarray] = []
        docs: list[int | None] = []
        lengths: list[int] = []
        held = 0

        def flush():
            nonlocal shard, before, held
            path = f"{folder}/part-{pid:06d}-{shard:05d}-{attempt}.cfwm"
            ids = np.concatenate(parts)
            with open_out(path) as out:
                write_matrix(out, ids, docs, np.array(lengths, np.int64))
            row = [pid, shard, path, len(docs), len(ids), before]
            shard, before, held = shard + 1, before + len(ids), 0
            parts.clear(), docs.clear(), lengths.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["pid", "shard", "path", "docs", "tokens", "before"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, ids in zip(part.column(0).to_pylist(), enc.batch(part.column(1).to_pylist()), strict=True):
                    parts += (ids, end)
                    docs.append(doc)
                    lengths.append(len(ids) + 1)
                    held += lengths[-1]
                    if held >= shard_tokens:
                        yield flush()
        if docs:
            yield flush()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the beginnings of the texts let ranges cut the rows of one id
    ranges = rows.withColumn("begin", F.substring("text", 1, 16)).repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("begin").asc_nulls_first()).drop("begin")
    ordered = ranges.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return scratch.keep(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids of every document, from the files."""
    # One number for each range partition comes to the driver, not one for each file or document.
    totals = sorted((r["pid"], r["tokens"]) for r in manifest.groupBy("pid").agg(F.sum("tokens").alias("tokens")).collect())
    starts, at = {}, 0
    for pid, tokens in totals:
        starts[pid] = at
        at += tokens

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open_in(row["path"]) as file:
                    matrix = WaveletMatrix(file)
                    ids = matrix.ids()
                ends = np.cumsum(matrix.lengths)
                begins = ends - matrix.lengths
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(matrix.doc_ids, pa.int64()), pa.array(begins + (starts[row["pid"]] + row["before"])), pa.array(matrix.lengths), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return spread(manifest, "tokens", 4 << 20).mapInArrow(read, RECORDS)
