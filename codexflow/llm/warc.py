"""WARC archives: writing with segments and revisits, and reassembly on reading.

Records are compressed one by one.  A block over ``segment_bytes`` is written as a
first record and ``continuation`` records; the last of them carries the total
length.  Archives are closed at ``archive_bytes``, between any two records, so the
segments of a record may lie in two archives.  Reading gives each record's parts;
those of segmented records are grouped by the origin's id, ordered by their
number, checked against the total length, joined, and only then is the HTTP
framing undone: header fields are set apart and a chunked body is put together.

Rows
    A null payload counts as empty.  Repeated page ids are records of their own; if
    theirs is the smallest id of a payload they are all responses, and revisits name the
    first of them in the table.  A null page id comes back as null; among equal payloads it is the
    response only if no page with an id holds the same.  Payloads of less than
    ``revisit_from`` bytes are always responses.  Long payloads are written in segments.
    An empty table gives no archive and no rows.  Columns other than the id, the url and
    the payload are not read, whatever their names.  A record that cannot be put together
    comes back with a ``problem`` and no payload, and so does a revisit whose response is
    missing, broken or of another digest.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, open_in, open_out, quoted, spread

ARCHIVES = "path string, records long, bytes long"
PARTS = "record_id string, origin_id string, segment int, total long, kind string, target string, refers_to string, digest string, block binary"
WHOLE = "record_id string, kind string, target string, refers_to string, payload_bytes long, payload_digest string, problem string"
_PART_NAMES = ["record_id", "origin_id", "segment", "total", "kind", "target", "refers_to", "digest", "block"]
_PART_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
_WHOLE_NAMES = ["record_id", "kind", "target", "refers_to", "payload_bytes", "payload_digest", "problem"]
_WHOLE_TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

DATE = "2020-01-01T00:00:00Z"  # fixed, so that reruns write the same bytes
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int) -> bytes:
    """Chunked transfer framing of a body."""
    parts = []
    for at in range(0, len(body), size):
        piece = body[at : at + size]
        parts += (b"%x\r\n" % len(piece), piece, b"\r\n")
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """Undo chunked framing; chunk extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk's size line does not end")
        size = int(framed[at:end].split(b";", 1)[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        piece = framed[at : at + size]
        if len(piece) < size or framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(piece)
        at += size + 2


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields in lower case, body without transfer framing)."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP header")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("latin-1")
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = unchunked(body)
    return fields, body


def record_bytes(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an uncompressed stream: (fields in lower case, block)."""
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = {}
        while (line := file.readline()).strip():
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        size = int(fields["content-length"])
        block = file.read(size)
        if len(block) < size:
            raise ValueError("a record's block is cut short")
        yield fields, block


def read_archive(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive, compressed or not, one at a time."""
    start = file.read(2)
    file.seek(0)
    if start != b"\x1f\x8b":
        yield from parse_records(io.BufferedReader(file))
        return
    data = b""
    while data or (data := file.read(1 << 20)):
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if not data and not (data := file.read(1 << 20)):
                raise ValueError("an archive is cut short")
            out.append(inflate.decompress(data))
            data = inflate.unused_data
        yield from parse_records(io.BytesIO(b"".join(out)))


def write_archives(pages: DataFrame, scratch: Scratch, page_id: str = "page_id", url: str = "url", payload: str = "html", revisit_from: int = 0, segment_bytes: int = 32 << 10, chunk_bytes: int = 8 << 10, archive_bytes: int = 32 << 20) -> DataFrame:
    """Write every row as a record; gives the archives that count.

    Equal payloads meet by their SHA-1: only the digest and the smallest id are brought
    together, with partial sums first, and the join with the rows is one that Spark can
    split where one payload is very frequent.  A record's id is made of the page's id and
    the row's place in the table, which is read twice and has to come in the same
    partitions and order both times, as the scan of stored files does."""
    rows = pages.select(
        F.col(quoted(page_id)).cast("long").alias("page_id"),
        F.col(quoted(url)).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(quoted(payload)).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("row", F.monotonically_increasing_id())
    held = rows.select("page_id", "digest", "row", F.length("payload").alias("n"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    first = held.where(F.col("n") >= revisit_from).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("first_digest"), "first")
    name = lambda page, row: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))
    marked = rows.join(first, rows["digest"] == first["first_digest"], "left").select(
        name(F.col("page_id"), F.col("row")).alias("record_id"), "url", "digest", "payload",
        F.when(F.col("first_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id")), name(F.col("first.page_id"), F.col("first.row"))).alias("refers_to"),
    )
    folder = scratch.path("archives")

    def write(batches):
        from pyspark import TaskContext

        pid, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:8]
        out, path, size, count, number = None, "", 0, 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

        for batch in batches:
            for record_id, target, digest, body, origin in zip(*(batch.column(n) for n in range(5)), strict=True):
                record_id, origin, body, digest = record_id.as_py(), origin.as_py(), body.as_py(), base64.b32encode(digest.as_py()).decode()
                target = (target.as_py() or "").replace("\r", "%0D").replace("\n", "%0A")
                common = [("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
                if origin is not None:
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
                    records = [record_bytes([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), ("WARC-Refers-To", origin), ("WARC-Profile", PROFILE), *common], block)]
                else:
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(body, chunk_bytes)
                    cuts = range(0, len(block), segment_bytes)
                    segmented = len(cuts) > 1
                    records = [record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", record_id), ("WARC-Segment-Number", 1 if segmented else None), *common], block[:segment_bytes])]
                    for n, at in enumerate(cuts[1:], 2):
                        last = n == len(cuts)
                        records.append(record_bytes([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id[:-1] + f"/{n}>"), ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", len(block) if last else None), ("WARC-Date", DATE)], block[at : at + segment_bytes]))
                for record in records:
                    if out is None:
                        path, size, count = f"{folder}/part-{pid:06d}-{number:05d}-{attempt}.warc.gz", 0, 0
                        out, number = open_out(path), number + 1
                    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = squeeze.compress(record) + squeeze.flush()
                    out.write(data)
                    size, count = size + len(data), count + 1
                    if size >= archive_bytes:
                        yield done()
                        out = None
        if out is not None:
            yield done()

    return scratch.keep(marked.mapInArrow(write, ARCHIVES), "archives-written")


def _finish(part: dict, block: bytes, problem: str | None = None) -> tuple:
    n = digest = None
    if problem is None:
        try:
            fields, body = http_payload(block)
            if part["kind"] == "revisit":
                n, digest = int(fields["content-length"]), part["digest"]
            else:
                n, digest = len(body), base32_sha1(body)
                if part["digest"] and part["digest"] != digest:
                    n, digest, problem = None, None, "the payload's digest differs"
        except (ValueError, KeyError) as e:
            problem = str(e)
    return part["record_id"], part["kind"], part["target"], part["refers_to"], n, digest, problem


def _table(rows: list[tuple], names, types) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def reassemble(segments: list[dict]) -> tuple:
    """One record of its segments, which may come in any order."""
    segments = sorted(segments, key=lambda s: s["segment"])
    head = segments[0]
    numbers = [s["segment"] for s in segments]
    block = b"".join(s["block"] for s in segments)
    if head["segment"] != 1:
        head = head | {"record_id": head["origin_id"], "kind": None}
    if numbers != list(range(1, len(numbers) + 1)):
        return _finish(head, b"", f"segments {numbers}")
    totals = {s["total"] for s in segments if s["total"] is not None}
    if totals != {len(block)}:
        return _finish(head, b"", f"total length {sorted(totals)}, found {len(block)}")
    return _finish(head, block)


def read_archives(archives: DataFrame, scratch: Scratch) -> DataFrame:
    """All records of the archives (column ``path``), each whole."""

    def parts(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with open_in(path) as file:
                    for f, block in read_archive(file):
                        kind = f.get("warc-type")
                        if kind not in ("response", "revisit", "continuation", "resource"):
                            continue
                        record = f["warc-record-id"]
                        segment = int(f["warc-segment-number"]) if "warc-segment-number" in f else None
                        total = int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None
                        digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        part = dict(zip(_PART_NAMES, (record, f.get("warc-segment-origin-id", record), segment, total, kind, f.get("warc-target-uri"), f.get("warc-refers-to"), digest, block), strict=True))
                        if segment is None:
                            *_, n, found, problem = _finish(part, block)
                            # a record in one piece is finished here; only its figures go on
                            part |= {"block": None, "total": n, "digest": found, "origin_id": problem}
                        rows.append(tuple(part.values()))
                        held += 200 + len(part["block"] or b"")
                        if held > 4 << 20:
                            yield _table(rows, _PART_NAMES, _PART_TYPES)
                            rows, held = [], 0
                if rows:
                    yield _table(rows, _PART_NAMES, _PART_TYPES)

    found = scratch.keep(spread(archives, "bytes", 128 << 20).select("path").mapInArrow(parts, PARTS), "records")
    single = found.where("segment is null").select("record_id", "kind", "target", "refers_to", F.col("total").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("origin_id").alias("problem"))

    def join(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_table([reassemble(table.to_pylist())], _WHOLE_NAMES, _WHOLE_TYPES)])

    whole = single.unionByName(found.where("segment is not null").groupBy("origin_id").applyInArrow(join, WHOLE))
    # a revisit counts only with the response that it names; a frequent response is the small side of a join that Spark can split
    whole = scratch.keep(whole, "whole")
    named = whole.where("kind = 'response' and problem is null").select(F.col("record_id").alias("named_id"), F.col("payload_digest").alias("named_digest"), F.col("payload_bytes").alias("named_bytes"))
    revisits = whole.where("kind = 'revisit' and problem is null").join(named, F.col("refers_to") == F.col("named_id"), "left")
    right = (F.col("payload_digest") == F.col("named_digest")) & (F.col("payload_bytes") == F.col("named_bytes"))
    why = F.when(F.col("named_id").isNull(), "no response of that id").when(~right, "the response's payload differs")
    checked = revisits.withColumn("problem", why).withColumn("payload_bytes", F.when(why.isNull(), F.col("payload_bytes"))).withColumn("payload_digest", F.when(why.isNull(), F.col("payload_digest")))
    return whole.where("not (kind <=> 'revisit' and problem is null)").unionByName(checked.select(*whole.columns))


def page_records(whole: DataFrame) -> DataFrame:
    """Per page: its id, the payload's size and digest, and what its record is."""
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d*):\d+>$", 1).try_cast("long")
    return whole.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), page("refers_to").alias("refers_to"), "problem")
