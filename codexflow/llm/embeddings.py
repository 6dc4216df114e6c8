"""Near-duplicate embeddings: iterative quantisation and multi-index Hamming tables.

ITQ learns a rotation of the principal axes under which signs are balanced and keep
closeness; a few rotations from different starts give enough bits.  The code is cut
into substrings, one Hamming table each: vectors that agree in a substring meet in a
bucket.  There the original vectors decide, in double precision, who is linked.  A
pair counts in the first table in which it meets, so nothing is counted twice, and
no pairs are written: a bucket gives for each vector the number of its links and the
smallest vector that it reaches inside the bucket.  Equal vectors are one entry with
a count.  Buckets over ``block`` are cut into parts, and every two parts are a piece
of work of their own.

The rotations are fitted on at most ``sample`` vectors of at most ``sample_bytes``
(or on 500), those of smallest hash.  Signs
are taken around the mean, which keeps buckets small but widens the angle of close
pairs when the table has a common direction.  So partners at exactly the threshold
are planted beside the sample, and the number and length of the substrings are those
of the least work, for the number of rows, that find ``recall`` of them; so both grow with
the table.  If none do, all vectors are compared.

Rows
    Vectors that are null, zero, or hold null or non-finite components link with
    nothing.  Shorter vectors count as if zeros followed.  Rows with the same id are
    vectors of their own.  A null id is kept, without a component.  Very long vectors
    make the fitted sample smaller.  Ties: a component has the name of its smallest id.
    Empty tables give no rows; further columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import Scratch
from .vectors import matrix, widest


def itq(x: np.ndarray, bits: int, seed: int, rounds: int = 50) -> np.ndarray:
    """A projection (columns are bits) learned on centred rows."""
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :bits]
    v = x @ axes
    r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((axes.shape[1],) * 2))
    for _ in range(rounds):
        code = np.where(v @ r >= 0, 1.0, -1.0)
        a, _, b = np.linalg.svd(code.T @ v)
        r = b.T @ a.T
    return axes @ r


def fit(sample: np.ndarray, tables: int, bits: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to tables * bits) of normalised vectors."""
    mean = sample.mean(axis=0)
    parts, have, wanted = [], 0, tables * bits
    while have < wanted:
        # each rotation begins from another seeded start, on another part of the sample
        part = sample[len(parts) % 2 :: 2] if len(sample) > 4 else sample
        p = itq(part - mean, min(sample.shape[1], wanted - have), seed + len(parts))
        parts.append(p)
        have += p.shape[1]
    return mean, np.concatenate(parts, axis=1)


def planted(x: np.ndarray, threshold: float, seed: int = 7, most: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Normalised vectors and partners at the threshold: every other one in any direction,
    the others in that of another vector of the sample."""
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))[:most]]
    x = np.tile(x, (-(-500 // len(x)), 1))  # few vectors get several partners
    away = rng.standard_normal(x.shape)
    away[1::2] = x[rng.integers(0, len(x), len(away[1::2]))]
    away -= (away * x).sum(axis=1, keepdims=True) * x
    size = np.sqrt((away * away).sum(axis=1, keepdims=True))
    some = size[:, 0] > 1e-9
    return x[some], threshold * x[some] + np.sqrt(1 - threshold**2) * away[some] / size[some]


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """The key of each row in each table."""
    signs = ((x - mean) @ projection[:, : tables * bits] >= 0).reshape(len(x), tables, bits)
    return (signs @ (1 << np.arange(bits, dtype=np.int64))) + (np.arange(tables) << bits)


def shape(sample: np.ndarray, rows: int, threshold: float, tables: int, bits: int, recall: float = 0.985, entry: float = 100.0) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(mean, projection, tables, bits): the numbers of substrings and of their bits, from ``tables`` and up to
    ``bits``, that find the planted partners with the least work for so many rows.

    Longer substrings make smaller buckets but need more tables for the same recall, so both grow with
    the logarithm of the rows.  Work for a vector is the vectors that it meets, as the sample tells, and
    ``entry`` for each table that it is put into."""
    x, y = planted(sample, threshold)
    mean, projection = fit(sample, tables, bits)
    best, t = (float(rows), 1, 0), tables  # no bits: every pair is compared
    while t <= 16 * tables:
        if projection.shape[1] < t * bits:
            mean, projection = fit(sample, t, bits)
        found = lambda b: not len(x) or (codes(x, mean, projection, t, b) == codes(y, mean, projection, t, b)).any(axis=1).mean() >= recall  # noqa: B023, E731
        b = next((b for b in range(bits, 0, -1) if found(b)), 0)
        if b:
            sizes = np.unique(codes(sample, mean, projection, t, b), return_counts=True)[1].astype(float)
            met = rows * float((sizes * (sizes - 1)).sum()) / max(1, len(sample) * (len(sample) - 1))
            best = min(best, (met + entry * t, t, b))
            if met <= entry * t:
                break
        t *= 2
    return mean, projection, best[1], best[2]


def _links(batch: pa.RecordBatch, dim: int, kind: str, threshold: float, tables: int, bits: int):
    """Work through sorted groups; gives (rep, links, smallest reached)."""
    key, i, j = (batch.column(c).to_numpy() for c in ("key", "i", "j"))
    chunk = batch.column("chunk").to_numpy()
    rep, n = batch.column("rep").to_numpy(), batch.column("n").to_numpy()
    v = np.stack([np.frombuffer(x.as_py(), kind) for x in batch.column("v")]).astype(float) if batch.num_rows else np.zeros((0, dim))
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    keys = np.stack([x.values.to_numpy() for x in batch.column("keys")])
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    ends = np.append(new[1:], len(key))
    sizes = ends - new
    pairs_a, pairs_b = [], []
    # small groups together: row r with row r + d, for each d
    small = np.repeat(sizes <= 64, sizes)
    group = np.repeat(np.arange(len(new)), sizes)
    for d in range(1, int(sizes[sizes <= 64].max(initial=0))):
        at = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
        at = at[(i[at] == j[at]) | (chunk[at] != chunk[at + d])]
        close = np.einsum("xy,xy->x", v[at], v[at + d]) >= threshold
        pairs_a.append(at[close])
        pairs_b.append(at[close] + d)
    for a, b in zip(new[sizes > 64].tolist(), ends[sizes > 64].tolist(), strict=True):
        if i[a] == j[a]:
            one = two = np.arange(a, b)
        else:
            one, two = a + np.flatnonzero(chunk[a:b] == i[a]), a + np.flatnonzero(chunk[a:b] == j[a])
        x, y = np.nonzero(v[one] @ v[two].T >= threshold)
        if i[a] == j[a]:
            x, y = x[x < y], y[x < y]
        pairs_a.append(one[x])
        pairs_b.append(two[y])
    a = np.concatenate(pairs_a) if pairs_a else np.zeros(0, np.int64)
    b = np.concatenate(pairs_b) if pairs_b else np.zeros(0, np.int64)
    if not len(a):
        return None
    table = key[a] >> bits
    met = np.zeros(len(a), bool)
    for t in range(tables - 1):
        met |= (t < table) & (keys[a, t] == keys[b, t])
    links = np.zeros(len(key), np.int64)
    np.add.at(links, a[~met], n[b[~met]])
    np.add.at(links, b[~met], n[a[~met]])
    label = rep.copy()
    while True:
        low = np.minimum(label[a], label[b])
        if (low == label[a]).all() and (low == label[b]).all():
            break
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
    some = np.flatnonzero((links > 0) | (label != rep))
    return rep[some], links[some], label[some]


def link(vectors: DataFrame, scratch: Scratch, threshold: float = 0.95, tables: int = 16, bits: int = 24, sample: int = 20_000, sample_bytes: int = 64 << 20, block: int = 1024, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    dim = widest(vectors, column)
    kind = "<f4" if vectors.schema[column].dataType.simpleString() == "array<float>" else "<f8"

    def read(batches):
        import xxhash

        for batch in batches:
            there, x = matrix(batch.column(1), dim)
            there, x = there[(x != 0).any(axis=1)], x[(x != 0).any(axis=1)] + 0.0  # no negative zero
            raw = [None] * batch.num_rows
            for at, row in zip(there.tolist(), x.astype(kind), strict=True):
                raw[at] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r and xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "digest", "v"])

    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column))
    rows = scratch.keep(rows.mapInArrow(read, "vec_id long, digest binary, v binary"), "vectors")
    same = rows.where("digest is not null and vec_id is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    members = scratch.keep(rows.drop("v").join(same, "digest", "left").select("vec_id", "rep", "n"), "members")
    reps = rows.join(same, "digest").where("vec_id = rep").select("rep", "n", "v").dropDuplicates(["rep"])
    taken = [np.frombuffer(bytes(r["v"]), kind) for r in reps.select("v", F.xxhash64("rep").alias("h")).orderBy("h").limit(max(500, min(sample, sample_bytes // (8 * max(1, dim))))).collect()]
    if not taken:
        return members.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    x = np.stack(taken).astype(float)
    mean, projection, tables, bits = shape(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), reps.count(), threshold, tables, bits)
    model = spark.sparkContext.broadcast((mean, projection))

    def code(batches):
        mean, projection = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.frombuffer(r.as_py(), kind) for r in batch.column("v")]).astype(float)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            keys = codes(x, mean, projection, tables, bits)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.astype(np.int32).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], ["rep", "n", "v", "keys"])

    coded = scratch.keep(reps.mapInArrow(code, "rep long, n long, v binary, keys array<int>"), "codes")
    entries = coded.select("rep", F.explode("keys").alias("key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key", F.ceil(F.col("size") / block).cast("int").alias("chunks"))
    # only keys and ids meet the bucket sizes; the vectors are joined to what is left
    placed = entries.join(buckets, "key").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.select("rep", "key", "chunk", F.least("chunk", "k").alias("i"), F.greatest("chunk", "k").alias("j"))
    work = placed.join(coded, "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")

    def find(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tail = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            last = [tail.column(c)[-1].as_py() for c in ("key", "i", "j")]
            mine = np.ones(tail.num_rows, bool)
            for c, value in zip(("key", "i", "j"), last, strict=True):
                mine &= tail.column(c).to_numpy() == value
            cut = tail.num_rows - int(mine.sum())
            if cut and (out := _links(tail.slice(0, cut), dim, kind, threshold, tables, bits)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["rep", "links", "reached"])
            held = [tail.slice(cut)]
        if held and (out := _links(pa.Table.from_batches(held).combine_chunks().to_batches()[0], dim, kind, threshold, tables, bits)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["rep", "links", "reached"])

    found = scratch.keep(work.mapInArrow(find, "rep long, links long, reached long"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("rep").alias("a"), F.col("reached").alias("b")), scratch)
    about = counts.join(label.select(F.col("vertex").alias("rep"), "component"), "rep", "left")
    out = members.join(about, "rep", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "rep", "vec_id"))
    return out.select(
        "vec_id",
        F.when(F.col("rep").isNull() | F.col("vec_id").isNull(), 0).otherwise(F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
