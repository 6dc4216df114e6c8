"""Near-duplicate documents by DartMinHash signatures and banded joining.

Elements are five-word runs with their occurrence number (``hashing.shingles_of``),
so a set of elements is the weighted set of the runs' counts.  Darts are thrown at
the plane of elements and ranks: a region (an element and a range of ranks) gets a
Poisson number of darts from the region's hash, each with a coordinate and a rank of
its own.  The darts in a document's regions are the same for every document that
has the element; per coordinate the one of least rank is kept.  Regions of low rank
come first, and a document throws on until all its coordinates are hit, about
k log k darts in all, however long it is.  Two documents agree in a coordinate with
the probability of their weighted Jaccard similarity.

Joining.  Copies of a text are one class from the start.  In a bucket (documents
that agree in a band) every member is paired with one seeded member, the star, so
the number of pairs is linear in the bucket.  Pairs whose signatures agree in far
fewer coordinates than a link's would (five standard deviations) are left out; the
others are decided by the exact similarity of the whole texts, and linked documents
get a component.  What is then left in a bucket, pairs of
different components, is compared by signatures too: every member that the star did
not reach with every other, in pieces of bounded size; those that may be links are
decided exactly in place, the likeliest first, until the components are joined.  No
pair of a bucket is lost to a cap.  Buckets that hold a fair part of all entries are
dealt to several tasks by a salt wherever rows meet by their bucket, and pieces are
bounded by rows and by elements.

Rows
    A null text is linked with nothing and is its own class.  Texts without words
    link only with equal texts; texts of fewer than five words have one run.  Ties
    go to the smallest id.  Rows with the same id and text are one document; ids
    that come with several texts join their classes.  A row without an id gets a
    null class and is kept.  Further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, hot_keys, join_hot
from .hashing import _ODD, U, batches_of, mix, shingles_of
from .storage import Scratch, lean, slices

COORDINATES, BANDS, ROWS = 128, 25, 5
_EMPTY = U(0xFFFFFFFFFFFFFFFF)
_FIRST = 6  # the first region is the ranks below 2**-_FIRST


def _poisson(rate: float) -> np.ndarray:
    """Probabilities of at most 0, 1, 2, ... darts."""
    terms = [math.exp(-rate)]
    for n in range(1, 16):
        terms.append(terms[-1] * rate / n)
    return np.cumsum(terms)


def _times(n: int, odd: int) -> np.uint64:
    return U(n * int(_ODD[odd]) & 0xFFFFFFFFFFFFFFFF)


def signatures(elements: np.ndarray, owner: np.ndarray, texts: int, seed: int = 11) -> np.ndarray:
    """A row of COORDINATES values for each text; texts without elements stay empty."""
    out = np.full(texts * COORDINATES, _EMPTY, U)
    active = np.zeros(texts, bool)
    active[owner] = True
    base = mix(elements + _times(seed, 3))
    level = 0
    while active.any():
        here = active[owner]
        own, key = owner[here], base[here]
        if level <= _FIRST:  # ranks [0, 1/64), [1/64, 1/32), ... [1/2, 1)
            width = 2.0 ** (level - _FIRST - (level > 0))
            region = mix(key + _times(level + 1, 4))
        else:  # ranks [2**j, 2**(j + 1)) as regions of width 1
            units = 1 << (level - _FIRST - 1)
            width = 1.0
            own, key = np.repeat(own, units), np.repeat(key, units)
            unit = np.tile(np.arange(units, 2 * units, dtype=np.int64), len(own) // units).astype(U)
            region = mix(key + (unit + U(64)) * _ODD[4])
        chance = (region >> U(11)).astype(np.float64) * 2.0**-53
        hit = np.flatnonzero(chance >= math.exp(-width))
        number = np.searchsorted(_poisson(width), chance[hit], side="right")
        own, region = own[hit], region[hit]
        at = np.repeat(np.arange(len(own)), number)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number)
        rank = None
        if level > _FIRST:
            rank = unit[hit][at]
        dart = mix(region[at] + (nth.astype(U) + U(1)) * _ODD[5])
        cell = own[at] * COORDINATES + (dart & U(COORDINATES - 1)).astype(np.int64)
        open_ = out[cell] == _EMPTY
        cell, dart = cell[open_], dart[open_]
        if rank is None:
            np.minimum.at(out, cell, dart)
        else:  # the unit comes before the place within it
            rank = rank[open_]
            order = np.lexsort((dart, rank, cell))
            cell, dart = cell[order], dart[order]
            new = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
            out[cell[new]] = dart[new]
        active &= (out.reshape(texts, COORDINATES) == _EMPTY).any(axis=1)
        level += 1
    return out.reshape(texts, COORDINATES)


def band_keys(sigs: np.ndarray) -> np.ndarray:
    rows = sigs[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    total = np.zeros(rows.shape[:2], U)
    for r in range(ROWS):
        total += rows[:, :, r] * _ODD[r]
    return mix(total + np.arange(1, BANDS + 1, dtype=np.int64).astype(U) * _ODD[6]).view(np.int64)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _bytes(sigs: np.ndarray) -> np.ndarray:
    """A byte of each coordinate, to compare whole signatures."""
    return (sigs >> U(40)).astype(np.uint8)


def least_agreement(threshold: float) -> int:
    """Coordinates that a link agrees in, but for five standard deviations."""
    return int(COORDINATES * (threshold - 5 * math.sqrt(threshold * (1 - threshold) / COORDINATES)))


def _sketch(batches):
    import xxhash

    for batch in slices(batches):
        ids, texts = batch.column(0), [t.as_py() for t in batch.column(1)]
        raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
        for a, b in batches_of(raw):
            elements, owner = shingles_of(raw[a:b])
            sigs = signatures(elements, owner, b - a)
            keys = band_keys(sigs)
            some = np.bincount(owner, minlength=b - a) > 0
            digest = [None if t is None else xxhash.xxh3_128_digest(t.encode("utf-8", "replace")) for t in texts[a:b]]
            short = [row.tobytes() for row in _bytes(sigs)]
            size = pa.array(np.bincount(owner, minlength=b - a).astype(np.int64))
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(digest, pa.binary()), pa.array(short, pa.binary()), size, _lists(keys[some].reshape(-1), some * BANDS)], ["doc_id", "digest", "sig", "size", "bands"])


def _elements(batches):
    for batch in slices(batches):
        ids = batch.column(0)
        raw = [(t.as_py() or "").lower().encode("utf-8", "replace") for t in batch.column(1)]
        for a, b in batches_of(raw):
            elements, owner = shingles_of(raw[a:b])
            order = np.lexsort((elements, owner))
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), _lists(elements[order].view(np.int64), np.bincount(owner, minlength=b - a))], ["doc_id", "elements"])


def _compare(batches):
    for batch in batches:
        a, b = batch.column("ea"), batch.column("eb")
        sims = np.zeros(batch.num_rows)
        for n in range(batch.num_rows):
            x, y = a[n].values.to_numpy(zero_copy_only=False), b[n].values.to_numpy(zero_copy_only=False)
            both = len(np.intersect1d(x, y, assume_unique=True))
            sims[n] = both / max(1, len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("other"), pa.array(sims)], ["hub", "other", "sim"])


def _likely(need: int):
    """Keep pairs (hub, other) with signatures that agree in enough coordinates."""

    def keep(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("sa", "sb"))
            fine = pa.array((x == y).sum(axis=1) >= need)
            yield pa.RecordBatch.from_arrays([batch.column("hub").filter(fine), batch.column("other").filter(fine)], ["hub", "other"])

    return keep


def _rest(need: int, threshold: float):
    """Pairs of components with a link between a piece's strays and members, for pieces in sorted order.

    The likeliest partners come first, and a component that a stray has been linked to in this
    piece is not looked at again: one link is enough.  A pair that shares several bands is left to
    the bucket of the first."""

    def links(table: pa.Table):
        key = table.column("key")[0].as_py()
        role, rep, label = (table.column(c).to_numpy() for c in ("role", "rep", "label"))
        stray = table.column("stray").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        bands = np.stack([x.values.to_numpy() for x in table.column("bands")])
        elements = table.column("elements").combine_chunks()
        above: dict[int, int] = {}

        def find(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        one, two = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        lo, hi = [], []
        for at in range(0, len(one), 64):
            part = one[at : at + 64]
            agree = (sig[part][:, None, :] == sig[two][None, :, :]).sum(axis=2)
            close = (agree >= need) & (label[part][:, None] != label[two][None, :])
            close &= ~stray[two][None, :] | (rep[part][:, None] < rep[two][None, :])  # two strays meet in both orders
            for n in np.flatnonzero(close.any(axis=1)).tolist():
                x, ys = part[n], two[close[n]]
                same = bands[ys] == bands[x]
                ys, order = ys[bands[x][same.argmax(axis=1)] == key], agree[n][close[n]][bands[x][same.argmax(axis=1)] == key]
                mine = elements[int(x)].values.to_numpy()
                for y in ys[np.argsort(-order, kind="stable")].tolist():
                    a, b = find(int(label[x])), find(int(label[y]))
                    if a == b:
                        continue
                    other = elements[y].values.to_numpy()
                    if min(len(mine), len(other)) < threshold * max(len(mine), len(other)) - 1e-9:
                        continue
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    if both >= threshold * (len(mine) + len(other) - both) - 1e-9:
                        above[max(a, b)] = min(a, b)
                        lo.append(int(label[x]))
                        hi.append(int(label[y]))
        if lo:
            yield pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            ends = [table.column(c).to_numpy() for c in ("key", "i", "j")]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ends], axis=0)) + 1
            bounds = [0, *new.tolist()]
            for a, b in zip(bounds, bounds[1:], strict=False):
                yield from links(table.slice(a, b - a))
            held = table.slice(bounds[-1])
        if held is not None:
            yield from links(held)

    return run


def classes(documents: DataFrame, scratch: Scratch, threshold: float = 0.8, piece: int = 1024, piece_elements: int = 1 << 22) -> DataFrame:
    """doc_id, class_id (smallest id of the class), copy_of (smallest id with the same
    text) and kept (whether this is the class's document) of every row."""
    texts = _texts(documents)
    sketches = scratch.keep(texts.mapInArrow(lean(_sketch), "doc_id long, digest binary, sig binary, size long, bands array<long>"), "sketches")
    # a written table: both sides of the join are then plain shuffles, of which Spark splits the partition of a text with very many copies
    copies = scratch.keep(sketches.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "copies")
    own = F.col("doc_id") == F.col("rep")
    members = scratch.keep(sketches.join(copies, "digest", "left").select("doc_id", "rep", F.when(own, F.col("sig")).alias("sig"), "size", F.when(own, F.col("bands")).alias("bands")), "members")
    scratch.drop(sketches, copies)
    need = least_agreement(threshold)

    # Buckets of at least two classes.
    entries = members.where("bands is not null").select("rep", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    shared = scratch.keep(shared.select("key", "n"), "shared")
    hot = hot_keys(shared)
    held = scratch.keep(join_hot(entries, shared.select("key"), hot).distinct(), "buckets")
    wanted = held.select(F.col("rep").alias("wanted")).distinct()
    sigs = scratch.keep(members.where("sig is not null").join(wanted, F.col("rep") == F.col("wanted"), "left_semi").select("rep", "sig", "size", "bands").dropDuplicates(["rep"]), "signatures")
    elements = scratch.keep(texts.join(wanted, texts["doc_id"] == wanted["wanted"], "left_semi").dropDuplicates(["doc_id", "text"]).mapInArrow(lean(_elements), "doc_id long, elements array<long>"), "elements")

    def decide(pairs: DataFrame, name: str) -> DataFrame:
        """Links among pairs (hub, other).  The hub's elements come last, so that a hub
        of very many pairs is only multiplied in the join that Spark can split."""
        first = elements.select(F.col("doc_id").alias("other"), F.col("elements").alias("eb"))
        second = elements.select(F.col("doc_id").alias("hub"), F.col("elements").alias("ea"))
        both = pairs.join(first, "other").join(second, "hub").select("hub", "other", "ea", "eb")
        return scratch.keep(both.mapInArrow(lean(_compare), "hub long, other long, sim double").where(F.col("sim") >= threshold).select("hub", "other"), name)

    def likely(pairs: DataFrame, name: str) -> DataFrame:
        first, second = sigs.select(F.col("rep").alias("other"), F.col("sig").alias("sb")), sigs.select(F.col("rep").alias("hub"), F.col("sig").alias("sa"))
        both = pairs.join(first, "other").join(second, "hub").select("hub", "other", "sa", "sb")
        return scratch.keep(both.mapInArrow(lean(_likely(need)), "hub long, other long"), name)

    # ids that come with several texts join the classes of these
    named = members.where("rep is not null").select("doc_id", "rep")
    several = named.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b < last").select("doc_id", "b")
    links = named.join(several, "doc_id").select(F.col("rep").alias("a"), "b")
    lo, hi = F.least("rep", "star"), F.greatest("rep", "star")
    rank = F.struct(F.xxhash64("rep").alias("h"), F.col("rep").alias("v"))  # the same order in all buckets, so that pairs coincide
    stars = held.groupBy("key").agg(F.min(rank)["v"].alias("star"))
    pairs = join_hot(held, stars, hot).where("rep != star").groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.min("star").alias("hub"))
    pairs = pairs.select("hub", F.when(F.col("hub") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("other"))
    links = links.unionByName(decide(likely(pairs, "pairs"), "links").select(F.col("hub").alias("a"), F.col("other").alias("b")))
    label = components(links, scratch)
    # buckets with a member that the star did not reach are still open
    placed = held.join(label.select(F.col("vertex").alias("rep"), "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("label"))
    star = F.min(F.struct(F.xxhash64("rep").alias("h"), F.col("label").alias("l")))["l"]
    open_keys = placed.groupBy("key").agg(star.alias("star_label"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi and n > 2").select("key", "star_label")
    open_ = scratch.keep(join_hot(placed, open_keys, hot).select("key", "rep", "label", (F.col("label") != F.col("star_label")).alias("stray")), "open")

    # What is left: each stray with every member of its bucket, in pieces.
    # A piece holds about ``piece`` rows of each side, or fewer if they have many elements.
    once = elements.groupBy(F.col("doc_id").alias("rep")).agg(F.first("elements").alias("elements"))
    wide = open_.join(sigs, "rep")
    pieces = lambda some: F.ceil(F.greatest(F.sum(some) / piece, F.sum(some * F.col("size")) / piece_elements)).cast("int")
    sizes = wide.groupBy("key").agg(pieces(F.col("stray").cast("int")).alias("ni"), pieces(F.lit(1)).alias("nj"))
    rows = join_hot(wide.drop("size"), sizes, hot).join(once, "rep")
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    carry = ("rep", "label", "stray", "sig", "bands", "elements")
    one = rows.where("stray").select("key", part("ni").alias("i"), every("nj").alias("j"), F.lit(0).alias("role"), *carry)
    two = rows.select("key", every("ni").alias("i"), part("nj").alias("j"), F.lit(1).alias("role"), *carry)
    work = one.unionByName(two).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "role", "rep")
    more = scratch.keep(work.mapInArrow(lean(_rest(need, threshold)), "a long, b long").distinct(), "more")
    scratch.drop(elements)
    out = members.select("doc_id", "rep").join(label.select(F.col("vertex").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    if not more.isEmpty():  # links between components join them
        above = components(more, scratch).select(F.col("vertex").alias("component"), F.col("component").alias("joined"))
        out = out.join(above, "component", "left").withColumn("component", F.coalesce("joined", "component"))
    class_id = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("rep", "doc_id").alias("copy_of"), F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"))
