"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed letter bigrams and trigrams (lower case, runs of
other characters as one space), with log counts times inverse document frequency,
normalised.  Each language is a few centroids found by spherical k-means, and the
language of the closest centroid by cosine is predicted.  A text is rejected if
its cosine is below what all but ``lowest`` of the training texts' passages of its
length reach, so a few odd texts among them do not set the threshold; of lengths with
too few passages for that the smallest cosine counts, times ``margin``.

Fitted on a bounded sample: at most ``per_language`` different texts of each
language, those of the smallest hash, whole.  Everything else reads every row.

Rows
    A null text, or one without a letter, is ``und`` with score 0 and rejected.
    Rows without a label or id are not learned from, and equal texts of a language
    count once, under whatever ids.  Null or repeated ids have predictions of their
    own.  Without any label all is ``und``.  An empty table gives no rows.  Long texts
    are read in slices, to their end.  Ties go to the first language.  Columns of any
    name are passed over; a carried one of the name ``lang_pred``, ``score`` or
    ``rejected`` is refused, and ``verdicts`` gives these as fields of one column of a
    name of the caller's instead.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .storage import Scratch, lean, quoted, unused

BITS = 13
SIZE = 1 << BITS
UNDETERMINED = "und"
_SLICE = 1 << 18
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams of the whole text; None if it has no letter."""
    if not text:
        return None
    is_letter, counts, tail, any_letter = letters(), np.zeros(SIZE, np.int64), np.array([32, 32], np.uint32), False
    for at in range(0, len(text), _SLICE):
        code = np.frombuffer(text[at : at + _SLICE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = is_letter[code]
        if not letter.any():
            if tail[1] != 32:
                tail = np.array([tail[1], 32], np.uint32)
            continue
        any_letter = True
        before = np.empty_like(letter)
        before[0], before[1:] = tail[1] != 32, letter[:-1]
        new = np.where(letter, code, np.uint32(32))[letter | before]
        seq = np.concatenate([tail, new])
        two = seq[1:-1] * np.uint32(2654435761) + seq[2:] * np.uint32(2246822519)
        three = seq[:-2] * np.uint32(3266489917) + two * np.uint32(668265263)
        for grams in (two, three):
            counts += np.bincount((grams ^ (grams >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(32 - BITS), minlength=SIZE)
        tail = seq[-2:]
    return counts if any_letter else None


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # float32, a row each
    idf: np.ndarray
    least: np.ndarray  # smallest cosine that is accepted, by log2 of the number of n-grams

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts).astype(np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, counts: list[np.ndarray | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each."""
        out = [(UNDETERMINED, 0.0, True)] * len(counts)
        there = [n for n, c in enumerate(counts) if c is not None]
        if not there or not self.languages:
            return out
        rows = np.stack([counts[n] for n in there])
        cosine = self.vectors(rows) @ self.centroids.T
        best = cosine.argmax(axis=1)
        size = np.minimum(np.log2(rows.sum(axis=1)).astype(int), len(self.least) - 1)
        for n, b, c, s in zip(there, best.tolist(), cosine.max(axis=1).tolist(), size.tolist(), strict=True):
            out[n] = (self.languages[b], min(max(c, 0.0), 1.0), c < self.least[s])
        return out


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by spherical k-means; the first are spread out, one far from the others after another."""
    chosen = [x.mean(axis=0)]
    chosen[0] = x[int((x @ chosen[0]).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(x[int(np.max(x @ np.stack(chosen).T, axis=1).argmin())])
    c = np.stack(chosen)
    for _ in range(rounds):
        mine = (x @ c.T).argmax(axis=1)
        c = np.stack([x[mine == j].sum(axis=0) if (mine == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def fit(documents: DataFrame, scratch: Scratch, train: Column | None = None, per_language: int = 300, clusters: int = 4, lowest: float = 0.005, margin: float = 0.8, max_model_bytes: int = 64 << 20) -> Model:
    """Learn from text and lang of the rows where ``train`` holds (by default those not held out)."""
    spark = documents.sparkSession
    train = ~held_out(F.col("doc_id")) if train is None else train
    labelled = documents.where(train & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    hashes = scratch.keep(labelled.select("lang", "h"), "hashes")
    languages = hashes.select("lang").distinct().limit(max_model_bytes // (clusters * SIZE * 4) + 1).count()
    if languages * clusters * SIZE * 4 > max_model_bytes:
        raise ValueError(f"a model of {languages} languages or more is over {max_model_bytes} bytes")
    # Different texts are ranked by their hash, of which only the smallest of each task travel on.
    # Before that a cut by the hash leaves little more than the sample, so that no task sorts a language's rows.
    few = per_language + 8 * int(np.sqrt(per_language)) + 16
    counted = hashes.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    cuts = counted.select(F.col("lang").alias("cut_lang"), F.when(F.col("n") <= 2 * few, F.lit(2**63 - 1)).otherwise((F.lit(-(2.0**63)) + F.lit(1.1 * few) / F.col("n") * 2.0**64).cast("long")).alias("cut_h"))
    likely = hashes.join(F.broadcast(cuts), (F.col("lang") == F.col("cut_lang")) & (F.col("h") <= F.col("cut_h"))).distinct()
    ranked = likely.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= per_language)
    chosen = scratch.keep(ranked.select(F.col("lang").alias("in_lang"), F.col("h").alias("in_h")), "chosen")  # at most languages * per_language rows
    if chosen.isEmpty():
        return Model([], np.zeros((0, SIZE), np.float32), np.ones(SIZE, np.float32), np.zeros(40))
    rows = labelled.join(F.broadcast(chosen), (F.col("lang") == F.col("in_lang")) & (F.col("h") == F.col("in_h")))
    sample = rows.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")

    def features(batches):
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.split()
                # besides the whole, passages of 1, 2, 4, ... words show what short texts reach
                passages = [text] + [" ".join(words[len(words) // 3 :][: 1 << n]) for n in range(len(words).bit_length())]
                for n, passage in enumerate(passages):
                    counts = gram_counts(passage)
                    if counts is not None:
                        at = np.flatnonzero(counts)
                        rows.append((lang, n == 0, at.astype(np.int32), counts[at].astype(np.int32)))
            for at in range(0, len(rows), 1000):
                part = list(zip(*rows[at : at + 1000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1]), pa.array(part[2], pa.list_(pa.int32())), pa.array(part[3], pa.list_(pa.int32()))], ["lang", "is_whole", "at", "n"])

    scratch.drop(hashes)
    table = scratch.keep(sample.mapInArrow(lean(features), "lang string, is_whole boolean, at array<int>, n array<int>"), "features")
    whole = table.where("is_whole")
    idf = np.ones(SIZE, np.float32)
    docs = whole.count()
    for r in whole.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # at most SIZE rows
        idf[r["at"]] = np.log((1 + docs) / (1 + r["count"])) + 1
    model = Model([], np.zeros((0, SIZE), np.float32), idf, np.zeros(40))

    def dense(table: pa.Table) -> np.ndarray:
        counts = np.zeros((len(table), SIZE), np.int64)
        for row, (at, n) in enumerate(zip(table.column("at"), table.column("n"), strict=True)):
            counts[row, at.values.to_numpy()] = n.values.to_numpy()
        return counts

    def centres(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(sorted(range(len(table)), key=lambda i: table.column("at")[i].as_py())))
        found = _kmeans(model.vectors(dense(table)), clusters)
        return pa.table({"lang": [table.column("lang")[0].as_py()] * len(found), "no": pa.array(range(len(found)), pa.int32()), "v": pa.array([c.tobytes() for c in found], pa.binary())})

    rows = whole.groupBy("lang").applyInArrow(centres, "lang string, no int, v binary").collect()
    if not rows:  # labelled texts without a letter
        return model
    rows.sort(key=lambda r: (r["lang"], r["no"]))
    model.languages = [r["lang"] for r in rows]
    model.centroids = np.stack([np.frombuffer(bytes(r["v"]), np.float32) for r in rows])

    def cosines(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                counts = dense(pa.Table.from_batches([batch.slice(at, 256)]))
                best = (model.vectors(counts) @ model.centroids.T).max(axis=1).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(np.log2(counts.sum(axis=1)).astype(np.int32)), pa.array(best)], ["size", "cosine"])

    spread = table.select("at", "n").repartition(spark.sparkContext.defaultParallelism)
    found = spread.mapInArrow(lean(cosines), "size int, cosine double").groupBy("size").agg(F.percentile("cosine", F.lit(lowest)).alias("low"), F.count("*").alias("n")).collect()
    # too few passages of a length do not tell what so few of them fall below: these get a margin
    low = {r["size"]: r["low"] * (1.0 if r["n"] * lowest >= 1 else margin) for r in found}
    least, above = np.zeros(40), np.inf
    for size in range(39, -1, -1):  # what a length asks for is never more than what a longer one does
        above = min(above, low.get(size, np.inf))
        least[size] = above
    longest = max((v for v in least if np.isfinite(v)), default=0.0)
    model.least = np.where(np.isfinite(least), least, longest)
    return model


def verdicts(documents: DataFrame, model: Model, carry: list[Column], name: str) -> DataFrame:
    """The ``carry`` columns, and a column ``name`` with fields lang_pred, score and rejected, for every row."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for batch in batches:
            texts, found = batch.column(1), []
            for at in range(0, len(texts), 64):
                found += sent.value.predict([gram_counts(t.as_py()) for t in texts[at : at + 64]])
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            said = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"])
            yield pa.RecordBatch.from_arrays([batch.column(0), said], ["row", "said"])

    # carried columns travel as one, whatever their names
    rows = documents.select(F.struct(*carry).alias("row"), F.col("text").cast("string").alias("text"))
    names = rows.schema["row"].dataType.names
    if len({n.lower() for n in [*names, name]}) <= len(names):
        raise ValueError(f"a carried column has the name {name}, or two have the same")
    out = rows.mapInArrow(lean(predict), T.StructType([rows.schema["row"], T.StructField("said", T.StructType.fromDDL("lang_pred string, score double, rejected boolean"))]))
    return out.select(*[F.col("row")[n].alias(n) for n in names], F.col("said").alias(name))


def identify(documents: DataFrame, model: Model, carry: list[Column] | None = None) -> DataFrame:
    """The ``carry`` columns with lang_pred, score and rejected for every row."""
    carry = [F.col("doc_id")] if carry is None else carry
    taken = {n.lower() for n in documents.select(*carry).columns} & {"lang_pred", "score", "rejected"}
    if taken:
        raise ValueError(f"carried columns are called {sorted(taken)}")
    name = unused("said", documents.select(*carry).columns)
    found = verdicts(documents, model, carry, name)
    return found.select(*[F.col(quoted(c)) for c in found.columns[:-1]], *[F.col(name)[c].alias(c) for c in ("lang_pred", "score", "rejected")])
