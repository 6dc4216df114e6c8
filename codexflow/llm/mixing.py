"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is made of blocks of ``block_words`` words; sources with a target of less
than eight blocks are apportioned by the word.  The others get whole numbers
of blocks by highest quotients (target over 1, 3, 5, ...), and each source's
blocks are dealt to its shards in the same way by the shards' words.  A shard
(about ``shard_docs`` documents) lays its documents end to end in a seeded order and
cuts the line into equal blocks; its quota is the whole shard as often as it goes in,
and for the rest a seeded choice of blocks.  The choice is of neighbours, a run from a
seeded block on, around the end if need be: the documents are already in a random
order, so a run is as fair a sample as scattered blocks, and nearly all documents are
taken whole, only the two at the ends of a run in part.  A quota over a block is met
to the word.

What comes to the driver is a row a source, of which more than ``max_sources`` are an
error, and a row for every ``group`` shards of a source, among which the source's quota
is dealt first; inside a group the executors deal it to the shards.

Rows
    A null text has size 0 and is taken 0 times.  A null source is a source of its
    own, the last.  Documents with the same id are told apart by nothing but their
    rows: each has its own share.  Ties between shards or sources go to the first.
    Very long texts count whole, and may be cut by a run like any other.  An empty table
    gives no rows.  ``mixed_documents`` carries all columns of the table, whatever their
    names; the other functions read three.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .storage import Scratch, quoted

# Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float, most: float = 2.0) -> list[float]:
    """Share the total by weight; a target stops at ``most`` times its size, and the
    excess goes to the others by weight until none is above."""
    open_, out = [n for n, size in enumerate(sizes) if size > 0], [0.0] * len(sizes)
    left = share * sum(sizes)
    while open_:
        unit = left / sum(weights[n] for n in open_)
        over = [n for n in open_ if weights[n] * unit > most * sizes[n]]
        if not over:
            for n in open_:
                out[n] = weights[n] * unit
            break
        for n in over:
            out[n] = float(most * sizes[n])
            left -= out[n]
        open_ = [n for n in open_ if n not in set(over)]
    return out


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients weight / (2 s + 1), none over its cap.

    The seats won before a common quotient q are floor((weight / q + 1) / 2); q is
    found by bisection and the last few seats are given one at a time, ties to the
    first.  No list of quotients is made, so the number of seats does not matter."""
    weights = np.asarray(weights, float)
    caps = np.where(weights > 0, np.asarray(caps, np.int64), 0)
    seats = min(int(seats), int(caps.sum()))
    if seats <= 0:
        return np.zeros(len(weights), np.int64)

    def won(q: float) -> np.ndarray:
        return np.minimum(np.floor((np.minimum(weights / q, 2.0**53) + 1) / 2).astype(np.int64), caps)

    high, low = 2 * weights.max() + 1, weights[weights > 0].min() / (2.0 * seats + 3)
    while won(low).sum() < seats:
        low /= 4
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if won(mid).sum() <= seats:
            high = mid
        else:
            low = mid
    out = won(high)
    while (missing := seats - int(out.sum())) > 0:
        quotient = np.where(out < caps, weights / (2 * out + 1), -1.0)
        best = np.argsort(-quotient, kind="stable")[:missing]
        out[best[quotient[best] > 0]] += 1
    return out


def deal(words: np.ndarray, quota: int, block_words: int) -> np.ndarray:
    """A quota of words dealt to parts of so many words, by the block, none over twice its words."""
    words = np.asarray(words, np.int64)
    given = sainte_lague(words, quota // block_words, 2 * words // block_words) * block_words
    # what does not fit in whole blocks goes to the parts' last words
    spare = 2 * words - given
    before = np.cumsum(spare) - spare
    return given + np.clip(quota - int(given.sum()) - before, 0, spare)


def source_quotas(sizes: list[int], goal: list[float], block_words: int) -> np.ndarray:
    """Words for each source: sources of a few blocks are apportioned by the word, the others by the block."""
    wanted, caps = np.array(goal), 2 * np.array(sizes, np.int64)
    small = wanted < 8 * block_words
    quota = sainte_lague(np.where(small, wanted, 0.0), round(float(wanted[small].sum())), caps)
    return quota + sainte_lague(np.where(small, 0.0, wanted), int(sum(goal) - quota.sum()) // block_words, caps // block_words) * block_words


def plan(documents: DataFrame, scratch: Scratch, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, seed: int = 17, block_words: int = 16, shard_docs: int = 1024, group: int = 4096, max_sources: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(sizes of all rows with their place in a shard, quotas of all shards)."""
    spark = documents.sparkSession
    sized = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.xxhash64("text")).alias("order_hash"),
    )
    sized = scratch.keep(sized, "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(max_sources + 1).collect()
    if len(sources) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sources.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [r["size"] for r in sources]
    goal = targets(sizes, [float(weights[n % len(weights)]) for n in range(len(sizes))], share)
    quota = source_quotas(sizes, goal, block_words)
    fields = "source string, source_no int, source_size long, target double, shards int"
    table = spark.createDataFrame([(r["source"], n, r["size"], goal[n], max(1, -(-r["docs"] // shard_docs))) for n, r in enumerate(sources)], fields)
    placed = sized.join(F.broadcast(table), sized["source"].eqNullSafe(table["source"])).select(  # at most max_sources rows
        "doc_id", sized["source"], "size", "order_hash", "source_no", "source_size", "target",
        F.pmod(F.xxhash64(F.col("order_hash"), F.lit(seed)), F.col("shards")).cast("int").alias("shard"),
    )
    part = F.floor(F.col("shard") / group).cast("int").alias("part")
    sums = scratch.keep(placed.where("size > 0").groupBy("source_no", "shard").agg(F.sum("size").alias("words")).select("source_no", part, "shard", "words"), "shards")
    by_source: dict[int, list] = {}
    for r in sums.groupBy("source_no", "part").agg(F.sum("words").alias("words")).orderBy("source_no", "part").collect():
        by_source.setdefault(r["source_no"], []).append(r)
    given = []
    for n, rows in by_source.items():
        given += [(n, r["part"], int(g)) for r, g in zip(rows, deal([r["words"] for r in rows], int(quota[n]), block_words), strict=True)]
    parts = spark.createDataFrame(given, "source_no int, part int, given long")

    def shards(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("shard")
        got = deal(rows.column("words").to_numpy(), rows.column("given")[0].as_py(), block_words)
        return pa.table([rows.column("source_no"), rows.column("shard"), rows.column("words"), pa.array(got, pa.int64())], ["source_no", "shard", "words", "quota"])

    quotas = sums.join(parts, ["source_no", "part"]).groupBy("source_no", "part").applyInArrow(shards, "source_no int, shard int, words long, quota long")
    return placed, scratch.keep(quotas, "quotas")


def runs(placed: DataFrame, quotas: DataFrame, seed: int = 17, block_words: int = 16) -> DataFrame:
    """For each row: its size, how often it is taken whole (``whole``) and the further
    words [from, to) that a run takes of it, in one or two parts."""
    lay = W.partitionBy("source_no", "shard").orderBy("order_hash", "doc_id", "size")
    quotas = quotas.select("source_no", "shard", "words", "quota")
    laid = placed.withColumn("end", F.sum("size").over(lay.rowsBetween(W.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("size"))
    joined = laid.join(quotas, ["source_no", "shard"], "left").na.fill({"words": 1, "quota": 0})
    whole = F.floor(F.col("quota") / F.col("words")).cast("long")
    rest = F.col("quota") - whole * F.col("words")
    # The run begins at a seeded block and goes on around the end of the shard.
    at = F.pmod(F.xxhash64(F.lit(seed), "source_no", "shard"), F.greatest(F.lit(1), F.floor(F.col("words") / block_words))) * block_words
    over = F.greatest(F.lit(0), at + rest - F.col("words"))
    cut = lambda lo, hi: F.struct(
        (F.greatest(F.col("begin"), lo) - F.col("begin")).alias("lo"), (F.least(F.col("end"), hi) - F.col("begin")).alias("hi")
    )
    parts = F.filter(F.array(cut(at, F.least(at + rest, F.col("words"))), cut(F.lit(0), over)), lambda p: p["hi"] > p["lo"])
    return joined.select("doc_id", "source", "size", "source_size", "target", "order_hash", F.when(F.col("size") > 0, whole).otherwise(0).alias("whole"), parts.alias("parts"))


def taken(documents: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row."""
    seed, block = options.get("seed", 17), options.get("block_words", 16)
    placed, quotas = plan(documents, scratch, **options)
    more = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["hi"] - p["lo"])
    return runs(placed, quotas, seed, block).select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + more).alias("taken"))


def mixed_documents(documents: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The mix itself: rows of ``documents``, as often as they are taken; those taken in
    part keep the words of the run and the white space between them."""
    seed, block = options.get("seed", 17), options.get("block_words", 16)
    placed, quotas = plan(documents, scratch, **options)
    picked = scratch.keep(runs(placed, quotas, seed, block).where("whole > 0 or size(parts) > 0").select("doc_id", "source", "order_hash", "whole", "parts"), "picked")
    columns = documents.columns
    # the rows travel as one column, so that their names cannot meet those of this function
    row = documents.select(F.struct(*[F.col(quoted(c)) for c in columns]).alias("row"), F.col("text").cast("string").alias("text"))
    plain = [F.col("row")[f.name] for f in documents.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    keyed = row.select("row", "text", F.col("row")["doc_id"].cast("long").alias("id"), F.col("row")["source"].cast("string").alias("of"), F.xxhash64(*plain).alias("whole_hash"))
    keyed = keyed.withColumn("hash", F.xxhash64(F.lit(seed), "id", F.xxhash64(F.col("row")["text"])))
    # equal rows of a source have shares of their own: they are numbered on both sides
    keyed = keyed.withColumn("no", F.row_number().over(W.partitionBy("id", "hash", "of").orderBy("whole_hash")))
    number = F.row_number().over(W.partitionBy("doc_id", "order_hash", "source").orderBy(F.col("whole").desc(), "parts"))
    picked = picked.select(F.col("source").alias("p_of"), number.alias("p_no"), F.col("doc_id").alias("p_id"), F.col("order_hash").alias("p_hash"), "whole", "parts")
    both = keyed.join(picked, F.col("id").eqNullSafe(F.col("p_id")) & (F.col("hash") == F.col("p_hash")) & F.col("of").eqNullSafe(F.col("p_of")) & (F.col("no") == F.col("p_no")))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    none = F.lit(None).cast("long")
    copies = F.concat(
        F.array_repeat(F.struct(none.alias("lo"), none.alias("hi")), F.col("whole").cast("int")),
        F.filter("parts", lambda p: p["hi"] > p["lo"]),
    )
    each = both.select("row", "text", F.explode(copies).alias("copy"))
    part = F.array_join(F.slice(words, F.col("copy.lo").cast("int") + 1, (F.col("copy.hi") - F.col("copy.lo")).cast("int")), "")
    each = each.withColumn("text", F.when(F.col("copy.lo").isNull(), F.col("text")).otherwise(F.rtrim(part)))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return each.select(*[new.get(c, F.col("row")[c]).alias(c) for c in columns])
