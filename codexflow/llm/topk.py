"""Exact top-k by inner product: columnar branch and bound.

Candidates lie in blocks, a dimension after the other.  For a query the products
are summed up over a few dimensions at a time; a candidate whose sum so far, with
the most that the remaining dimensions can add (the product of the remaining
lengths), is below the k-th best score known, is dropped, and the survivors are moved
together.  Queries come in blocks too; each meets every block of candidates by a join
on the number of a group of blocks.  A block of queries first meets one group: its
k-th best scores there go along as bounds to all other groups, which give only the
candidates that reach them.  The best of all these are the answer.

Components become floor(scale * x).  Sums are exact: in doubles while all partial
sums are below 2**53, else in 64-bit integers, which holds while scores fit them.

Rows
    Vectors that are null or hold null or non-finite components take no part.
    Shorter vectors count as if zeros followed.  Rows with the query's id are no
    candidates for it.  Ties go to the smaller id.  A repeated query row has answers
    of its own.  Null ids take no part.  Very long vectors are read whole.  Empty tables
    give no rows.  Further columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .storage import Scratch, quoted
from .vectors import matrix, widest

BLOCKS = "block long, n int, ids binary, data binary, big boolean"


def _blocks(rows: DataFrame, dim: int, size: int, scale: float) -> DataFrame:
    def build(batches):
        from pyspark import TaskContext

        pid, no = TaskContext.get().partitionId(), 0
        held_ids, held, count = [], [], 0

        def flush():
            nonlocal no, held_ids, held, count
            data = np.concatenate(held).T  # one dimension after the other
            big = bool(len(data) and np.abs(data).max() >= 2.0**31)
            row = [[(pid << 32) + no], [count], [np.concatenate(held_ids).tobytes()], [np.ascontiguousarray(data).astype("<i8" if big else "<i4").tobytes()], [big]]
            no, held_ids, held, count = no + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()), strict=True)], ["block", "n", "ids", "data", "big"])

        for batch in batches:
            there, data = matrix(batch.column(1), dim)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[there].astype("<i8")
            data = np.floor(data * scale)
            for at in range(0, len(ids), size):
                part = ids[at : at + size]
                if count and count + len(part) > size:
                    yield flush()
                held_ids.append(part)
                held.append(data[at : at + size])
                count += len(part)
        if count:
            yield flush()

    return rows.mapInArrow(build, BLOCKS)


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int, bounds: list | None = None, step: int = 8):
    """For each query (rows of ``queries``): indexes of its k best in the block (dimensions by rows), with scores.
    Those below a query's bound, if it has one, may be left out."""
    dim, n = block.shape
    cuts = list(range(0, dim, step)) + [dim]
    mass = np.zeros((len(cuts), n))
    for c in range(len(cuts) - 2, -1, -1):
        part = block[cuts[c] : cuts[c + 1]].astype(float)
        mass[c] = mass[c + 1] + (part * part).sum(axis=0)
    left = np.sqrt(mass)
    for q, own, bound in zip(queries, query_ids, bounds or [None] * len(queries), strict=True):
        qf = q.astype(float)
        rest = np.sqrt(np.array([(qf[c:] ** 2).sum() for c in cuts]))
        at = np.flatnonzero(ids != own)
        total = q[: cuts[1]] @ block[: cuts[1]][:, at] if len(cuts) > 1 else np.zeros(len(at), block.dtype)
        least = bound
        if len(at) > 4 * k:
            # full scores of those that look best give a first k-th best
            likely = total + rest[1] * left[1][at]
            seeds = at[np.argpartition(-likely, 4 * k)[: 4 * k]]
            seen = np.partition(q @ block[:, seeds], -k)[-k]
            least = seen if least is None else max(least, seen)
        for c in range(1, len(cuts) - 1):
            if least is not None:
                most = total + rest[c] * left[c][at] * (1 + 1e-9) + 1
                alive = most >= least
                if not alive.all():
                    at, total = at[alive], total[alive]
            total = total + q[cuts[c] : cuts[c + 1]] @ block[cuts[c] : cuts[c + 1]][:, at]
        if bound is not None:
            at, total = at[total >= bound], total[total >= bound]
        if len(at) > k:
            floor = np.partition(total, -k)[-k]
            alive = total >= floor
            at, total = at[alive], total[alive]
        order = np.lexsort((ids[at], -total))[:k]
        yield at[order], total[order]


def search(vectors: DataFrame, query: Column, scratch: Scratch, k: int = 10, scale: float = 1024.0, id_column: str = "vec_id", column: str = "embedding", block_rows: int = 4096, query_rows: int = 256, most_groups: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for every row where ``query`` holds."""
    dim = widest(vectors, column)
    rows = vectors.select(F.col(quoted(id_column)).cast("long").alias("id"), F.col(quoted(column)).alias("v"), query.alias("is_query")).where("id is not null")
    candidates = scratch.keep(_blocks(rows.select("id", "v"), dim, block_rows, scale), "blocks")
    blocks = candidates.count()
    groups = min(max(64, blocks // 4), most_groups)
    candidates = candidates.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    used = sorted(r["g"] for r in candidates.select("g").distinct().collect())  # at most most_groups numbers
    asked = _blocks(rows.where("is_query").select("id", "v"), dim, query_rows, scale)
    asked = scratch.keep(asked.select(*[F.col(c).alias("q_" + c) for c in asked.columns]), "queries")
    if not used:
        used = [0]
    everywhere = F.array(*map(F.lit, used))
    asked = asked.withColumn("first", F.element_at(everywhere, F.pmod(F.xxhash64("q_block"), F.lit(len(used))).cast("int") + 1))

    def unpack(row, prefix):
        ids = np.frombuffer(row[prefix + "ids"], "<i8")
        return ids, np.frombuffer(row[prefix + "data"], "<i8" if row[prefix + "big"] else "<i4").reshape(dim, len(ids))

    def find(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n].as_py() for name in batch.schema.names}
                ids, block = unpack(row, "")
                qids, asked = unpack(row, "q_")
                most = [int(np.abs(x).max()) if x.size else 0 for x in (block, asked)]
                kind = float if most[0] * most[1] * max(dim, 1) < 1 << 53 else np.int64
                block, asked = block.astype(kind), np.ascontiguousarray(asked.T).astype(kind)
                bounds = [None] * len(qids)
                for b in row["bounds"] or ():
                    bounds[b["no"]] = b["score"]
                out = [[], [], [], [], []]
                for no, (at, score) in enumerate(best_of_block(asked, qids, block, ids, k, bounds)):
                    for column_, values in zip(out, (np.full(len(at), qids[no]), np.full(len(at), row["q_block"]), np.full(len(at), no), ids[at], score), strict=True):
                        column_.append(values.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "q_block", "no", "vec_id", "score"])

    found = "query_id long, q_block long, no long, vec_id long, score long"
    order = W.partitionBy("q_block", "no").orderBy(F.col("score").desc(), "vec_id")
    none = F.lit(None).cast("array<struct<no:long,score:long>>").alias("bounds")
    seeds = candidates.join(asked.withColumn("g", F.col("first")), "g").select("*", none).mapInArrow(find, found)
    seeds = scratch.keep(seeds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "seeds")
    # a list of at most query_rows bounds for each block of queries
    bounds = seeds.where(F.col("rank") == k).groupBy("q_block").agg(F.collect_list(F.struct("no", "score")).alias("bounds"))
    further = asked.join(bounds, "q_block", "left").withColumn("g", F.explode(F.filter(everywhere, lambda g: g != F.col("first"))))
    others = candidates.join(further, "g").mapInArrow(find, found)
    every = seeds.drop("rank").unionByName(others)
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
