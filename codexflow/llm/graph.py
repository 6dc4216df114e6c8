"""Connected components by randomised contraction.

In each round every vertex joins the neighbour (or itself) with the smallest
value of a hash that changes by round; edges between joined vertices vanish.  On
any graph the number of vertices shrinks by a constant factor a round, so long
chains take few rounds too.  The rounds' mappings are written tables, and the
labels are put together from the last to the first.  Nothing but counts comes to
the driver; minima are formed with partial sums, and the joins are plain ones that
Spark can split where a vertex has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(vertex, component) for every vertex that has an edge; the component is its smallest vertex."""
    current = scratch.keep(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct(), "edges")
    maps: list[DataFrame] = []
    for no in range(rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        key = lambda c: F.struct(F.xxhash64(F.lit(no), c).alias("h"), F.col(c).alias("v"))
        chosen = both.groupBy("a").agg(F.min(key("b")).alias("m")).select(F.col("a").alias("old"), F.least(F.col("m"), key("a"))["v"].alias("new"))
        chosen = scratch.keep(chosen, f"map{no}")
        maps.append(chosen)
        left = chosen.select(F.col("old").alias("a"), F.col("new").alias("x"))
        right = chosen.select(F.col("old").alias("b"), F.col("new").alias("y"))
        joined = current.join(left, "a").join(right, "b").where("x != y")
        following = scratch.keep(joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"edges{no}")
        scratch.drop(current)
        current = following
        if current.isEmpty():
            break
    else:
        raise RuntimeError(f"the graph is not contracted after {rounds} rounds")
    label = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = label.select(F.col("old").alias("new"), F.col("new").alias("last"))
        label = earlier.join(later, "new", "left").select("old", F.coalesce("last", "new").alias("new"))
    smallest = label.groupBy("new").agg(F.min("old").alias("component"))
    out = label.join(smallest, "new").select(F.col("old").alias("vertex"), "component")
    return scratch.keep(out, "components")


def hot_keys(counts: DataFrame, key: str = "key", n: str = "n", least: int = 64, most: int = 256) -> list[int]:
    """Keys that hold more than 1 / ``most`` of all rows (so at most ``most`` keys), of a table of keys and their numbers of rows."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(n) > max(least, total // most)).select(key).limit(most).collect()]


def join_hot(many: DataFrame, one: DataFrame, hot: list[int], key: str = "key", of: str = "rep", salts: int = 64) -> DataFrame:
    """Join ``many`` rows of a key with the ``one`` row that it has, with the rows of hot keys dealt to several tasks."""
    is_hot, none = F.col(key).isin(hot), F.lit(0)
    left = many.withColumn("salt_", F.when(is_hot, F.pmod(F.xxhash64(of), F.lit(salts)).cast("int")).otherwise(none))
    right = one.withColumn("salt_", F.explode(F.when(is_hot, F.sequence(none, F.lit(salts - 1))).otherwise(F.array(none))))
    return left.join(right, [key, "salt_"]).drop("salt_")
