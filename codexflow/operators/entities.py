"""Units, their presence and company, and comparisons between groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def presence_bins(rows: DataFrame, at: Column, length: Column, bins: int = 100, entity: str = "entity") -> DataFrame:
    """How often each entity occurs in each hundredth."""
    return rows.groupBy(entity, F.least(F.lit(bins - 1), F.floor(bins * at / length)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def top_value(rows: DataFrame, by: list[str], value: str, first: str) -> DataFrame:
    """The most frequent value of each group; ties go to the one seen first."""
    found = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(first).alias("first"))
    best = F.max_by(F.struct(value, "n"), F.struct("n", (-F.col("first")).alias("f")))
    return found.groupBy(*by).agg(best.alias("best"), F.sum("n").alias("total")).select(*by, f"best.{value}", F.col("best.n").alias("n"), "total")


def units(mentions: DataFrame, least: int, per_book: bool = False) -> DataFrame:
    """Units with enough mentions: in all books together, or counting only books with enough."""
    counts = mentions.groupBy("unit", "book").agg(F.count("*").alias("n"))
    if per_book:
        counts = counts.where(F.col("n") >= least)
    out = counts.groupBy("unit").agg(F.sum("n").alias("mentions"), F.count("*").alias("books"))
    return out if per_book else out.where(F.col("mentions") >= least)


def by_part(rows: DataFrame, item: str, part: str, top: int = 400) -> DataFrame:
    """Counts and shares of the most frequent items in each part."""
    cells = rows.groupBy(item, part).agg(F.count("*").alias("n"))
    best = cells.groupBy(item).agg(F.sum("n").alias("total")).orderBy(F.col("total").desc(), item).limit(top)
    sums = cells.groupBy(part).agg(F.sum("n").alias("part_total"))
    return cells.join(best, item).join(F.broadcast(sums), part).select(item, part, "n", "total", (100.0 * F.col("n") / F.col("part_total")).alias("pct"))


def grouping_totals(rows: DataFrame, kind: str, book: str) -> DataFrame:
    """Mentions by type, and by type and book, in one pass (the book is null in the former)."""
    return rows.groupingSets([[F.col(kind)], [F.col(kind), F.col(book)]], F.col(kind), F.col(book)).agg(F.count("*").alias("n"))


def as_of(points: DataFrame, starts: DataFrame, by: str, at: str, start: str, value: str) -> DataFrame:
    """Give each point the value of the last start at or before it.  Both sides are put in one order
    by key, so no point meets more than its own past."""
    a = points.withColumn("_at", F.col(at)).withColumn("_kind", F.lit(1))
    b = starts.select(by, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.col(value).alias("_value"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = W.partitionBy(by).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(order)).where("_kind = 1").drop("_at", "_kind", "_value")
