"""Generic relations out of plain tables.

``words`` keeps a document's words as one array, in order: most operators work inside
the row and need no shuffle before their first aggregation.  ``tokens`` has a row for
each word or mark, with its place and sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def word_array(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def token_array(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, where an input of a single file would keep them in fewer tasks.  Inputs of
    many files, as large ones are, stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def words(documents: DataFrame, *carry: str) -> DataFrame:
    """book, the carried columns, and ws, the words of the text."""
    return documents.select(F.col("doc_id").alias("book"), *carry, word_array(F.col("text")).alias("ws"))


def stream(words_: DataFrame, *carry: str) -> DataFrame:
    """A row for each word: book, i (from 0) and word."""
    return words_.select("book", *carry, F.posexplode("ws").alias("i", "word"))


def sentences(documents: DataFrame, *carry: str) -> DataFrame:
    """A row for each sentence (up to ``.``, ``!`` or ``?``): book, sent, ws and its closing mark.

    The text is cut after its closing marks first, so each part is tokenised once."""
    parts = F.filter(F.split(F.lower("text"), r"(?<=[.!?])"), lambda p: p.rlike(r"\S"))
    rows = documents.select(F.col("doc_id").alias("book"), *carry, F.posexplode(parts).alias("sent", "part"))
    mark = F.substring("part", -1, 1)
    return rows.select("book", *carry, "sent", word_array(F.col("part")).alias("ws"), F.when(mark.isin(".", "!", "?"), mark).alias("mark"))


def bases(sizes: DataFrame, key: str = "book", size: str = "n", buckets: int = 1024) -> DataFrame:
    """The sum of sizes before each key.  Keys are put into ranges first (of equal width, or
    by the first letters of names), so that a window over all rows is only one over the ranges' sums."""
    ends = sizes.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if ends["lo"] is None:
        return sizes.select(key, F.lit(0).cast("long").alias("base"))
    from pyspark.sql.window import Window as W

    if isinstance(ends["lo"], str):
        part = F.substring(key, 1, 3)
    else:
        part = F.floor((F.col(key) - ends["lo"]) / max(1, -(-(ends["hi"] - ends["lo"] + 1) // buckets)))
    ranged = sizes.select(key, size, part.alias("range"))
    sums = ranged.groupBy("range").agg(F.sum(size).alias("n_range"))
    before = sums.select("range", F.coalesce(F.sum("n_range").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum(size).over(W.partitionBy("range").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("inside", inside).join(F.broadcast(before), "range").select(key, (F.col("before") + F.col("inside")).cast("long").alias("base"))
