"""Conversations, addressees and the style of speech.

A quote relation has book, ord (its place in the book), speaker, text, and where it is
wanted start and end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.relations import word_array


def sessions(events: DataFrame, gap: Column, entity: str = "entity", at: str = "at") -> DataFrame:
    """Number runs of an entity's events: a new one begins when more than ``gap`` lies between.
    ``gap`` compares with the difference to the event before, which is the column ``since``."""
    order = W.partitionBy(entity).orderBy(at)
    rows = events.withColumn("since", F.col(at) - F.lag(at).over(order))
    return rows.withColumn("session", F.sum(F.coalesce((F.col("since") > gap).cast("int"), F.lit(0))).over(order)).drop("since")


def addressees(quotes: DataFrame) -> DataFrame:
    """Estimate whom each quote addresses: the speaker before if that is another (reply); within a
    run of quotes of one speaker what the run's first quote had (continues); and at the start of
    a conversation the next other speaker (next)."""
    order = W.partitionBy("book").orderBy("ord")
    rows = quotes.withColumn("before", F.lag("speaker").over(order))
    new = F.coalesce(F.col("speaker") != F.col("before"), F.lit(True))
    rows = rows.withColumn("new", new).withColumn("run", F.sum(new.cast("int")).over(order))
    # the speaker of the run after this one, known from its first row on
    starts = rows.where("new").select("book", (F.col("run") - 1).alias("run"), F.col("speaker").alias("following"))
    rows = rows.join(starts, ["book", "run"], "left")
    opener = F.when(F.col("run") == 1, F.col("following"))
    reply = F.when(F.col("run") > 1, F.last(F.when(F.col("new"), F.col("before")), ignorenulls=True).over(W.partitionBy("book", "run").orderBy("ord")))
    addressee = F.when(F.col("speaker").isNotNull(), F.coalesce(reply, opener))
    method = F.when(addressee.isNull(), F.lit(None)).when(~F.col("new"), "continues").when(F.col("run") > 1, "reply").otherwise("next")
    return rows.withColumn("addressee", addressee).withColumn("method", method).drop("before", "new", "run", "following")


def addressee_edges(addressed: DataFrame, methods: tuple[str, ...] = ("reply", "continues", "next")) -> DataFrame:
    return addressed.where(F.col("method").isin(*methods)).groupBy("speaker", "addressee").agg(F.count("*").alias("quotes"))


def sentence_type(text: Column) -> Column:
    return F.when(F.instr(text, "?") > 0, "question").when(F.instr(text, "!") > 0, "exclaim").otherwise("statement")


def style_of_speech(quotes: DataFrame, by: str = "speaker") -> DataFrame:
    """Quotes, words, mean and median length, shares of questions and exclamations, first and second
    persons per thousand words, and mean word length."""
    rows = quotes.select(by, "text", word_array(F.col("text")).alias("ws"))
    per1k = lambda c: 1000.0 * F.sum(c) / F.sum(F.size("ws"))
    of = lambda *forms: F.size(F.filter("ws", lambda w: w.isin(*forms)))
    letters = F.aggregate("ws", F.lit(0), lambda a, w: a + F.length(w))
    share = lambda kind: 100.0 * F.avg((sentence_type(F.col("text")) == kind).cast("double"))
    return rows.groupBy(by).agg(
        F.count("*").alias("quotes"), F.sum(F.size("ws")).cast("long").alias("words"), F.avg(F.size("ws")).alias("mean_words"), F.median(F.size("ws")).alias("median_words"),
        share("question").alias("questions"), share("exclaim").alias("exclaims"),
        per1k(of("i", "me", "my")).alias("first_per1k"), per1k(of("you", "your")).alias("second_per1k"), per1k(of("we", "us", "our")).alias("plural_per1k"),
        (F.sum(letters) / F.sum(F.size("ws"))).alias("word_len"),
    )


def curve(spans: DataFrame, bins: int = 50) -> DataFrame:
    """Share of each part of a book that lies in speech.  ``spans`` has book, n (words) and speech."""
    end = F.sum("n").over(W.partitionBy("book").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("n").over(W.partitionBy("book"))
    rows = spans.withColumn("end", end).withColumn("total", total).where("n > 0")
    rows = rows.select("book", "speech", "total", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("i"))
    rows = rows.select("book", "speech", F.least(F.lit(bins - 1), F.floor(bins * F.col("i") / F.col("total"))).cast("int").alias("bin"))
    return rows.groupBy("book", "bin").agg(F.count("*").alias("words"), (100.0 * F.avg(F.col("speech").cast("double"))).alias("speech_pct"))


def runs(votes: DataFrame, max_gap: int = 1) -> DataFrame:
    """Runs of paragraphs that vote for the same unit, with at most ``max_gap`` silent ones between:
    book, unit, first and last paragraph, votes.  ``votes`` has book, para and unit (null: silent)."""
    order = W.partitionBy("book").orderBy("para")
    dense = votes.withColumn("x", F.row_number().over(order)).where(F.col("unit").isNotNull())
    new = F.coalesce((F.col("unit") != F.lag("unit").over(order)) | (F.col("x") - F.lag("x").over(order) - 1 > max_gap), F.lit(True))
    rows = dense.withColumn("run", F.sum(new.cast("int")).over(order))
    return rows.groupBy("book", "run", "unit").agg(F.min("para").alias("first"), F.max("para").alias("last"), F.count("*").alias("votes")).drop("run")
