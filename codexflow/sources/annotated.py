"""Annotated books: tab-separated exports read into a star schema.

A book is a folder with ``<book>.tokens`` and ``<book>.entities`` and, if there,
``.quotes``, ``.supersense``, ``.book`` and ``.txt``.  A row's place in its file is its
address, so files are read whole and cut into lines with their number: Spark's line
readers keep no order.  Columns are found by the header's names."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

TOKEN_COLUMNS = ("paragraph_ID", "sentence_ID", "token_ID_within_document", "word", "lemma", "POS_tag", "dependency_relation", "syntactic_head_ID")
ENTITY_COLUMNS = ("COREF", "start_token", "end_token", "prop", "cat", "text")
QUOTE_COLUMNS = ("quote_start", "quote_end")
# Tags that are no words, and the marks of quotations.
NO_WORD_POS = ("PUNCT", "SPACE", "SYM")
NO_RATE_POS = ("PUNCT", "SPACE", "SYM", "X")
QUOTE_MARKS = ('"', "'", "``", "''", "“", "”", "‘", "’", "«", "»")


class SourceError(ValueError):
    pass


def discover(spark: SparkSession, folder: str, pins: dict[str, str] | None = None) -> DataFrame:
    """book and folder of every book, the newest of several exports (or the pinned one).  The stamp
    at the end of a folder's name counts, else the file's time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.select(F.regexp_replace("path", "/+$", "").alias("path"), "modificationTime")
    parts = files.select(
        F.regexp_extract("path", r"^(.*)/([^/]+)\.(tokens|entities)$", 1).alias("dir"), F.regexp_extract("path", r"([^/]+)\.(tokens|entities)$", 1).alias("book"),
        F.regexp_extract("path", r"\.(tokens|entities)$", 1).alias("kind"), "modificationTime",
    ).where("kind != ''")
    both = parts.groupBy("dir", "book").agg(F.countDistinct("kind").alias("kinds"), F.max("modificationTime").alias("changed")).where("kinds = 2")
    stamp = F.coalesce(F.nullif(F.regexp_extract("dir", r"-(\d{8}-\d{6})$", 1), F.lit("")), F.date_format("changed", "yyyyMMdd-HHmmss"))
    wanted = F.lit(False)
    for book, place in (pins or {}).items():
        wanted = wanted | ((F.col("book") == book) & F.col("dir").endswith(place))
    order = W.partitionBy("book").orderBy(wanted.desc(), F.col("stamp").desc(), "dir")
    return both.withColumn("stamp", stamp).withColumn("k", F.row_number().over(order)).where("k = 1").select("book", "dir", "stamp")


def _lines(spark: SparkSession, books: list[tuple[str, str]], kind: str) -> DataFrame:
    """book, line (from 0, blank lines not counted) and its fields."""
    paths = [f"{place}/{book}.{kind}" for book, place in books]
    files = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.\w+$", 1).alias("book"), "value")
    files = files.withColumn("value", F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit(f"not UTF-8: .{kind} of "), "book"))))
    lines = F.filter(F.split(F.regexp_replace("value", "^﻿", ""), r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    rows = files.select(F.url_decode("book").alias("book"), lines.alias("lines")).where(F.size("lines") > 0)
    head = F.transform(F.split(F.col("lines")[0], "\t"), lambda x: F.trim(x))
    return rows.select("book", head.alias("head"), F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line", "text")).select("book", "head", "line", F.split("text", "\t", -1).alias("f"))


def _field(name: str) -> Column:
    at = F.array_position("head", name).cast("int")
    return F.when((at > 0) & (at <= F.size("f")), F.get("f", at - 1))


def _number(name: str) -> Column:
    return F.trim(_field(name)).try_cast("long")


def _require(rows: DataFrame, names: tuple[str, ...], kind: str) -> DataFrame:
    missing = F.array_except(F.array(*map(F.lit, names)), F.col("head"))
    text = F.concat(F.lit(f".{kind} of "), "book", F.lit(" has no column "), F.array_join(missing, ", "))
    return rows.withColumn("line", F.when(F.size(missing) == 0, F.col("line")).otherwise(F.raise_error(text)))


@dataclass
class Corpus:
    """The relations of some books, built when they are first asked for."""

    spark: SparkSession
    books: list[tuple[str, str]]  # (book, folder)
    kinds: dict[str, list[tuple[str, str]]]  # the books that have a file of a kind

    def _rows(self, kind: str, names: tuple[str, ...]) -> DataFrame | None:
        books = self.kinds.get(kind)
        return _require(_lines(self.spark, books, kind), names, kind) if books else None

    @cached_property
    def token(self) -> DataFrame:
        """(book, i, para, sent, word, lemma, pos, tag, dep, head, event, onset, offset, isword)."""
        rows = self._rows("tokens", TOKEN_COLUMNS)
        hard = {}
        for name, short in (("paragraph_ID", "para"), ("sentence_ID", "sent")):
            text = F.concat(F.lit(".tokens of "), "book", F.lit(", line "), (F.col("line") + 2).cast("string"), F.lit(f": {name} is no number"))
            hard[short] = F.coalesce(_number(name), F.raise_error(text).cast("long"))
        n = F.count("*").over(W.partitionBy("book"))
        places = rows.withColumn("n", n)
        head = _number("syntactic_head_ID")
        fine = F.min(((_number("byte_onset").isNotNull()) & (_number("byte_offset").isNotNull())).cast("int")).over(W.partitionBy("book")) == 1
        word, pos = F.coalesce(_field("word"), F.lit("")), F.coalesce(_field("POS_tag"), F.lit(""))
        out = places.select(
            "book", F.col("line").cast("long").alias("i"), hard["para"].alias("para"), hard["sent"].alias("sent"), word.alias("word"),
            F.coalesce(_field("lemma"), F.lit("")).alias("lemma"), pos.alias("pos"), F.coalesce(_field("fine_POS_tag"), F.lit("")).alias("tag"), F.coalesce(_field("dependency_relation"), F.lit("")).alias("dep"),
            F.when(head.between(0, F.col("n") - 1), head).otherwise(F.col("line")).cast("long").alias("head"), F.coalesce(_field("event") == "EVENT", F.lit(False)).alias("event"),
            F.when(fine, _number("byte_onset")).otherwise(-1).alias("onset"), F.when(fine, _number("byte_offset")).otherwise(-1).alias("offset"),
        )
        return out.withColumn("isword", ~F.col("pos").isin(*NO_WORD_POS) & ~F.col("word").isin(*QUOTE_MARKS))

    @cached_property
    def sizes(self) -> DataFrame:
        """Tokens and words (for rates) of each book."""
        return self.token.groupBy("book").agg(F.count("*").alias("n_tokens"), F.sum((~F.col("pos").isin(*NO_RATE_POS)).cast("long")).alias("n_words"), F.countDistinct("sent").alias("n_sents"), F.countDistinct("para").alias("n_paras"))

    def spans(self, by: str) -> DataFrame:
        """First and last token of each sentence or paragraph."""
        return self.token.groupBy("book", by).agg(F.min("i").alias("s"), F.max("i").alias("e"))

    def _within(self, rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(self.sizes.select("book", "n_tokens")), "book")  # a row a book

    @cached_property
    def mention(self) -> DataFrame:
        """(book, mi, coref, start, end, prop, cat, text); rows with bad numbers or places are left out."""
        rows = self._rows("entities", ENTITY_COLUMNS)
        cat = F.element_at(F.split(F.coalesce(_field("cat"), F.lit("")), "_"), -1)
        rows = rows.select("book", "line", _number("COREF").alias("coref"), _number("start_token").alias("start"), _number("end_token").alias("end"), _field("prop").alias("prop"), cat.alias("cat"), _field("text").alias("text"))
        fine = self._within(rows).where("coref is not null and start >= 0 and end >= start and end < n_tokens").drop("n_tokens")
        return fine.withColumn("mi", F.row_number().over(W.partitionBy("book").orderBy("line")).cast("long") - 1).drop("line")

    @cached_property
    def quote(self) -> DataFrame:
        """(book, qi, start, end, mstart, mend, char, text)."""
        rows = self._rows("quotes", QUOTE_COLUMNS)
        schema = "book string, qi long, start long, end long, mstart long, mend long, char long, text string"
        if rows is None:
            return self.spark.createDataFrame([], schema)
        char = F.trim(_field("char_id"))
        rows = rows.select("book", "line", _number("quote_start").alias("start"), _number("quote_end").alias("end"), _number("mention_start").alias("mstart"), _number("mention_end").alias("mend"), F.when(~char.isin("", "None", "-1"), char.try_cast("long")).alias("char"), _field("quote").alias("text"))
        fine = self._within(rows).where("start >= 0 and end >= start and end < n_tokens").drop("n_tokens")
        return fine.withColumn("qi", F.row_number().over(W.partitionBy("book").orderBy("line")).cast("long") - 1).select("book", "qi", "start", "end", "mstart", "mend", "char", "text")

    @cached_property
    def supersense(self) -> DataFrame:
        """(book, i, ss): the first span in the file that covers a token."""
        rows = self._rows("supersense", ("start_token", "end_token", "supersense_category"))
        if rows is None:
            return self.spark.createDataFrame([], "book string, i long, ss string")
        rows = rows.select("book", "line", _number("start_token").alias("s"), _number("end_token").alias("e"), _field("supersense_category").alias("ss"))
        rows = self._within(rows).select("book", "line", F.greatest("s", F.lit(0)).alias("s"), F.least("e", F.col("n_tokens") - 1).alias("e"), "ss").where("s <= e")
        return rows.select("book", "line", "ss", F.explode(F.sequence("s", "e")).alias("i")).groupBy("book", "i").agg(F.min_by("ss", "line").alias("ss"))

    @cached_property
    def character(self) -> DataFrame:
        """(book, coref, name, pronouns) as the book's JSON has them; a damaged file has none."""
        books = self.kinds.get("book")
        if not books:
            return self.spark.createDataFrame([], "book string, coref long, name string, pronouns string")
        files = self.spark.read.text([f"{place}/{book}.book" for book, place in books], wholetext=True)
        schema = "characters array<struct<id: long, name: string, g: struct<argmax: string>>>"
        rows = files.select(F.url_decode(F.regexp_extract(F.input_file_name(), r"([^/]+)\.\w+$", 1)).alias("book"), F.explode(F.from_json("value", schema)["characters"]).alias("c"))
        return rows.select("book", F.col("c.id").alias("coref"), F.col("c.name").alias("name"), F.col("c.g.argmax").alias("pronouns"))


def load(spark: SparkSession, folder: str, books: list[str] | None = None, pins: dict[str, str] | None = None) -> Corpus:
    """The books of a folder (all, or those named)."""
    found = [(r["book"], r["dir"]) for r in discover(spark, folder, pins).collect() if books is None or r["book"] in books]  # a row a book
    if not found:
        raise SourceError(f"no books in {folder}")
    there = {tuple(r) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)$", 1)).collect()}
    kinds = {k: [(b, d) for b, d in sorted(found) if (d, f"{b}.{k}") in there] for k in ("tokens", "entities", "quotes", "supersense", "book", "txt")}
    return Corpus(spark, sorted(found), kinds)


def word_counts(text: DataFrame) -> DataFrame:
    """item and n of a reference: a frequency list (word and number in either order of a line, a rank
    before them allowed) if at least nine tenths of its lines look like one, else the words of a text."""
    lines = text.select(F.trim("value").alias("v")).where("v != ''")
    fields = F.split("v", r"[\t,; ]+")
    rows = lines.select("v", fields.alias("f"))
    n = F.element_at("f", -1).try_cast("long")
    swapped = F.when(F.size("f") == 3, F.element_at("f", 2).try_cast("long"))
    listed = rows.select("v", F.when((F.size("f") == 2) & n.isNotNull(), F.col("f")[0]).when(swapped.isNotNull(), F.col("f")[2]).alias("item"), F.when((F.size("f") == 2) & n.isNotNull(), n).when(swapped.isNotNull(), swapped).alias("n"))
    share = listed.agg(F.avg(F.col("item").isNotNull().cast("double"))).first()[0] or 0.0
    if share >= 0.9:
        return listed.where("item is not null").groupBy(F.lower("item").alias("item")).agg(F.sum("n").alias("n"))
    words = F.regexp_extract_all(F.lower("v"), F.lit(r"(?:(?!n't\b)[\p{L}\p{N}])+|n't\b|'(?:s|ll|re|ve|d|m)\b"), F.lit(0))
    return lines.select(F.explode(words).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def lexicon(text: DataFrame) -> DataFrame:
    """word and category of lines ``word category [flag]``; comments, and rows whose flag is not over 0, are left out."""
    rows = text.select(F.trim("value").alias("v")).where("v != '' and not startswith(v, '#')").select(F.split("v", r"[\t,;]|\s+").alias("f")).where("size(f) >= 2")
    flag = F.when(F.size("f") >= 3, F.get("f", F.lit(2)).try_cast("double"))
    return rows.where((F.size("f") < 3) | (flag > 0)).select(F.lower(F.col("f")[0]).alias("word"), F.lower(F.col("f")[1]).alias("category")).where("word != 'word'").distinct()
