"""Linking the entities of different books.

Pairs are looked for in blocks of units that share a name token or a prefix of one; very
common tokens make no block.  Scores are column expressions; only the string similarity of
what the blocks leave is a Python function, on Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of a name that count only if nothing else is left.
TITLES = (
    "mr", "mrs", "ms", "miss", "dr", "doctor", "sir", "lady", "lord", "father", "mother", "brother", "sister",
    "inspector", "captain", "colonel", "major", "general", "professor", "prof", "rev", "reverend", "st", "saint",
    "monsieur", "madame", "mademoiselle", "herr", "frau", "signor", "don", "dona", "king", "queen", "prince",
    "princess", "count", "countess", "duke", "duchess", "baron", "baroness", "the", "a", "an", "old", "young", "little",
)


def name_tokens(name: Column) -> Column:
    """Lower-case words of a name, without a possessive s, titles aside (unless nothing else is there)."""
    every = F.regexp_extract_all(F.regexp_replace(F.lower(name), r"[’']s\b", ""), F.lit(r"[a-zà-ÿ0-9]+"), F.lit(0))
    plain = F.filter(every, lambda t: ~t.isin(*TITLES))
    return F.when(F.size(plain) > 0, plain).otherwise(every)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def suggest(units: DataFrame, block_limit: int = 400, limit: int = 300) -> DataFrame:
    """Pairs of units (unit, book, series, type, name, pronouns, mentions) that may be one entity: of one
    type and series, of different books.  The same name scores 1, or .85 if it is one word; the same last
    word of persons .6; a spelling that is similar by .85 or more .7 times that; a shared word of more than three
    letters .35.  Equal pronouns of persons add .05, different ones take .4; what is not over .2 is left
    out, and 1 is the most."""
    rows = units.where("series is not null").withColumn("t", name_tokens(F.col("name"))).where(F.size("t") > 0)
    long = F.filter("t", lambda x: F.length(x) > 2)
    keys = F.array_distinct(F.concat(long, F.transform(long, lambda x: F.concat(F.substring(x, 1, 3), F.lit("*")))))
    blocked = rows.select("unit", "type", "series", F.explode(keys).alias("key"))
    small = blocked.groupBy("type", "series", "key").agg(F.count("*").alias("n")).where(f"n between 2 and {block_limit}").drop("n")
    held = blocked.join(small, ["type", "series", "key"])
    pairs = held.select("type", "series", "key", F.col("unit").alias("a")).join(held.select("type", "series", "key", F.col("unit").alias("b")), ["type", "series", "key"]).where("a < b").select("a", "b").distinct()
    side = lambda x: rows.select(F.col("unit").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("book", "type", "name", "pronouns", "mentions", "t")])
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("book_a != book_b")
    joined = lambda x: F.array_join(f"t_{x}", " ")
    both = both.withColumn("ratio", similarity(joined("a"), joined("b")))
    person = F.col("type_a") == "PER"
    shared = F.exists(F.array_intersect("t_a", "t_b"), lambda x: F.length(x) > 3)
    score = (
        F.when(joined("a") == joined("b"), F.when(F.size("t_a") > 1, 1.0).otherwise(0.85))
        .when(person & (F.element_at("t_a", -1) == F.element_at("t_b", -1)), 0.6)
        .when(F.col("ratio") >= 0.85, 0.7 * F.col("ratio")).when(shared, 0.35)
    )
    told = person & F.col("pronouns_a").isNotNull() & F.col("pronouns_b").isNotNull()
    pron = F.when(told, F.when(F.col("pronouns_a") == F.col("pronouns_b"), 0.05).otherwise(-0.4)).otherwise(0.0)
    scored = both.withColumn("score", F.bround(F.least(F.lit(1.0), score + pron), 2)).where(score + pron > 0.2)
    scored = scored.withColumn("mentions", F.col("mentions_a") + F.col("mentions_b"))
    return scored.select("a", "b", "name_a", "name_b", "score", "mentions").orderBy(F.col("score").desc(), F.col("mentions").desc(), "a", "b").limit(limit)


def same_names(units: DataFrame) -> DataFrame:
    """Units of different books with the same name, type and pronouns, as one list each."""
    key = F.array_join(name_tokens(F.col("name")), " ")
    found = units.groupBy(key.alias("key"), "type", "pronouns").agg(F.sort_array(F.collect_set("unit")).alias("units"), F.countDistinct("book").alias("books"))
    return found.where("books > 1 and key != ''")
