"""Small tables with every kind of row that operators must stand."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    words = ["alder", "birch", "cedar", "dune", "ember", "fjord", "grove", "heath", "inlet", "jetty", "knoll", "ledge", "marsh", "notch", "oasis", "plain"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ly", "ing"]) for _ in range(n))


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, equal texts, an extra column."""
    rng = random.Random(1)
    long = sentence(rng, 30_000)
    rows = [
        (0, "", "en", "b", 0), (1, None, "en", "a", None), (2, "   \n ", None, None, 3), (3, long, "en", "a", len(long)), (4, "One word", "de", "b", 8),
        (5, sentence(rng, 200), "en", None, 1), (5, sentence(rng, 50), "en", "b", 1), (6, "dup text of a few words here", "en", "a", 1),
        (6, "dup text of a few words here", "en", "a", 1), (7, "dup text of a few words here", "fr", "c", 1), (None, "no id at all but some words", "en", "a", 1),
        (None, None, None, None, None), (8, "日本語 текст ελ", "xx", "a", 5), (9, "12345 !!! 678", "en", "a", 5),
    ]
    return spark.createDataFrame([(*r, "x") for r in rows], DOCUMENTS + ", size string")


def empty(spark, schema=DOCUMENTS):
    return spark.createDataFrame([], schema)
