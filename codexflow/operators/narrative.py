"""Segments, arcs, style and stylometry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.relations import stream


def slices(words: DataFrame, n: int = 10) -> DataFrame:
    """Equal slices of each book: seg, its first word and the word after its last.  Slices of books
    shorter than n words may be empty."""
    n = min(200, max(2, n))
    size = F.size("ws").cast("long")
    rows = words.select("book", size.alias("total"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("seg"))
    return rows.select("book", "seg", F.floor(F.col("seg") * F.col("total") / n).alias("start"), F.floor((F.col("seg") + 1) * F.col("total") / n).alias("end"))


def proportional(words: DataFrame, n: int = 40) -> DataFrame:
    """How many of n slices each book gets by its share of all words, half to even, at least one."""
    n = min(400, max(2, n))
    sizes = words.select("book", F.size("ws").cast("long").alias("words"))
    total = sizes.agg(F.sum("words")).first()[0] or 1
    return sizes.select("book", "words", F.greatest(F.lit(1), F.bround(F.col("words") * float(n) / total)).cast("long").alias("slices"))


def segment_of(i: Column, total: Column, n: int) -> Column:
    """The slice a word lies in, as ``slices`` cuts them."""
    return F.floor((n * (i + 1) - 1) / total)


def lexicon_arc(words: DataFrame, lexicon: DataFrame, n: int = 10) -> DataFrame:
    """Words of each category per thousand words, by slice.  ``lexicon`` (word, category) is a word
    list; Spark broadcasts it if it is small."""
    rows = stream(words.withColumn("total", F.size("ws").cast("long")), "total")
    rows = rows.select("book", "word", segment_of(F.col("i"), F.col("total"), n).cast("int").alias("seg"))
    sizes = rows.groupBy("book", "seg").agg(F.count("*").alias("words"))
    hits = rows.join(lexicon, "word").groupBy("book", "seg", "category").agg(F.count("*").alias("hits"))
    return hits.join(sizes, ["book", "seg"]).select("book", "seg", "category", "hits", "words", (F.col("hits") * 1000.0 / F.col("words")).alias("per1k"))


def sentiment_arc(sentences: DataFrame, valence: DataFrame, n: int = 10, strong: float = 0.05) -> DataFrame:
    """Mean sentence score by slice of sentences.  A sentence's score is the sum s of its words'
    valences as s / sqrt(s * s + 15); shares count scores of at least ``strong`` either way."""
    rows = sentences.select("book", "sent", F.explode("ws").alias("word")).join(valence, "word").groupBy("book", "sent").agg(F.sum("valence").alias("s"))
    last = sentences.groupBy("book").agg((F.max("sent") + 1).cast("long").alias("total"))
    scored = sentences.select("book", "sent").join(rows, ["book", "sent"], "left").join(last, "book")
    score = F.coalesce(F.col("s") / F.sqrt(F.col("s") * F.col("s") + 15), F.lit(0.0))
    scored = scored.select("book", segment_of(F.col("sent"), F.col("total"), n).cast("int").alias("seg"), score.alias("score"))
    return scored.groupBy("book", "seg").agg(
        F.count("*").alias("sentences"), F.avg("score").alias("mean"),
        F.avg((F.col("score") >= strong).cast("double")).alias("positive"), F.avg((F.col("score") <= -strong).cast("double")).alias("negative"),
    )


def syllables(word: Column) -> Column:
    """Groups of vowel letters, without an e at the end (but for -le and -ee), at least one."""
    groups = F.size(F.regexp_extract_all(F.lower(word), F.lit("[aeiouy]+"), F.lit(0)))
    silent = F.lower(word).rlike("e$") & ~F.lower(word).rlike("[le]e$") & (groups > 1)
    return F.greatest(F.lit(1), groups - silent.cast("int"))


def mattr(words: DataFrame, window: int = 100) -> DataFrame:
    """Moving-average type-token ratio: the mean share of distinct words over all windows.  A word
    counts in a window if it is its first there, so each place adds the number of windows in which
    it is first.  Texts shorter than a window get the plain ratio, marked as not reliable."""
    rows = stream(words.withColumn("n", F.size("ws").cast("long")), "n")
    before = F.coalesce(F.lag("i").over(W.partitionBy("book", "word").orderBy("i")), F.lit(-1))
    w = F.lit(window)
    firsts = F.greatest(F.lit(0), F.least(F.col("i"), F.col("n") - w) - F.greatest(before + 1, F.col("i") - w + 1, F.lit(0)) + 1)
    rows = rows.withColumn("firsts", firsts).withColumn("new", (before < 0).cast("int"))
    out = rows.groupBy("book", "n").agg(F.sum("firsts").alias("firsts"), F.sum("new").alias("types"))
    ratio = F.when(F.col("n") >= window, F.col("firsts") / ((F.col("n") - window + 1) * window)).otherwise(F.col("types") / F.col("n"))
    return out.select("book", "n", ratio.alias("mattr"), (F.col("n") >= window).alias("reliable"))


def style(words: DataFrame, sentences: DataFrame) -> DataFrame:
    """Per book: words, types, words that occur once, mean word length, sentence length (mean,
    standard deviation, upper median), share of questions, and the two Flesch figures."""
    rows = stream(words).withColumns({"len": F.length("word"), "syl": syllables(F.col("word"))})
    forms = rows.groupBy("book", "word").agg(F.count("*").alias("n"), F.sum("len").alias("len"), F.sum("syl").alias("syl"))
    by_word = forms.groupBy("book").agg(F.sum("n").alias("words"), F.count("*").alias("types"), F.sum((F.col("n") == 1).cast("long")).alias("hapax"), F.sum("len").alias("letters"), F.sum("syl").alias("syllables"))
    lengths = sentences.select("book", "mark", F.size("ws").alias("len")).where("len > 0")
    by_sent = lengths.groupBy("book").agg(
        F.count("*").alias("sentences"), F.avg("len").alias("sent_mean"), F.stddev_pop("len").alias("sent_sd"),
        F.avg((F.col("mark") == "?").cast("double")).alias("q"), F.sort_array(F.collect_list("len")).alias("ls"),
    )
    rows = by_word.join(by_sent, "book")
    per_word, per_sent = F.col("syllables") / F.col("words"), F.col("words") / F.col("sentences")
    return rows.select(
        "book", "words", "types", "hapax", (F.col("letters") / F.col("words")).alias("word_len"), "sentences", "sent_mean", "sent_sd",
        F.element_at("ls", (F.floor(F.size("ls") / 2) + 1).cast("int")).alias("sent_median"), F.coalesce("q", F.lit(0.0)).alias("questions"),
        (206.835 - 1.015 * per_sent - 84.6 * per_word).alias("flesch"), (0.39 * per_sent + 11.8 * per_word - 15.59).alias("grade"),
    )


def z_scores(counts: DataFrame, mfw: int = 100, culling: float = 0.0) -> DataFrame:
    """text, word and z of the most frequent words: relative frequency, standardised over texts
    with the population's deviation.  ``counts`` has text, word and n."""
    totals = counts.groupBy("text").agg(F.sum("n").alias("total"))
    texts = totals.count()
    top = counts.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("range")).where(F.col("range") >= culling * texts)
    top = top.orderBy(F.col("n").desc(), "word").limit(mfw).select("word")
    grid = totals.crossJoin(F.broadcast(top))  # at most mfw words for each text
    rel = grid.join(counts.join(F.broadcast(top), "word"), ["text", "word"], "left").select("text", "word", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("f"))
    means = rel.groupBy("word").agg(F.avg("f").alias("m"), F.stddev_pop("f").alias("s"))
    return rel.join(F.broadcast(means), "word").select("text", "word", F.when(F.col("s") > 0, (F.col("f") - F.col("m")) / F.col("s")).otherwise(0.0).alias("z"))


def deltas(z: DataFrame) -> DataFrame:
    """Distances of all pairs of texts (at most a few hundred): Burrows's, cosine and Euclidean."""
    a, b = z.select(F.col("text").alias("a"), "word", F.col("z").alias("x")), z.select(F.col("text").alias("b"), "word", F.col("z").alias("y"))
    rows = a.join(b, "word").where("a < b")
    sums = rows.groupBy("a", "b").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("classic"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("euclidean"))
    return sums.select("a", "b", "classic", (1 - F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("cosine"), "euclidean")


def cluster(distances: np.ndarray, linkage: str = "average") -> list[tuple[int, int, float, int]]:
    """Agglomerative clustering of a small matrix by the Lance-Williams update: (left, right, height,
    size) of each merge, new clusters numbered from n."""
    if linkage not in ("average", "complete", "ward"):
        raise ValueError("linkage is average, complete or ward")
    n = len(distances)
    d = distances.astype(float) ** (2 if linkage == "ward" else 1)
    np.fill_diagonal(d, np.inf)
    name, size, out = list(range(n)), [1] * n, []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        live = np.flatnonzero(alive)
        sub = d[np.ix_(live, live)]
        i, j = sorted(live[k] for k in np.unravel_index(int(sub.argmin()), sub.shape))
        height = d[i, j]
        others = [k for k in live if k not in (i, j)]
        for k in others:
            if linkage == "complete":
                new = max(d[i, k], d[j, k])
            elif linkage == "average":
                new = (size[i] * d[i, k] + size[j] * d[j, k]) / (size[i] + size[j])
            else:
                all_ = size[i] + size[j] + size[k]
                new = ((size[i] + size[k]) * d[i, k] + (size[j] + size[k]) * d[j, k] - size[k] * height) / all_
            d[i, k] = d[k, i] = new
        size[i] += size[j]
        out.append((name[i], name[j], float(np.sqrt(height) if linkage == "ward" else height), size[i]))
        name[i], alive[j] = n + step, False
    return out


def pca(matrix: np.ndarray, k: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, loadings, explained shares) of a small matrix, signs made definite."""
    x = matrix - matrix.mean(axis=0)
    u, s, v = np.linalg.svd(x, full_matrices=False)
    flip = np.sign(v[np.arange(len(s)), np.abs(v).argmax(axis=1)])
    flip[flip == 0] = 1
    return (u * s * flip)[:, :k], (v * flip[:, None])[:k], (s**2 / max((s**2).sum(), 1e-300))[:k]
