"""License scans: a trained paragraph classifier, native on the executors.

The model is a multinomial logistic regression on binary word n-grams (one to three
words): all those of the notices below and of the fixed paragraphs that are no notice,
but for n-grams of function words alone.
It is trained on the driver from the notices, in seeded variants, and from paragraphs
that are no notice: the fixed ones and a bounded sample of the corpus.  A class
``unknown`` stands for the latter.  Calibration is the last step: models are trained
without one wording of every family, or a part of the other paragraphs, and the
temperature and the offset of ``unknown`` that give these the greatest likelihood
become part of the weights.

A paragraph without a cue word is not scored, which changes nothing: cues are words
of the vocabulary chosen so that the n-grams without one, all together, cannot lift the
probability of any family to what a prediction needs (``cues_of``).  Wrapped notices
are looked for around words of the templates, of which any text that holds the share
of a template's n-grams that confirms a prediction has one (``anchors_of``).

Scoring is relational: distinct paragraphs are found first (a notice that occurs a
million times is scored once), their n-grams meet the weights in a join, and sums
give the probabilities.  A prediction is confirmed if the paragraph holds a large
enough share of the n-grams of one of the family's templates.

Rows
    A paragraph is a line, or a run of lines over which a notice is wrapped; a line
    without a letter or digit ends a run.  Null and empty texts have none.  Rows that share an id
    share what is found in any of them; a null id counts as an id.  Ties between
    families go to the first by name.  An empty table gives no rows.  Long texts are
    read to their end; further columns are not read.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

UNKNOWN = "unknown"

# The usual wording of licence notices, by family.
NOTICES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under the CC0 1.0 Universal Public Domain Dedication.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}
# Sentences with words of notices that are no notice.
OTHERS = (
    "All rights reserved.",
    "She renewed her driver license at the public office in general.",
    "The apache helicopter was released under fire.",
    "He studied at MIT and was released under supervision.",
    "You need a license to fish in this lake, version or not.",
    "The software license agreement was discussed at the meeting.",
    "Creative people in the commons of the town.",
    "A free lunch for any person obtaining a copy of the book.",
    "The terms of the contract were published by the foundation.",
    "Licensed drivers only.",
    "Our terms and conditions apply to the use of this site.",
    "Mozilla and GNU are names of software projects.",
    "The public work is under general version control.",
    "This file is subject to change without notice.",
    "You can come or not, for all I know, and it may be that any of them has not seen it.",
    "As for this, they may use it for what they can, or not, but it has to be of use to you.",
    "Not that all of you can or may do so: it is for the one who has it, and with any of it.",
)
# Function words.
FUNCTION_WORDS = frozenset(
    "a all an and any are as at be been but by can do for from had has have he her his i if in is it its may not of on one or she so that the their them they this to was we were what which who will with you".split()
)
TOKEN = r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"


def _tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[.+-][^\W_]+)*", text.lower())


def _grams(tokens: list[str]) -> set[str]:
    return {" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)}


@dataclass
class Model:
    families: list[str]  # with UNKNOWN last
    cues: list[str]
    weights: dict[str, list[float]]  # by n-gram, one for each family; calibrated, as the biases are
    bias: list[float]
    least: float  # the probability that a prediction needs, on which the cues depend
    anchors: list[str]
    share: float  # the share of a template that confirms, on which the anchors depend


def _variants(text: str, rng: np.random.Generator, filler: list[str], count: int) -> list[str]:
    """A notice as it is, with words lost, and among other words."""
    out = [text]
    words = text.split()
    while len(out) < count:
        kept = [w for w in words if rng.random() > 0.08] or words
        before = [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 6))]
        after = [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 6))]
        out.append(" ".join([*before, *kept, *after]))
    return out


def _soft(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _descend(x: np.ndarray, y: np.ndarray, rounds: int, rate: float, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by gradient descent with Nesterov's momentum; every class counts the same."""
    importance = (y / np.maximum(y.sum(axis=0), 1)).sum(axis=1, keepdims=True)
    importance /= importance.sum()
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        error = (_soft(x @ (w + 0.9 * vw) + b + 0.9 * vb) - y) * importance
        vw = 0.9 * vw - rate * (x.T @ error + penalty * w / x.shape[1])
        vb = 0.9 * vb - rate * error.sum(axis=0)
        w += vw
        b += vb
    return w.astype(float), b.astype(float)


def cues_of(vocabulary: list[str], w: np.ndarray, b: np.ndarray, least: float, often: dict[str, int]) -> list[str]:
    """Words such that no text without any of them is taken for a family with a probability of ``least``.

    For a text without a cue, a family k is ahead of a class j by no more than the biases and all
    weights by which an n-gram without a cue speaks for k rather than j, so its probability is
    at most 1 / (1 + sum over j of exp(-that)).  Cues are added, those first that take away much and
    are rare in texts (``often``), until no family's bound reaches ``least``."""
    ahead = np.maximum(w[:, :-1, None] - w[:, None, :], 0.0)  # n-gram, family k, class j
    own = np.arange(len(b) - 1)
    holders: dict[str, list[int]] = {}
    for n, gram in enumerate(vocabulary):
        for word in set(gram.split()):
            holders.setdefault(word, []).append(n)
    open_, cues = np.ones(len(vocabulary), bool), []
    while True:
        others = np.exp(b[None, :] - b[:-1, None] - ahead[open_].sum(axis=0))
        others[own, own] = 0.0
        over = 1 / (1 + others.sum(axis=1)) >= least
        if not over.any():
            return sorted(cues)
        if not holders:
            raise ValueError("an empty text is taken for a notice")
        worth = {word: ahead[[n for n in at if open_[n]]][:, over].sum() / (1 + often.get(word, 0)) for word, at in holders.items()}
        best = max(sorted(worth), key=worth.__getitem__)
        cues.append(best)
        open_[holders.pop(best)] = False


def anchors_of(share: float, often: dict[str, int]) -> list[str]:
    """Words of which every text has one that holds ``share`` of the n-grams of any template.

    For each template words are taken, rare ones of many n-grams first, until the n-grams
    without any of them are a smaller share."""
    anchors: set[str] = set()
    for notice in (n for t in NOTICES.values() for n in t):
        grams = [set(g.split()) for g in _grams(_tokens(notice))]
        while sum(not g & anchors for g in grams) >= share * len(grams) - 1e-9:
            covers = {w: sum(w in g for g in grams if not g & anchors) / (1 + often.get(w, 0)) for g in grams for w in g - anchors}
            anchors.add(max(sorted(covers), key=covers.__getitem__))
    return sorted(anchors)


def train(paragraphs: list[str], seed: int = 3, variants: int = 24, rounds: int = 400, rate: float = 2.0, penalty: float = 1e-3, fair: float = 0.05, least: float = 0.5, share: float = 0.6) -> Model:
    """Fit on the notices and on paragraphs of the corpus that count as no notice."""
    rng = np.random.default_rng(seed)
    families = [*sorted(NOTICES), UNKNOWN]
    filler = sorted({w for p in paragraphs for w in p.split() if len(w) < 30})[:2000] or ["word"]
    texts, label, wording = [], [], []
    for k, family in enumerate(families[:-1]):
        for no, notice in enumerate(NOTICES[family]):
            got = _variants(notice, rng, filler, variants)
            texts += got
            label += [k] * len(got)
            wording += [no % 3] * len(got)
    # Corpus paragraphs that hold one of these words, or a fair share of a notice's n-grams of
    # words that no fixed paragraph has, might be notices themselves and are not used.
    telling = {"license", "licensed", "copyright", "spdx-license-identifier"}
    general = {w for p in OTHERS for w in _tokens(p)} - telling
    marked = [{g for g in _grams(_tokens(n)) if not set(g.split()) <= general} for t in NOTICES.values() for n in t]

    def like_notice(p: str) -> bool:
        mine = _grams(_tokens(p))
        return any(len(mine & t) >= fair * len(t) for t in marked)

    plain = [p for p in paragraphs if not telling & set(_tokens(p)) and not like_notice(p)]
    for n, p in enumerate([*OTHERS * 6, *plain, *[""] * 20]):
        texts.append(p)
        label.append(len(families) - 1)
        wording.append(n % len(OTHERS) % 3 if n < 6 * len(OTHERS) else n % 3)
    vocabulary = sorted({g for t in [*NOTICES.values(), OTHERS] for n in t for g in _grams(_tokens(n)) if not set(g.split()) <= FUNCTION_WORDS})
    at = {g: n for n, g in enumerate(vocabulary)}
    x = np.zeros((len(texts), len(vocabulary)), np.float32)
    for row, text in enumerate(texts):
        x[row, [at[g] for g in _grams(_tokens(text)) if g in at]] = 1
    y, fold = np.eye(len(families), dtype=np.float32)[label], np.array(wording)
    w, b = _descend(x, y, rounds, rate, penalty)
    # calibration, by wordings that the model they are put to has not seen
    apart = np.zeros(y.shape)
    for n in range(3):
        w_n, b_n = _descend(x[fold != n], y[fold != n], rounds // 2, rate, penalty)
        apart[fold == n] = x[fold == n] @ w_n + b_n
    lowest, unknown = np.inf, np.eye(len(families))[-1]
    for heat in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8):
        for offset in np.arange(-2.0, 2.01, 0.5):
            loss = -(y * np.log(np.maximum(_soft(apart / heat + offset * unknown), 1e-12))).sum(axis=1)
            loss = (loss * (y / y.sum(axis=0)).sum(axis=1)).sum()
            if loss < lowest and (b[-1] - b[:-1]).min() / heat + offset > 0:
                lowest, chosen = loss, (heat, offset)
    heat, offset = chosen
    w, b = w / heat, b / heat + offset * unknown
    often: dict[str, int] = {}
    for p in paragraphs:
        for word in set(_tokens(p)):
            often[word] = often.get(word, 0) + 1
    return Model(families, cues_of(vocabulary, w, b, least, often), {g: w[n].tolist() for g, n in at.items()}, b.tolist(), least, anchors_of(share, often), share)


def sample_paragraphs(documents: DataFrame, most_documents: int = 200, most_paragraphs: int = 1000) -> list[str]:
    """Paragraphs of the documents with the smallest hash, whole ones, up to both bounds."""
    first = documents.select(F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("h"), "doc_id").where("doc_id is not null")
    ids = [r["doc_id"] for r in first.orderBy("h").limit(most_documents).collect()]
    if not ids:
        return []
    lines = documents.where(F.col("doc_id").isin(ids)).select(F.explode(_paragraphs(F.col("text"))).alias("p"))
    return [r["p"] for r in lines.select("p", F.xxhash64("p").alias("h")).distinct().orderBy("h", "p").limit(most_paragraphs).collect()]


def _paragraphs(text: Column) -> Column:
    return F.filter(F.split(text.cast("string"), r"\r\n|\r|\n"), lambda p: F.length(F.trim(p)) > 0)


def _local(spark, rows: list[dict], schema: str) -> DataFrame:
    """A small table as a literal, so that no Python runs on the executors."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def scan_paragraphs(paragraphs: DataFrame, model: Model) -> DataFrame:
    """family, probability, held (share of a template) and confirmed of each distinct value of ``paragraph``; only
    those with a cue come back, and those that are found unknown do not."""
    spark = paragraphs.sparkSession
    distinct = paragraphs.select("paragraph").distinct()
    words = F.regexp_extract_all(F.lower("paragraph"), F.lit(TOKEN), F.lit(0))

    def runs(n: int) -> Column:
        first = F.sequence(F.lit(1), F.size("words") - (n - 1))
        none = F.array().cast("array<string>")
        return F.when(F.size("words") >= n, F.transform(first, lambda i: F.array_join(F.slice(F.col("words"), i, n), " "))).otherwise(none)

    grams = F.concat(runs(1), runs(2), runs(3))
    table = distinct.withColumn("words", words).select("paragraph", F.explode(F.array_distinct(grams)).alias("gram"))
    names = [f"w{k}" for k in range(len(model.families))]
    weights = _local(spark, [{"gram": g} | dict(zip(names, w, strict=True)) for g, w in model.weights.items()], "gram: string, " + ", ".join(f"{n}: double" for n in names))
    met = table.join(F.broadcast(weights), "gram").groupBy("paragraph").agg(*[F.sum(n).alias(n) for n in names])
    z = F.array(*[F.col(n) + F.lit(b) for n, b in zip(names, model.bias, strict=True)])
    scored = met.select("paragraph", z.alias("z")).withColumn("best", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("best")))
    scored = scored.select("paragraph", F.element_at(F.array(*map(F.lit, model.families)), F.array_position("z", F.col("best")).cast("int")).alias("family"), (1 / total).alias("probability"))
    scored = scored.where((F.col("family") != UNKNOWN) & (F.col("probability") >= model.least))
    templates = []
    for family, notices in NOTICES.items():
        for no, notice in enumerate(notices):
            got = _grams(_tokens(notice))
            templates += [{"t_family": family, "template": no, "t_gram": g, "size": len(got)} for g in sorted(got)]
    templates = _local(spark, templates, "t_family: string, template: int, t_gram: string, size: int")
    found = scored.join(table, "paragraph").join(F.broadcast(templates), (F.col("gram") == F.col("t_gram")) & (F.col("family") == F.col("t_family")))
    held = found.groupBy("paragraph", "family", "probability", "template").agg((F.count("*") / F.max("size")).alias("held"))
    return held.groupBy("paragraph", "family", "probability").agg(F.max("held").alias("held"), (F.max("held") >= model.share - 1e-9).alias("confirmed"))


def _any_of(words: list[str]) -> str:
    """A pattern for texts with one of the words."""
    return "(?iu)(?<![\\p{L}\\p{N}])(?:" + "|".join(re.escape(w) for w in words) + ")(?![\\p{L}\\p{N}])"


def _units(documents: DataFrame, cue: str, anchor: str, reach: int) -> DataFrame:
    """Lines with a cue, and runs of lines that a wrapped notice may fill, with a cue and an anchor:
    doc_id, block, the places lo and hi of the first and last line in the block, and paragraph.

    A block ends at a line without a letter or digit.  Lines between the first and the last of a
    run hold at most ``reach`` words together; of these two the nearest ``reach`` words count."""
    text = F.col("text").cast("string")
    plain = F.regexp_replace(F.regexp_replace(text, "\\r\\n?", "\n"), r"(?dm)^[^\p{L}\p{N}\n]++$", "")
    blocks = documents.where(text.rlike(cue)).select("doc_id", F.explode(F.split(plain, "\n\n+")).alias("text"))
    blocks = blocks.where(F.col("text").rlike(cue)).select("doc_id", F.monotonically_increasing_id().alias("block"), F.split("text", "\n").alias("lines"))
    words = F.transform("lines", lambda x: F.struct(x.alias("line"), x.rlike(cue).alias("hit"), x.rlike(anchor).alias("sure"), F.regexp_extract_all(F.lower(x), F.lit(TOKEN), F.lit(0)).alias("words")))

    def ends(x: Column) -> Column:
        n = F.size(x["words"])
        tail = F.slice(x["words"], F.greatest(F.lit(1), n - (reach - 1)), reach)
        return F.struct(x["line"].alias("line"), x["hit"].alias("hit"), x["sure"].alias("sure"), n.alias("n"), F.array_join(F.slice(x["words"], 1, reach), " ").alias("head"), F.array_join(tail, " ").alias("tail"))

    lines = blocks.select("doc_id", "block", F.transform(words, ends).alias("lines"))
    starts = lines.select("doc_id", "block", F.posexplode(F.transform("lines", lambda _, i: F.slice("lines", i + 1, reach + 2))).alias("lo", "run"))
    starts = starts.where(F.col("run")[0]["hit"] | F.exists("run", lambda x: x["sure"]))
    # the furthest line that a run from here can end at
    none = F.struct(F.lit(0).alias("words"), F.lit(1).alias("last"))
    grown = lambda a, x: F.when(a["words"] > reach, a).otherwise(F.struct((a["words"] + x["n"]).alias("words"), (a["last"] + 1).alias("last")))
    last = F.aggregate(F.slice("run", 2, reach + 1), none, grown)["last"]
    several = F.transform(
        F.filter(F.sequence(F.lit(1), last), lambda k: F.exists(F.slice("run", 1, k), lambda x: x["hit"]) & ((k == 1) | F.exists(F.slice("run", 1, k), lambda x: x["sure"]))),
        lambda k: F.struct(
            (k - 1).alias("more"),
            F.when(k == 1, F.col("run")[0]["line"]).otherwise(F.concat_ws(" ", F.col("run")[0]["tail"], F.transform(F.slice("run", 2, k - 1), lambda x: x["head"]))).alias("paragraph"),
        ),
    )
    each = starts.select("doc_id", "block", "lo", F.explode(several).alias("u"))
    return each.select("doc_id", "block", "lo", (F.col("lo") + F.col("u.more")).alias("hi"), F.col("u.paragraph").alias("paragraph"))


def scan(documents: DataFrame, model: Model, scratch: Scratch, salts: int = 16) -> DataFrame:
    """doc_id, families (confirmed ones), unconfirmed (others that are predicted), the number
    of paragraphs that are confirmed notices, and the highest probability of these."""
    ids = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    reach = 3 * max(len(_tokens(n)) for t in NOTICES.values() for n in t) // 2
    units = scratch.keep(_units(ids, _any_of(model.cues), _any_of(model.anchors), reach), "units")
    judged = scan_paragraphs(units, model)
    # of runs that overlap, the one that holds most of its template counts, then the shortest
    # a notice that very many documents hold is dealt to several tasks; judged paragraphs, which are distinct, to each
    salted = units.withColumn("salt", F.pmod(F.xxhash64("doc_id", "block"), F.lit(salts)))
    judged = judged.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    found = salted.join(judged, ["paragraph", "salt"]).groupBy("doc_id", "block").agg(
        F.array_sort(F.collect_list(F.when(F.col("confirmed"), F.struct((-F.col("held")).alias("lacks"), (F.col("hi") - F.col("lo")).alias("more"), "lo", "hi", "family", "probability")))).alias("sure"),
        F.collect_list(F.when(~F.col("confirmed") & (F.col("lo") == F.col("hi")), F.struct("lo", "family"))).alias("unsure"),
    )
    overlaps = lambda a, lo, hi: F.exists(a, lambda t: (t["lo"] <= hi) & (lo <= t["hi"]))
    taken = F.aggregate("sure", F.slice("sure", 1, 0), lambda a, w: F.when(overlaps(a, w["lo"], w["hi"]), a).otherwise(F.concat(a, F.array(w))))
    found = found.select("doc_id", taken.alias("taken"), "unsure")
    hits = found.groupBy("doc_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.col("taken.family"))))).alias("families"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(F.filter("unsure", lambda u: ~overlaps(F.col("taken"), u["lo"], u["lo"])), lambda u: u["family"]))))).alias("unconfirmed"),
        F.sum(F.size("taken")).alias("paragraphs"),
        F.round(F.max(F.array_max(F.col("taken.probability"))), 6).alias("probability"),
    )
    none = F.array().cast("array<string>")
    hits = hits.withColumnRenamed("doc_id", "hit_id")
    out = ids.select("doc_id").join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    return out.select("doc_id", F.coalesce("families", none).alias("families"), F.coalesce("unconfirmed", none).alias("unconfirmed"), F.coalesce("paragraphs", F.lit(0)).cast("long").alias("paragraphs"), "probability")
