"""Operators on annotated books: coverage, groups, names, grammatical relations, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.annotated import QUOTE_MARKS, Corpus
from .entities import top_value


def cover(corpus: Corpus) -> DataFrame:
    """(book, i, mi): the mentions that cover a token."""
    return corpus.mention.select("book", "mi", "coref", "cat", F.explode(F.sequence("start", "end")).alias("i"))


def spoken(corpus: Corpus) -> DataFrame:
    """(book, i, char): tokens in quotes, with the speaker of the last quote in the file that covers them."""
    rows = corpus.quote.select("book", "qi", "char", F.explode(F.sequence("start", "end")).alias("i"))
    return rows.groupBy("book", "i").agg(F.max(F.struct("qi", "char"))["char"].alias("char"))


def token_view(corpus: Corpus) -> DataFrame:
    """Tokens with in_quote, speaker, ss and the categories that cover them."""
    quoted = spoken(corpus).withColumnRenamed("char", "speaker").withColumn("in_quote", F.lit(True))
    covered = cover(corpus).groupBy("book", "i").agg(F.collect_set("cat").alias("ents"))
    out = corpus.token.join(quoted, ["book", "i"], "left").join(corpus.supersense, ["book", "i"], "left").join(covered, ["book", "i"], "left")
    return out.withColumn("in_quote", F.coalesce("in_quote", F.lit(False)))


def searchable(corpus: Corpus) -> DataFrame:
    """Tokens with everything that a pattern can ask for: besides their own columns, the kinds, categories and
    entities' names of the mentions that cover them (lists), the speaker's name, whether they are
    in a quote, and their supersense."""
    names = groups(corpus).select("book", "coref", "name")
    covered = cover(corpus).join(corpus.mention.select("book", "mi", "prop"), ["book", "mi"]).join(names, ["book", "coref"], "left")
    covered = covered.groupBy("book", "i").agg(F.collect_set("cat").alias("ent"), F.collect_set("prop").alias("prop"), F.collect_set("name").alias("char"))
    said = spoken(corpus).join(names.select("book", F.col("coref").alias("char"), F.col("name").alias("speaker")), ["book", "char"], "left")
    out = corpus.token.join(covered, ["book", "i"], "left").join(said.select("book", "i", "speaker", F.lit(True).alias("quote")), ["book", "i"], "left")
    out = out.join(corpus.supersense, ["book", "i"], "left")
    return out.withColumn("quote", F.coalesce("quote", F.lit(False)))


SCOPES = ("all", "narration", "dialogue", "speech")


def in_scope(corpus: Corpus, scope: str = "all", speakers: DataFrame | None = None) -> DataFrame:
    """Tokens with a column ``inside``: all, those outside quotes, those in quotes, or those in quotes of the
    groups (book, coref) of ``speakers``."""
    if scope not in SCOPES or (scope == "speech") != (speakers is not None):
        raise ValueError("scope is all, narration, dialogue, or speech of some speakers")
    if scope == "all":
        return corpus.token.withColumn("inside", F.lit(True))
    said = spoken(corpus)
    if scope == "speech":
        said = said.join(speakers.select("book", F.col("coref").alias("char")).distinct(), ["book", "char"], "left_semi")
    rows = corpus.token.join(said.select("book", "i", F.lit(True).alias("said")), ["book", "i"], "left")
    said = F.coalesce("said", F.lit(False))
    return rows.withColumn("inside", ~said if scope == "narration" else said).drop("said")


UNITS = {
    "lemma": lambda case: F.lower("lemma"),
    "word": lambda case: F.col("word") if case else F.lower("word"),
    "word_pos": lambda case: F.concat_ws("_", F.col("word") if case else F.lower("word"), F.col("pos")),
    "full": lambda case: F.concat_ws("\t", F.col("word") if case else F.lower("word"), F.col("pos"), F.lower("lemma")),
    "pos": lambda case: F.col("pos"),
}


def items(corpus: Corpus, unit: str = "word", case: bool = False, scope: str = "all", speakers: DataFrame | None = None, pos: tuple[str, ...] = (), tags: tuple[str, ...] = (), ents: tuple[str, ...] = (), runs: bool = False, within_sentence: bool = False, punctuation: bool = False) -> DataFrame:
    """(book, ws): the items of the words in scope, in order, for every operator that counts words.

    An item is the word, its lemma, word and class, all three, or the class.  ``pos``, ``tags`` and
    ``ents`` leave words of these classes, tags, or in a mention of these categories.  With ``runs``
    a row is a run of words that no token out of scope interrupts (nor a sentence's end, if
    asked for), so that n-grams do not reach over gaps."""
    from pyspark.sql.window import Window as W

    rows = in_scope(corpus, scope, speakers)
    if runs:
        order = W.partitionBy("book").orderBy("i")
        rows = rows.withColumn("run", F.sum((~F.col("inside")).cast("long")).over(order))
    rows = rows.where("inside") if punctuation else rows.where("inside and isword")
    if pos:
        rows = rows.where(F.col("pos").isin(*pos))
    if tags:
        rows = rows.where(F.col("tag").isin(*tags))
    if ents:
        rows = rows.join(cover(corpus).where(F.col("cat").isin(*ents)).select("book", "i").distinct(), ["book", "i"], "left_semi")
    keys = ["book", *(["run"] if runs else []), *(["sent"] if within_sentence else [])]
    listed = F.array_sort(F.collect_list(F.struct("i", UNITS[unit](case).alias("item"))))
    return rows.groupBy(*keys).agg(F.transform(listed, lambda x: x["item"]).alias("ws")).select("book", "ws")


def quote_keys(corpus: Corpus, tokens: int = 30, letters: int = 120) -> DataFrame:
    """(book, qi, key): a name for a quote that outlives a new export: its first words in lower case, quotation
    marks aside, and the number of the quote among those that begin alike."""
    rows = corpus.quote.select("book", "qi", F.explode(F.sequence("start", F.least("end", F.col("start") + tokens - 1))).alias("i"))
    return _keys(corpus, rows, "qi", letters)


def paragraph_keys(corpus: Corpus, tokens: int = 15, letters: int = 80) -> DataFrame:
    """(book, para, key): the same for paragraphs, by their first words."""
    rows = corpus.spans("para").select("book", "para", F.explode(F.sequence("s", F.least("e", F.col("s") + tokens - 1))).alias("i"))
    return _keys(corpus, rows, "para", letters)


def _keys(corpus: Corpus, rows: DataFrame, of: str, letters: int) -> DataFrame:
    from pyspark.sql.window import Window as W

    words = rows.join(corpus.token.select("book", "i", F.lower("word").alias("w")), ["book", "i"])
    plain = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: ~x["w"].isin(*QUOTE_MARKS)), lambda x: x["w"])
    texts = words.groupBy("book", of).agg(F.substring(F.array_join(plain, " "), 1, letters).alias("text"))
    number = F.row_number().over(W.partitionBy("book", "text").orderBy(of))
    return texts.select("book", of, F.concat("text", F.lit("#"), number.cast("string")).alias("key"))


def words_in(corpus: Corpus, members: DataFrame) -> int:
    """Words of the books that hold the groups of ``members``, each book once."""
    books_ = members.select("book").distinct()
    return corpus.token.where("isword").join(books_, "book", "left_semi").count()


def forms(corpus: Corpus, members: DataFrame, top: int = 25) -> DataFrame:
    """(prop, form, n, rank): the most frequent forms of the groups' mentions of each kind; pronouns in lower case."""
    from pyspark.sql.window import Window as W

    form = F.when(F.col("prop") == "PRON", F.lower("text")).otherwise(F.col("text"))
    rows = corpus.mention.join(members.select("book", "coref").distinct(), ["book", "coref"], "left_semi")
    counted = rows.groupBy("prop", form.alias("form")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("prop").orderBy(F.col("n").desc(), "form"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= top)


def presence(corpus: Corpus, members: DataFrame, bins: int = 100) -> DataFrame:
    """(book, bin, n): mentions of the groups along each book, by the place of their first token."""
    rows = corpus.mention.join(members.select("book", "coref").distinct(), ["book", "coref"], "left_semi")
    rows = rows.join(corpus.sizes.select("book", "n_tokens"), "book")
    place = F.least(F.lit(bins - 1), F.floor(bins * F.col("start") / F.col("n_tokens"))).cast("int")
    return rows.groupBy("book", place.alias("bin")).agg(F.count("*").alias("n"))


def context_of(corpus: Corpus, book: str, start: int, end: int, longest: int = 400, around: int = 150) -> DataFrame:
    """Tokens of the paragraph of a hit, with whether they are in it; of a longer one than ``longest``, those
    within ``around`` tokens."""
    para = corpus.token.where((F.col("book") == book) & (F.col("i") == start)).select("book", "para")
    rows = corpus.token.join(para, ["book", "para"], "left_semi")
    near = (F.lit(start - around) <= F.col("i")) & (F.col("i") < F.lit(end + around))
    from pyspark.sql.window import Window as W

    rows = rows.withColumn("size", F.count("*").over(W.partitionBy("book", "para"))).where((F.col("size") <= longest) | near)
    return rows.select("book", "i", "word", F.col("i").between(start, end - 1).alias("hit"))


def groups(corpus: Corpus) -> DataFrame:
    """Coreference groups: type (most frequent category, ties to the first seen), name and counts.  The
    name is the book's own, else the most frequent proper, nominal or pronominal form."""
    m = corpus.mention
    kind = top_value(m, ["book", "coref"], "cat", "mi").select("book", "coref", F.col("cat").alias("type"))
    forms = m.groupBy("book", "coref", "prop", "text").agg(F.count("*").alias("n"), F.min("mi").alias("first"))
    level = F.when(F.col("prop") == "PROP", 0).when(F.col("prop") == "NOM", 1).when(F.col("prop") == "PRON", 2).otherwise(3)
    best = forms.groupBy("book", "coref").agg(F.min_by("text", F.struct(level, -F.col("n"), "first")).alias("form"))
    counts = m.groupBy("book", "coref").agg(F.count("*").alias("mentions"), *[F.sum((F.col("prop") == p).cast("long")).alias(f"n_{p.lower()}") for p in ("PROP", "NOM", "PRON")])
    named = counts.join(kind, ["book", "coref"]).join(best, ["book", "coref"]).join(corpus.character, ["book", "coref"], "left")
    return named.select("book", "coref", "type", F.coalesce(F.nullif("name", F.lit("")), "form").alias("name"), "pronouns", "mentions", "n_prop", "n_nom", "n_pron")


def heads(corpus: Corpus) -> DataFrame:
    """Mentions with their head: the first token whose own head lies outside or is itself, else the last."""
    t = corpus.token.select("book", "i", "head")
    rows = corpus.mention.select("book", "mi", "coref", "start", "end", F.explode(F.sequence("start", "end")).alias("i")).join(t, ["book", "i"])
    outside = (F.col("head") < F.col("start")) | (F.col("head") > F.col("end")) | (F.col("head") == F.col("i"))
    return rows.groupBy("book", "mi", "coref", "start", "end").agg(F.coalesce(F.min(F.when(outside, F.col("i"))), F.max("end")).alias("h"))


def relations(corpus: Corpus, hops: int = 5) -> DataFrame:
    """(book, coref, mi, rel, item): what a mention does (agent), undergoes (patient), has (poss), stands
    to by a preposition (prep), and how it is described (mod).

    Coordinated heads climb to their first conjunct, ``hops`` times at most; each climb is a join on
    the book and the head."""
    t = corpus.token.select("book", "i", F.lower("lemma").alias("lemma"), "pos", "dep", "head")
    at = heads(corpus).select("book", "mi", "coref", "start", "end", F.col("h").alias("i"))
    cur = at.join(t, ["book", "i"]).select("book", "mi", "coref", "start", "end", F.col("i").alias("h"), "i", "dep", "head", "pos", "lemma")
    up = t.select("book", F.col("i").alias("u_i"), F.col("dep").alias("u_dep"), F.col("head").alias("u_head"))
    for _ in range(hops):
        climbs = (F.col("dep") == "conj") & (F.col("head") != F.col("i"))
        cur = cur.join(up, (cur["book"] == up["book"]) & climbs & (F.col("head") == F.col("u_i")), "left").select(
            cur["book"], "mi", "coref", "start", "end", "h", "pos", "lemma",
            F.when(F.col("u_i").isNotNull(), F.col("u_i")).otherwise(F.col("i")).alias("i"),
            F.when(F.col("u_i").isNotNull(), F.col("u_dep")).otherwise(F.col("dep")).alias("dep"),
            F.when(F.col("u_i").isNotNull(), F.col("u_head")).otherwise(F.col("head")).alias("head"),
        )
    gov = t.select("book", F.col("i").alias("head"), F.col("lemma").alias("g_lemma"), F.col("pos").alias("g_pos"), F.col("dep").alias("g_dep"), F.col("head").alias("g_head"))
    rows = cur.join(gov, ["book", "head"]).where(F.col("head") != F.col("i"))
    top = t.select("book", F.col("i").alias("g_head"), F.col("lemma").alias("v_lemma"), F.col("pos").alias("v_pos"))
    rows = rows.join(top, ["book", "g_head"], "left")
    by_agent = (F.col("dep") == "pobj") & (F.col("g_dep") == "agent")
    rel = (
        F.when((F.col("dep") == "nsubj") & (F.col("g_pos") == "VERB"), "agent").when(by_agent & (F.col("v_pos") == "VERB"), "agent")
        .when(F.col("dep").isin("dobj", "nsubjpass", "dative") & F.col("g_pos").isin("VERB", "AUX"), "patient")
        .when(F.col("dep") == "poss", "poss").when(F.col("dep") == "pobj", "prep")
    )
    item = F.when(by_agent, F.col("v_lemma")).when((F.col("dep") == "pobj") & F.col("v_lemma").isNotNull() & (F.col("g_head") != F.col("head")), F.concat_ws(" ", "v_lemma", "g_lemma")).otherwise(F.col("g_lemma"))
    main = rows.withColumn("rel", rel).withColumn("item", item).where("rel is not null").select("book", "coref", "mi", "rel", "item")
    # verbs coordinated with the one a subject belongs to, without a subject of their own
    subjects = t.where("dep in ('nsubj', 'nsubjpass')").select("book", F.col("head").alias("i")).distinct()
    verbs = t.where("dep = 'conj' and pos = 'VERB'").join(subjects, ["book", "i"], "left_anti").select("book", F.col("head").alias("head"), F.col("lemma").alias("item"))
    more = rows.where("dep = 'nsubj' and g_pos = 'VERB'").join(verbs, ["book", "head"]).select("book", "coref", "mi", F.lit("agent").alias("rel"), "item")
    children = t.select("book", F.col("head").alias("h"), F.col("i").alias("c_i"), F.col("lemma").alias("item"), F.col("dep").alias("c_dep"), F.col("pos").alias("c_pos"))
    first = heads(corpus).select("book", "mi", "coref", "start", "end", "h")
    inside = first.join(children, ["book", "h"]).where((F.col("c_dep") == "amod") | ((F.col("c_dep") == "appos") & F.col("c_pos").isin("NOUN", "PROPN"))).select("book", "coref", "mi", F.lit("mod").alias("rel"), "item")
    be = rows.where("dep = 'nsubj' and g_lemma = 'be'").select("book", "coref", "mi", "start", "end", F.col("head").alias("h"))
    told = be.join(children, ["book", "h"]).where(F.col("c_dep").isin("attr", "acomp") & ((F.col("c_i") < F.col("start")) | (F.col("c_i") > F.col("end")))).select("book", "coref", "mi", F.lit("mod").alias("rel"), "item")
    return main.unionByName(more).unionByName(inside).unionByName(told)


def relation_table(relations_: DataFrame, members: DataFrame, words: int, top: int = 50) -> DataFrame:
    """Items of each relation of some groups (book, coref): n, rate per thousand words and share."""
    from pyspark.sql.window import Window as W

    mine = relations_.join(members, ["book", "coref"], "left_semi").groupBy("rel", "item").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("rel"))
    k = F.row_number().over(W.partitionBy("rel").orderBy(F.col("n").desc(), "item"))
    return mine.withColumns({"total": total, "k": k}).where(F.col("k") <= top).select("rel", "item", "n", "total", (F.col("n") * 1000.0 / words).alias("per1k"), (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def company(corpus: Corpus, by: str = "sent") -> DataFrame:
    """(book, container, coref): which groups are mentioned in which sentence or paragraph, by the
    first token of the mention; ``network.edges`` makes a network of it."""
    t = corpus.token.select("book", F.col("i").alias("start"), F.col(by).alias("no"))
    return corpus.mention.join(t, ["book", "start"]).select("book", F.struct("book", "no").alias("container"), F.concat_ws(":", F.lit("e"), "book", "coref").alias("entity")).distinct()


def named_by(corpus: Corpus) -> DataFrame:
    """(book, speaker, coref, n): how often speakers name a group in their quotes, pronouns aside."""
    said = spoken(corpus).select("book", F.col("i").alias("start"), F.col("char").alias("speaker")).where("speaker is not null")
    return corpus.mention.where("prop != 'PRON'").join(said, ["book", "start"]).groupBy("book", "speaker", "coref").agg(F.count("*").alias("n"))


def span_text(corpus: Corpus, spans: DataFrame) -> DataFrame:
    """The text of spans (book, id, s, e): a space where the offsets leave a gap, or, without offsets,
    between all tokens."""
    rows = spans.select("book", "id", F.explode(F.sequence("s", "e")).alias("i")).join(corpus.token.select("book", "i", "word", "onset", "offset"), ["book", "i"])
    parts = F.sort_array(F.collect_list(F.struct("i", "word", "onset", "offset")))
    rows = rows.groupBy("book", "id").agg(parts.alias("p"))
    gap = lambda a, b: F.when((a["offset"] < 0) | (b["onset"] > a["offset"]), " ").otherwise("")
    text = F.aggregate(F.sequence(F.lit(1), F.size("p")), F.lit(""), lambda acc, k: F.concat(acc, F.when(k > 1, gap(F.get("p", k - 2), F.get("p", k - 1))).otherwise(""), F.get("p", k - 1)["word"]))
    return rows.select("book", "id", text.alias("text"))


# Words that lead to an address, marks that follow one, words that open no address,
# and adverbs that do not say how something is said.
LEADS = ("my", "dear", "o", "oh", "ah", "well", "yes", "no", "now", "look", "listen", "sir", "madam")
AFTER_ADDRESS = (",", "!", "?", ".", ";", "—", "--", ":")
DETERMINERS = ("a", "an", "the", "this", "that", "these", "those", "some", "any")
PLAIN_ADVERBS = (
    "then", "again", "now", "so", "also", "still", "there", "here", "too", "just", "even", "only", "back", "up",
    "down", "out", "away", "on", "off", "in", "once", "at", "all", "not", "n't", "never", "ever", "yet", "however",
)


def speech_verbs(corpus: Corpus, hops: int = 4, reach: int = 8) -> DataFrame:
    """(book, qi, v, verb, method): the verb of each quote's attribution.  It governs the attributing
    mention as its subject (over at most ``hops`` conjuncts), else it is the nearest verb within
    ``reach`` tokens after the quote, then before it, in its paragraph and outside quotes."""
    t = corpus.token.select("book", "i", "para", "lemma", "pos", "dep", "head")
    h = heads(corpus).select("book", F.col("start").alias("mstart"), F.col("end").alias("mend"), "h")
    cur = corpus.quote.where("mstart is not null").join(h, ["book", "mstart", "mend"]).select("book", "qi", F.col("h").alias("i"))
    cur = cur.join(t.select("book", "i", "dep", "head"), ["book", "i"])
    up = t.select("book", F.col("i").alias("u_i"), F.col("dep").alias("u_dep"), F.col("head").alias("u_head"))
    for _ in range(hops):
        climbs = (F.col("dep") == "conj") & (F.col("head") != F.col("i"))
        cur = cur.join(up, (cur["book"] == up["book"]) & climbs & (F.col("head") == F.col("u_i")), "left").select(
            cur["book"], "qi", F.coalesce("u_i", "i").alias("i"), F.coalesce("u_dep", "dep").alias("dep"), F.coalesce("u_head", "head").alias("head")
        )
    gov = t.where("pos = 'VERB'").select("book", F.col("i").alias("head"), F.lower("lemma").alias("verb"))
    by_subject = cur.where("dep = 'nsubj'").join(gov, ["book", "head"]).groupBy("book", "qi").agg(F.min(F.struct(F.col("head").alias("v"), "verb")).alias("x")).select("book", "qi", "x.v", "x.verb", F.lit("subject").alias("method"))
    rest = corpus.quote.join(by_subject.select("book", "qi"), ["book", "qi"], "left_anti")
    para = t.select("book", F.col("i").alias("start"), F.col("para").alias("q_para"))
    rest = rest.join(para, ["book", "start"])
    near = rest.select("book", "qi", "start", "end", "q_para", F.explode(F.concat(F.transform(F.sequence(F.lit(1), F.lit(reach)), lambda d: F.struct(F.lit(0).alias("side"), d.alias("d"), (F.col("end") + d).alias("i"))), F.transform(F.sequence(F.lit(1), F.lit(reach)), lambda d: F.struct(F.lit(1).alias("side"), d.alias("d"), (F.col("start") - d).alias("i"))))).alias("n"))
    near = near.select("book", "qi", "q_para", "n.side", "n.d", "n.i").join(t.select("book", "i", "para", F.lower("lemma").alias("verb"), "pos"), ["book", "i"]).join(spoken(corpus).select("book", "i", F.lit(True).alias("said")), ["book", "i"], "left")
    # a quote or another paragraph in between ends the search on that side
    wall = F.min(F.when((F.col("para") != F.col("q_para")) | F.col("said"), F.col("d")))
    walls = near.groupBy("book", "qi", "side").agg(wall.alias("wall"))
    seen = near.join(walls, ["book", "qi", "side"]).where((F.col("pos") == "VERB") & (F.col("wall").isNull() | (F.col("d") < F.col("wall"))))
    by_place = seen.groupBy("book", "qi").agg(F.min(F.struct("side", "d", F.col("i").alias("v"), "verb")).alias("x")).select("book", "qi", "x.v", "x.verb", F.when(F.col("x.side") == 0, "after").otherwise("before").alias("method"))
    return by_subject.unionByName(by_place)


def speech_adverbs(corpus: Corpus, verbs: DataFrame) -> DataFrame:
    """(book, qi, adverb): adverbs of the verb of speech that lie outside the quote."""
    a = corpus.token.where("dep = 'advmod' and pos = 'ADV'").select("book", F.col("head").alias("v"), F.col("i").alias("a_i"), F.lower("word").alias("adverb"))
    rows = verbs.join(a, ["book", "v"]).join(corpus.quote.select("book", "qi", "start", "end"), ["book", "qi"])
    return rows.where(~F.col("a_i").between(F.col("start"), F.col("end")) & ~F.col("adverb").isin(*PLAIN_ADVERBS)).select("book", "qi", "adverb")


def vocatives(corpus: Corpus) -> DataFrame:
    """(book, qi, coref): persons addressed in a quote.  A name at the quote's beginning, after a comma or
    after a word that leads to an address; a description after such a word, or between a comma and
    the end of a sentence or of the quote.  A mark or the quote's end has to follow."""
    words = corpus.token.select("book", "i", F.lower("word").alias("w"))
    inside = corpus.quote.select("book", "qi", "start", "end", F.explode(F.sequence("start", "end")).alias("i")).join(words, ["book", "i"])
    # the first word, quotation marks aside
    opening = inside.groupBy("book", "qi").agg(F.coalesce(F.min(F.when(~F.col("w").isin(*QUOTE_MARKS), F.col("i"))), F.min("i")).alias("opening"))
    names = corpus.mention.where("prop in ('PROP', 'NOM') and cat = 'PER'").select("book", "coref", "prop", F.col("start").alias("i"), F.col("end").alias("m_end"))
    rows = names.join(inside, ["book", "i"]).join(opening, ["book", "qi"])
    before = words.select("book", (F.col("i") + 1).alias("i"), F.col("w").alias("w_before"))
    after = words.select("book", (F.col("i") - 1).alias("m_end"), F.col("w").alias("after"))
    rows = rows.join(before, ["book", "i"], "left").join(after, ["book", "m_end"], "left")
    before = F.when(F.col("i") > F.col("start"), F.col("w_before"))  # nothing before the quote counts
    led, comma = F.coalesce(before.isin(*LEADS), F.lit(False)), F.coalesce(before == ",", F.lit(False))
    last, mark = F.col("m_end") >= F.col("end"), F.col("after").isin(*QUOTE_MARKS)
    closed = last | mark | F.col("after").isin(*AFTER_ADDRESS)
    ends = last | mark | F.col("after").isin(".", "!", "?")
    name = (F.col("prop") == "PROP") & ((F.col("i") <= F.col("opening")) | led | comma)
    described = (F.col("prop") == "NOM") & ~F.col("w").isin(*DETERMINERS) & (led | (comma & ends))
    return rows.where(closed & (name | described)).select("book", "qi", "coref").distinct()


def quote_records(corpus: Corpus) -> DataFrame:
    """Quotes with their words, verb of speech, how it was found, adverbs and persons addressed by name."""
    verbs = speech_verbs(corpus)
    adverbs = speech_adverbs(corpus, verbs).groupBy("book", "qi").agg(F.sort_array(F.collect_set("adverb")).alias("adverbs"))
    named = vocatives(corpus).groupBy("book", "qi").agg(F.sort_array(F.collect_set("coref")).alias("vocatives"))
    words = corpus.quote.select("book", "qi", F.explode(F.sequence("start", "end")).alias("i")).join(corpus.token.where("isword").select("book", "i"), ["book", "i"]).groupBy("book", "qi").agg(F.count("*").alias("words"))
    out = corpus.quote
    for part in (words, verbs, adverbs, named):
        out = out.join(part, ["book", "qi"], "left")
    return out.na.fill(0, ["words"])


def conversations(corpus: Corpus, gap: int = 60) -> DataFrame:
    """(book, qi, conv): quotes with at most ``gap`` words of narration between them are one conversation."""
    from pyspark.sql.window import Window as W

    silent = corpus.token.join(spoken(corpus).select("book", "i"), ["book", "i"], "left_anti").where("isword").select("book", "i")
    marks = corpus.quote.select("book", F.col("start").alias("i"), "qi").unionByName(silent.withColumn("qi", F.lit(None).cast("long")))
    order = W.partitionBy("book").orderBy("i")
    told = marks.withColumn("told", F.sum(F.col("qi").isNull().cast("int")).over(order)).where("qi is not null")
    new = F.coalesce(F.col("told") - F.lag("told").over(order) > gap, F.lit(True))
    return told.withColumn("conv", F.sum(new.cast("int")).over(order) - 1).select("book", "qi", "conv")


# Words that open a chapter's heading, numerals, a signature such as "G. K. C.", and
# marks at a paragraph's end that are none of a heading.
HEADING_WORDS = "chapter|book|part|adventure|story|section|canto|volume|act|scene|prologue|epilogue|introduction|preface"
NUMERAL = r"(?:[ivxlcdm]+|\d+)[.:)]?(?:\s|$)"
SIGNATURE = r"^(?:[A-Z]\.\s*)+[A-Z'’-]*\.?$"
CLOSING = ".?!,;:\"'”’"


def headings(corpus: Corpus, longest: int = 12, numbered: bool = True, caps: bool = True, short: bool = False) -> DataFrame:
    """(book, para, s, e, text): paragraphs that look like headings: at most ``longest`` words, not beginning with a
    quotation mark, and a heading word or numeral at their beginning, or capitals only (three letters
    or more, no signature), or, if ``short`` is asked for, at most ten words without a closing mark."""
    order = F.array_sort(F.collect_list(F.struct("i", "word")))
    rows = corpus.token.groupBy("book", "para").agg(F.min("i").alias("s"), F.max("i").alias("e"), F.sum(F.col("pos").isin("PUNCT", "SPACE", "SYM").cast("int")).alias("others"), F.count("*").alias("n"), order.alias("ws"))
    rows = rows.withColumn("words", F.col("n") - F.col("others")).where((F.col("words") > 0) & (F.col("words") <= longest) & ~F.col("ws")[0]["word"].isin(*QUOTE_MARKS))
    rows = rows.withColumn("text", F.array_join(F.transform("ws", lambda x: x["word"]), " "))
    plain = F.trim(F.regexp_replace("text", r"\s+(?=[.,:;!?)'’])", ""))
    letters = F.regexp_replace(plain, r"[^\p{L}]", "")
    rules = [F.lit(False)]
    if numbered:
        rules.append(F.lower(plain).rlike(rf"^(?:(?:{HEADING_WORDS})\b|{NUMERAL})"))
    if caps:
        rules.append((F.length(letters) >= 3) & letters.rlike(r"^\p{Lu}+$") & ~plain.rlike(SIGNATURE))
    if short:
        rules.append((F.col("words") <= 10) & ~F.substring(plain, -1, 1).isin(*CLOSING))
    found = rules[0]
    for rule in rules[1:]:
        found = found | rule
    return rows.where(found).select("book", "para", "s", "e", "text")


def chapters(corpus: Corpus, longest: int = 12, min_words: int = 0, **rules) -> DataFrame:
    """(book, seg, label, s, e): from a heading (several in a row are one) to the next; a heading with less than
    ``min_words`` words since the last one that counts is passed over; a book with fewer than two
    headings is one segment."""
    from pyspark.sql.window import Window as W

    order = W.partitionBy("book").orderBy("para")
    rows = headings(corpus, longest, **rules)
    first = rows.withColumn("new", F.coalesce(F.col("s") != F.lag("e").over(order) + 1, F.lit(True))).withColumn("run", F.sum(F.col("new").cast("int")).over(order))
    starts = first.groupBy("book", "run").agg(F.min("s").alias("s"), F.max("e").alias("h_end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "text"))), lambda x: x["text"]), " ").alias("label"))
    if min_words > 0:
        before = corpus.token.withColumn("w", F.sum(F.col("isword").cast("long")).over(W.partitionBy("book").orderBy("i"))).select("book", "i", "w", "isword")
        at = lambda c, name: before.select("book", F.col("i").alias(c), (F.col("w") - (F.col("isword").cast("int") if c == "s" else 0)).alias(name))
        starts = starts.join(at("s", "w_s"), ["book", "s"]).join(at("h_end", "w_e"), ["book", "h_end"])
        heads_ = starts.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("s", "run", "w_s", "w_e"))).alias("heads"))
        fold = lambda kept, h: F.when((F.size(kept) > 0) & (h["w_s"] - F.element_at(kept, -1)["w_e"] < min_words), kept).otherwise(F.concat(kept, F.array(h)))
        some = heads_.select("book", F.explode(F.aggregate("heads", F.slice("heads", 1, 0), fold)).alias("h")).select("book", F.col("h.run").alias("run"))
        starts = starts.join(some, ["book", "run"], "left_semi").drop("w_s", "w_e")
        starts = starts.withColumn("run", F.row_number().over(W.partitionBy("book").orderBy("s")))
    by_run = W.partitionBy("book").orderBy("run")
    sizes = corpus.sizes.select("book", "n_tokens")
    ends = starts.join(sizes, "book").withColumn("e", F.coalesce(F.lead("s").over(by_run), F.col("n_tokens")) - 1).withColumn("k", F.count("*").over(W.partitionBy("book")))
    several = ends.where("k >= 2").select("book", (F.col("run") - 1).cast("long").alias("seg"), "label", "s", "e")
    single = sizes.join(several.select("book").distinct(), "book", "left_anti").select("book", F.lit(0).cast("long").alias("seg"), F.lit("").alias("label"), F.lit(0).cast("long").alias("s"), (F.col("n_tokens") - 1).alias("e"))
    return several.unionByName(single)


def evidence(corpus: Corpus, relations_: DataFrame, members: DataFrame, rel: str, item: str, limit: int = 150) -> tuple[int, DataFrame]:
    """How many mentions stand behind an item of a relation, and the first sentences of them."""
    found = relations_.where((F.col("rel") == rel) & (F.col("item") == item)).join(members, ["book", "coref"], "left_semi")
    total = found.count()
    at = found.join(corpus.mention.select("book", "mi", "start"), ["book", "mi"]).orderBy("book", "coref", "start").limit(limit)
    where = at.join(corpus.token.select("book", F.col("i").alias("start"), "sent"), ["book", "start"])
    spans = where.join(corpus.spans("sent"), ["book", "sent"]).select("book", F.col("mi").alias("id"), "s", "e")
    return total, span_text(corpus, spans)
