"""The registered queries over the supplied tables, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import corpus, dialogue, entities, narrative, network, pattern, topics
from ..sources import relations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return relations.spread(df.select("doc_id", "text", "lang", "source")) if name == "documents" else df


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def words(spark, sf_dir, *carry) -> DataFrame:
    return relations.words(table(spark, sf_dir, "documents"), *carry)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles to six places, without a negative zero, so that both engines agree."""
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Pieces of SQL that the queries share.
_WORDS = "w AS (SELECT doc_id AS book, lang, source, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS ws FROM documents)"
_STREAM = _WORDS + ", s AS (SELECT book, lang, source, len(ws) AS total, unnest(range(0, len(ws))) AS i, unnest(ws) AS word FROM w)"
_D10 = "round(greatest(0.0, 1 - sqrt(greatest(0.0, {ss} / 10.0 - ({n} / 10.0) * ({n} / 10.0))) / ({n} / 10.0) / 3.0), 6)"


@query(f"""WITH {_STREAM}, sizes AS (SELECT book, len(ws) AS n FROM w), base AS (SELECT book, coalesce(sum(n) OVER (ORDER BY book ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM sizes),
t AS (SELECT sum(n) AS total FROM sizes), c AS (SELECT word, s.book, least(9, floor(10 * (base + i) / t.total)) AS tenth FROM s JOIN base ON s.book = base.book, t),
p AS (SELECT word, tenth, count(*) AS n FROM c GROUP BY ALL), q AS (SELECT word, sum(n) AS n, sum(n * n) AS ss FROM p GROUP BY word), r AS (SELECT word, count(DISTINCT book) AS range FROM c GROUP BY word)
SELECT row_number() OVER (ORDER BY n DESC, q.word)::INTEGER AS rank, q.word, n::BIGINT AS n, round(n * 1000.0 / t.total, 6) AS per1k, range, {_D10.format(ss='ss', n='n')} AS d
FROM q JOIN r ON q.word = r.word, t ORDER BY n DESC, q.word LIMIT 5000""")
def wordlist(spark, sf_dir):
    return rounded(corpus.wordlist(words(spark, sf_dir)))


@query(f"WITH {_STREAM} SELECT lang, word, n FROM (SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS k FROM s GROUP BY lang, word) WHERE k <= 50")
def wordlist_by_lang(spark, sf_dir):
    from pyspark.sql.window import Window as W

    counts = relations.stream(words(spark, sf_dir, "lang"), "lang").groupBy("lang", "word").agg(F.count("*").alias("n"))
    return counts.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), "word"))).where("k <= 50").drop("k")


@query(r"""WITH t AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) AS t FROM documents)
SELECT CASE WHEN regexp_full_match(t, '\p{N}+') THEN 'number' WHEN regexp_matches(t, '^[\p{L}\p{N}]') THEN 'word' ELSE 'mark' END AS kind, count(*) AS n FROM t GROUP BY 1""")
def filter_options(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select(F.explode(relations.token_array(F.col("text"))).alias("t"))
    kind = F.when(F.col("t").rlike(r"^\p{N}+$"), "number").when(F.col("t").rlike(r"^[\p{L}\p{N}]"), "word").otherwise("mark")
    return t.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def _ngram_sql(relation: str, n_min: int, n_max: int, extra: str = "true", min_freq: int = 3, min_range: int = 1) -> str:
    parts = " UNION ALL ".join(f"SELECT book, array_to_string(g, ' ') AS gram FROM (SELECT book, unnest(list_transform(range(1, greatest(1, len(ws) - {n - 1} + 1)), lambda k: ws[k : k + {n - 1}])) AS g FROM {relation}) WHERE {extra}" for n in range(n_min, n_max + 1))
    return f"g AS ({parts}) SELECT gram, count(*) AS n, count(DISTINCT book) AS range FROM g GROUP BY gram HAVING count(*) >= {min_freq} AND count(DISTINCT book) >= {min_range} ORDER BY n DESC, gram LIMIT 5000"


@query(f"WITH {_WORDS}, {_ngram_sql('w', 2, 3, min_range=2)}")
def ngrams_2_3(spark, sf_dir):
    return corpus.ngrams(words(spark, sf_dir), 2, 3, min_range=2)


@query(f"WITH {_WORDS}, {_ngram_sql('w', 2, 2, extra="g[1] = 'the'")}")
def ngrams_contains_left(spark, sf_dir):
    return corpus.ngrams(words(spark, sf_dir), 2, 2, contains="the", position="left")


_SENT = r"""toks AS (SELECT doc_id AS book, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]') AS ts FROM documents),
tok AS (SELECT book, unnest(range(0, len(ts))) AS i, unnest(ts) AS t FROM toks),
tsent AS (SELECT book, i, t, coalesce(sum((t IN ('.', '!', '?'))::INT) OVER (PARTITION BY book ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM tok),
sents AS (SELECT book, sent, coalesce(list(t ORDER BY i) FILTER (regexp_matches(t, '^[\p{L}\p{N}]')), []) AS ws, max(CASE WHEN t IN ('.', '!', '?') THEN t END) AS mark FROM tsent GROUP BY book, sent)"""


@query(f"WITH {_SENT}, {_ngram_sql('sents', 2, 2)}")
def ngrams_sentence(spark, sf_dir):
    return corpus.ngrams(relations.sentences(table(spark, sf_dir, "documents")), 2, 2)


def _tion(w):
    return w.startswith("tion")


_KWIC = f"{_WORDS}, h AS (SELECT book, ws, unnest(list_filter(range(0, len(ws)), lambda k: starts_with(ws[k + 1], 'tion'))) AS i FROM w), k AS (SELECT book, i::INTEGER AS i, ws[i + 1] AS node, ws[greatest(0, i - 5) + 1 : i] AS l, ws[i + 2 : i + 6] AS r FROM h)"


@query(f"WITH {_KWIC} SELECT book, i, node, array_to_string(l, ' ') AS before, array_to_string(r, ' ') AS after FROM k ORDER BY book, i LIMIT 20000")
def kwic_hits(spark, sf_dir):
    lines = corpus.kwic(words(spark, sf_dir), _tion)
    return lines.select("book", "i", "node", F.array_join("left", " ").alias("before"), F.array_join("right", " ").alias("after"))


@query(f"WITH {_KWIC} SELECT row_number() OVER (ORDER BY coalesce(r[1], ''), coalesce(l[-1], '') DESC, node, book, i)::INTEGER AS rank, book, i, node FROM (SELECT * FROM k ORDER BY book, i LIMIT 20000)")
def kwic_sorted(spark, sf_dir):
    return corpus.sort_kwic(corpus.kwic(words(spark, sf_dir), _tion), [("R1", False), ("L1", True), ("key", False)]).select("rank", "book", "i", "node")


@query(f"WITH {_KWIC} SELECT book, i, node FROM k WHERE list_contains(l[-3:], 'the') OR list_contains(r[1:3], 'the') ORDER BY book, i LIMIT 20000")
def kwic_near(spark, sf_dir):
    return corpus.kwic(words(spark, sf_dir), _tion, near="the", near_span=3).select("book", "i", "node")


@query(f"WITH {_KWIC} SELECT book, i, node FROM k WHERE (list_contains(l, 'the') OR list_contains(r, 'the')) AND NOT (list_contains(l, 'of') OR list_contains(r, 'of')) ORDER BY book, i LIMIT 20000")
def kwic_context(spark, sf_dir):
    return corpus.kwic(words(spark, sf_dir), _tion, need="the", lack="of").select("book", "i", "node")


@query(f"""WITH {_STREAM}, h AS (SELECT book, total, least(9, floor(10 * i / total)) AS part FROM s WHERE starts_with(word, 'tion')), c AS (SELECT book, total, part, count(*) AS n FROM h GROUP BY ALL),
a AS (SELECT book, total, sum(n) AS hits, sum(n * n) AS ss FROM c GROUP BY ALL) SELECT book, hits::BIGINT AS hits, total AS words, round(hits * 1000.0 / total, 6) AS per1k, {_D10.format(ss='ss', n='hits')} AS d FROM a""")
def kwic_by_book(spark, sf_dir):
    return rounded(corpus.kwic_by_book(words(spark, sf_dir), _tion)[0])


@query(f"WITH {_STREAM} SELECT book, least(199, floor(200 * i / total))::INTEGER AS bin, count(*) AS n FROM s WHERE starts_with(word, 'tion') GROUP BY ALL")
def kwic_plot(spark, sf_dir):
    return corpus.kwic_by_book(words(spark, sf_dir), _tion)[1]


@query(f"""WITH {_STREAM}, n AS (SELECT book, i, word, lead(word, 1) OVER (PARTITION BY book ORDER BY i) AS w1, lead(word, 2) OVER (PARTITION BY book ORDER BY i) AS w2 FROM s),
m AS (SELECT book, i, CASE WHEN w2 = 'and' AND w1 <> 'of' THEN i + 3 WHEN w1 = 'and' THEN i + 2 END AS e FROM n WHERE word = 'the'),
f AS (SELECT book, i, e, lag(e) OVER (PARTITION BY book ORDER BY i) AS before FROM m WHERE e IS NOT NULL) SELECT book, i::INTEGER AS i, e::INTEGER AS "end" FROM f WHERE before IS NULL OR before <= i""")
def pattern_search(spark, sf_dir):
    return pattern.search(relations.stream(words(spark, sf_dir)), '[word="the"] [word!="of"]? "and"')


@query(f"""WITH {_WORDS}, h AS (SELECT book, ws, unnest(list_filter(range(1, len(ws) + 1), lambda k: ws[k] = 'the')) AS k FROM w),
c AS (SELECT book, unnest(ws[greatest(1, k - 5) : k - 1]) AS word, 0 AS side FROM h UNION ALL SELECT book, unnest(ws[k + 1 : k + 5]), 1 FROM h),
o AS (SELECT word, count(*) AS o, count(*) - sum(side) AS l, sum(side) AS r, count(DISTINCT book) AS range FROM c GROUP BY word HAVING count(*) >= 3),
t AS (SELECT (SELECT count(*) FROM h) AS hits, (SELECT sum(len(ws)) FROM w) AS n, (SELECT count(*) FROM c) AS win), f AS (SELECT word, count(*) AS fc FROM (SELECT unnest(ws) AS word FROM w) GROUP BY word),
x AS (SELECT o.*, fc, hits, n::DOUBLE AS n, win::DOUBLE AS win, hits * fc * 10.0 / n AS e, o::DOUBLE AS a, win - o::DOUBLE AS b, greatest(fc - o, 0)::DOUBLE AS c, n - win - greatest(fc - o, 0)::DOUBLE AS d FROM o JOIN f ON o.word = f.word, t),
y AS (SELECT *, (a + b) * (a + c) / n AS e1, (a + b) * (b + d) / n AS e2, (c + d) * (a + c) / n AS e3, (c + d) * (b + d) / n AS e4 FROM x)
SELECT word, o, l::BIGINT AS l, r::BIGINT AS r, range, fc, round(e, 6) AS e, round(log2(o / e), 6) AS mi, round(log2(o::DOUBLE * o * o / e), 6) AS mi3, round((o - e) / sqrt(o), 6) AS t, round(14 + log2(2.0 * o / (hits + fc)), 6) AS log_dice,
round(CASE WHEN a >= e1 THEN 1 ELSE -1 END * greatest(0, 2 * (CASE WHEN a > 0 THEN a * ln(a / e1) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b / e2) ELSE 0 END + CASE WHEN c > 0 THEN c * ln(c / e3) ELSE 0 END + CASE WHEN d > 0 THEN d * ln(d / e4) ELSE 0 END)), 3) AS ll FROM y""")
def collocates(spark, sf_dir):
    found = corpus.collocates(words(spark, sf_dir), lambda w: w == "the", limit=1_000_000)
    return rounded(found).withColumn("ll", F.round("ll", 3) + F.lit(0.0))


def _keyness_sql(target: str, where: str) -> str:
    return f"""WITH {_STREAM}, k AS (SELECT word AS item, count(*) FILTER ({target}) AS a, count(*) FILTER (NOT ({target})) AS b FROM s GROUP BY word),
t AS (SELECT sum(a) AS c, sum(b) AS d FROM k), x AS (SELECT item, a, b, a::DOUBLE AS fa, b::DOUBLE AS fb, c::DOUBLE AS c, d::DOUBLE AS d FROM k, t WHERE a >= 3),
y AS (SELECT *, c * (fa + fb) / (c + d) AS ea, d * (fa + fb) / (c + d) AS eb, CASE WHEN a = 0 OR b = 0 OR c - a = 0 OR d - b = 0 THEN 0.5 ELSE 0 END AS h FROM x),
z AS (SELECT item, a, b, CASE WHEN fa / c >= fb / d THEN 1.0 ELSE -1.0 END AS sg, 2 * (CASE WHEN a > 0 THEN a * ln(a / ea) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b / eb) ELSE 0 END) AS g,
(c + d) * (fa * (d - fb) - fb * (c - fa)) ** 2 / ((fa + fb) * (c + d - fa - fb) * c * d) AS x2, log2((CASE WHEN a > 0 THEN fa ELSE 0.5 END / c) / (CASE WHEN b > 0 THEN fb ELSE 0.5 END / d)) AS lr,
(CASE WHEN a > 0 THEN fa ELSE 0.5 END / c / (CASE WHEN b > 0 THEN fb ELSE 0.5 END / d) - 1) * 100 AS pd, (fa + h) * (d - fb + h) / ((fb + h) * (c - fa + h)) AS od FROM y)
SELECT item, a, b, round(sg * greatest(0, g), 5) AS ll, round(sg * x2, 5) AS chi2, round(lr, 6) AS log_ratio, round(pd, 5) AS pct_diff, round(od, 5) AS odds FROM z {where}"""


def _keyness(df: DataFrame) -> DataFrame:
    return df.select("item", "a", "b", *[(F.round(c, n) + F.lit(0.0)).alias(c) for c, n in (("ll", 5), ("chi2", 5), ("log_ratio", 6), ("pct_diff", 5), ("odds", 5))])


@query(_keyness_sql("coalesce(lang = 'de', false)", ""))
def keyness_all(spark, sf_dir):
    s = relations.stream(words(spark, sf_dir, "lang"), "lang")
    german = F.coalesce(F.col("lang") == "de", F.lit(False))
    both = s.groupBy(F.col("word").alias("item")).agg(F.count_if(german).alias("a"), F.count_if(~german).alias("b"))
    return _keyness(stats.keyness_of(both, direction="both", show_all=True).where("a >= 3"))


@query(f"""WITH {_STREAM}, top AS (SELECT word FROM s GROUP BY word ORDER BY count(*) DESC, word LIMIT 200), t AS (SELECT lang, count(*)::DOUBLE AS t FROM s GROUP BY lang), a AS (SELECT sum(t) AS a FROM t),
n AS (SELECT word, lang, count(*) AS n FROM s WHERE word IN (SELECT word FROM top) GROUP BY ALL), g AS (SELECT top.word, t.lang, t.t, coalesce(n, 0) AS n FROM top CROSS JOIN t LEFT JOIN n ON n.word = top.word AND n.lang = t.lang),
e AS (SELECT *, sum(n) OVER (PARTITION BY word)::DOUBLE AS f, a, t * sum(n) OVER (PARTITION BY word) / a AS e FROM g, a),
c AS (SELECT *, (n - e) ** 2 / e + (t - n - (t - e)) ** 2 / (t - e) AS chi FROM e)
SELECT word AS item, lang AS part, n, round((n - e) / sqrt(e * (1 - f / a) * (1 - t / a)), 5) AS residual, round(sum(chi) OVER (PARTITION BY word), 4) AS chi2, 3 AS df, round(sqrt(sum(chi) OVER (PARTITION BY word) / a), 6) AS cramer_v FROM c""")
def across_langs(spark, sf_dir):
    s = relations.stream(words(spark, sf_dir, "lang"), "lang").cache()
    top = s.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(200).select("word")
    counts = s.join(F.broadcast(top), "word").groupBy(F.col("word").alias("item"), F.col("lang").alias("part")).agg(F.count("*").alias("n"))
    out = stats.across(counts, s.groupBy(F.col("lang").alias("part")).agg(F.count("*").alias("n")))
    return out.select("item", "part", "n", (F.round("residual", 5) + F.lit(0.0)).alias("residual"), F.round("chi2", 4).alias("chi2"), "df", F.round("cramer_v", 6).alias("cramer_v"))


@query(f"""WITH {_STREAM}, l AS (SELECT book, total AS n, i, coalesce(lag(i) OVER (PARTITION BY book, word ORDER BY i), -1) AS p FROM s),
f AS (SELECT book, n, sum(greatest(0, least(i, n - 100) - greatest(p + 1, i - 99, 0) + 1)) AS firsts, sum((p < 0)::INT) AS types FROM l GROUP BY ALL)
SELECT book, n::INTEGER AS n, round(CASE WHEN n >= 100 THEN firsts / ((n - 99) * 100) ELSE types / n END, 6) AS mattr, n >= 100 AS reliable FROM f""")
def mattr_by_book(spark, sf_dir):
    return rounded(narrative.mattr(words(spark, sf_dir)))


@query(f"""WITH {_STREAM}, {_SENT}, x AS (SELECT book, word, length(word) AS len, len(regexp_extract_all(word, '[aeiouy]+')) AS g, regexp_matches(word, 'e$') AND NOT regexp_matches(word, '[le]e$') AS silent FROM s),
y AS (SELECT book, word, count(*) AS n, sum(len) AS len, sum(greatest(1, g - (silent AND g > 1)::INT)) AS syl FROM x GROUP BY ALL),
a AS (SELECT book, sum(n) AS words, count(*) AS types, count(*) FILTER (n = 1) AS hapax, sum(len) AS letters, sum(syl) AS syllables FROM y GROUP BY book),
b AS (SELECT book, count(*) AS sentences, avg(len(ws)) AS m, stddev_pop(len(ws)) AS sd, avg(CASE WHEN mark = '?' THEN 1.0 WHEN mark IS NOT NULL THEN 0.0 END) AS q, list_sort(list(len(ws))) AS ls FROM sents WHERE len(ws) > 0 GROUP BY book)
SELECT a.book, words::BIGINT AS words, types, hapax, round(letters / words, 6) AS word_len, sentences, round(m, 6) AS sent_mean, round(sd, 6) AS sent_sd, ls[len(ls) // 2 + 1]::INTEGER AS sent_median, round(coalesce(q, 0), 6) AS questions,
round(206.835 - 1.015 * (words / sentences) - 84.6 * (syllables / words), 6) AS flesch, round(0.39 * (words / sentences) + 11.8 * (syllables / words) - 15.59, 6) AS grade FROM a JOIN b ON a.book = b.book""")
def style_by_book(spark, sf_dir):
    return rounded(narrative.style(words(spark, sf_dir), relations.sentences(table(spark, sf_dir, "documents"))))


# ---- narrative


@query(f"WITH {_WORDS} SELECT book, seg, floor(seg * len(ws) / 10)::BIGINT AS start, floor((seg + 1) * len(ws) / 10)::BIGINT AS \"end\" FROM w, (SELECT unnest(range(0, 10))::INTEGER AS seg)")
def segments_slices(spark, sf_dir):
    return narrative.slices(words(spark, sf_dir), 10)


@query(f"WITH {_WORDS}, t AS (SELECT sum(len(ws)) AS total FROM w) SELECT book, len(ws) AS words, greatest(1, round_even(len(ws) * 400.0::DOUBLE / total, 0))::BIGINT AS slices FROM w, t")
def segments_share(spark, sf_dir):
    return narrative.proportional(words(spark, sf_dir), 400)


# A small lexicon of categories and valences for the synthetic vocabulary.
_LEXICON = (("the", "article"), ("an", "article"), ("of", "link"), ("and", "link"), ("in", "place"), ("on", "place"), ("der", "article"), ("und", "link"), ("le", "article"), ("et", "link"))
_VALENCE = (("the", 0.5), ("and", 1.0), ("of", -0.5), ("is", -1.5), ("und", 1.0), ("ist", -1.0), ("et", 1.0), ("est", -1.0))


@query(f"""WITH {_STREAM}, x(word, category) AS (VALUES {", ".join(map(str, _LEXICON))}), g AS (SELECT book, word, floor((10 * (i + 1) - 1) / total)::INTEGER AS seg FROM s),
n AS (SELECT book, seg, count(*) AS words FROM g GROUP BY ALL), h AS (SELECT book, seg, category, count(*) AS hits FROM g JOIN x ON g.word = x.word GROUP BY ALL)
SELECT h.book, h.seg, category, hits, words, round(hits * 1000.0 / words, 6) AS per1k FROM h JOIN n ON h.book = n.book AND h.seg = n.seg""")
def emotion_arc(spark, sf_dir):
    lexicon = spark.createDataFrame(list(_LEXICON), "word string, category string")
    return rounded(narrative.lexicon_arc(words(spark, sf_dir), lexicon))


@query(f"""WITH {_SENT}, x(word, valence) AS (VALUES {", ".join(map(str, _VALENCE))}), u AS (SELECT book, sent, unnest(ws) AS word FROM sents), v AS (SELECT book, sent, sum(valence::DOUBLE) AS s FROM u JOIN x ON u.word = x.word GROUP BY ALL),
l AS (SELECT book, max(sent) + 1 AS total FROM sents GROUP BY book), r AS (SELECT sents.book, floor((10 * (sents.sent + 1) - 1) / total)::INTEGER AS seg, coalesce(s / sqrt(s * s + 15), 0) AS score FROM sents JOIN l ON l.book = sents.book LEFT JOIN v ON v.book = sents.book AND v.sent = sents.sent)
SELECT book, seg, count(*) AS sentences, round(avg(score), 6) + 0.0 AS mean, round(avg((score >= 0.05)::INT), 6) AS positive, round(avg((score <= -0.05)::INT), 6) AS negative FROM r GROUP BY ALL""")
def sentiment_arc(spark, sf_dir):
    valence = spark.createDataFrame(list(_VALENCE), "word string, valence double")
    return rounded(narrative.sentiment_arc(relations.sentences(table(spark, sf_dir, "documents")), valence))


_Z = f"""{_STREAM}, n AS (SELECT source AS text, word, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT text, sum(n) AS total FROM n GROUP BY text), top AS (SELECT word FROM n GROUP BY word ORDER BY sum(n) DESC, word LIMIT 100),
f AS (SELECT t.text, top.word, coalesce(n, 0)::DOUBLE / total AS f FROM t CROSS JOIN top LEFT JOIN n ON n.text = t.text AND n.word = top.word),
z AS (SELECT text, word, coalesce((f - avg(f) OVER (PARTITION BY word)) / nullif(stddev_pop(f) OVER (PARTITION BY word), 0), 0) AS z FROM f)"""


def _by_source(spark, sf_dir):
    return relations.stream(words(spark, sf_dir, "source"), "source").groupBy(F.col("source").alias("text"), "word").agg(F.count("*").alias("n"))


@query(f"WITH {_Z} SELECT text, word, round(z, 6) + 0.0 AS z FROM z")
def stylometry_z(spark, sf_dir):
    return rounded(narrative.z_scores(_by_source(spark, sf_dir)))


@query(f"""WITH {_Z} SELECT a.text AS a, b.text AS b, round(avg(abs(a.z - b.z)), 6) AS classic, round(1 - sum(a.z * b.z) / sqrt(sum(a.z * a.z) * sum(b.z * b.z)), 6) AS cosine, round(sqrt(sum((a.z - b.z) ** 2)), 6) AS euclidean
FROM z a JOIN z b ON a.word = b.word AND a.text < b.text GROUP BY a.text, b.text""")
def stylometry_deltas(spark, sf_dir):
    return rounded(narrative.deltas(narrative.z_scores(_by_source(spark, sf_dir))))


# ---- dialogue, with conversations as books and roles as speakers


def _quotes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("ord"), F.col("role").alias("speaker"), "text")


_ADDR = """q AS (SELECT conv_id AS book, turn AS ord, role AS speaker, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
n AS (SELECT *, coalesce(speaker <> before, true) AS new FROM q), r AS (SELECT *, sum(new::INT) OVER (PARTITION BY book ORDER BY ord) AS run FROM n),
f AS (SELECT book, run, min(before) FILTER (new) AS prev, min(speaker) AS who FROM r GROUP BY book, run),
a AS (SELECT r.book, r.ord, r.speaker, r.new, r.run, CASE WHEN r.run > 1 THEN f.prev ELSE g.who END AS addressee FROM r JOIN f ON f.book = r.book AND f.run = r.run LEFT JOIN f g ON g.book = r.book AND g.run = r.run + 1),
m AS (SELECT book, ord, speaker, addressee, CASE WHEN addressee IS NULL THEN NULL WHEN NOT new THEN 'continues' WHEN run > 1 THEN 'reply' ELSE 'next' END AS method FROM a)"""


@query(f"WITH {_ADDR} SELECT * FROM m")
def addressees(spark, sf_dir):
    return dialogue.addressees(_quotes(spark, sf_dir)).select("book", "ord", "speaker", "addressee", "method")


@query(f"WITH {_ADDR} SELECT speaker, addressee, count(*) AS quotes FROM m WHERE method IS NOT NULL GROUP BY ALL")
def addressee_edges(spark, sf_dir):
    return dialogue.addressee_edges(dialogue.addressees(_quotes(spark, sf_dir)))


@query(r"""WITH q AS (SELECT role AS speaker, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM conversations),
x AS (SELECT *, len(ws) AS n, len(list_filter(ws, lambda w: w IN ('i', 'me', 'my'))) AS f, len(list_filter(ws, lambda w: w IN ('you', 'your'))) AS s, len(list_filter(ws, lambda w: w IN ('we', 'us', 'our'))) AS p, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS l FROM q)
SELECT speaker, count(*) AS quotes, sum(n)::BIGINT AS words, round(avg(n), 6) AS mean_words, median(n) AS median_words, round(100.0 * avg((contains(text, '?'))::INT), 6) AS questions, round(100.0 * avg((contains(text, '!') AND NOT contains(text, '?'))::INT), 6) AS exclaims,
round(1000.0 * sum(f) / sum(n), 6) AS first_per1k, round(1000.0 * sum(s) / sum(n), 6) AS second_per1k, round(1000.0 * sum(p) / sum(n), 6) AS plural_per1k, round(sum(l) / sum(n), 6) AS word_len FROM x GROUP BY speaker""")
def speaker_style(spark, sf_dir):
    return rounded(dialogue.style_of_speech(_quotes(spark, sf_dir)))


@query("SELECT role AS speaker, CASE WHEN contains(text, '?') THEN 'question' WHEN contains(text, '!') THEN 'exclaim' ELSE 'statement' END AS kind, count(*) AS n FROM conversations GROUP BY ALL")
def sentence_types(spark, sf_dir):
    return _quotes(spark, sf_dir).groupBy("speaker", dialogue.sentence_type(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query(r"""WITH q AS (SELECT conv_id AS book, turn, role = 'user' AS speech, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS n FROM conversations),
e AS (SELECT *, sum(n) OVER (PARTITION BY book ORDER BY turn) AS e, sum(n) OVER (PARTITION BY book) AS total FROM q), u AS (SELECT book, speech, total, unnest(range((e - n)::BIGINT, e::BIGINT)) AS i FROM e)
SELECT book, least(49, floor(50 * i / total))::INTEGER AS bin, count(*) AS words, round(100.0 * avg(speech::INT), 6) AS speech_pct FROM u GROUP BY ALL""")
def dialogue_curve(spark, sf_dir):
    spans = _quotes(spark, sf_dir).select("book", "ord", (F.col("speaker") == "user").alias("speech"), F.size(relations.word_array(F.col("text"))).alias("n"))
    return rounded(dialogue.curve(spans))


@query("""WITH v AS (SELECT conv_id AS book, turn AS para, CASE WHEN contains(text, '!') OR contains(text, '?') THEN NULL ELSE role END AS unit, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS x FROM conversations),
l AS (SELECT *, lag(unit) OVER w AS bu, lag(x) OVER w AS bx FROM v WHERE unit IS NOT NULL WINDOW w AS (PARTITION BY book ORDER BY para)), r AS (SELECT *, sum((bu IS NULL OR bu <> unit OR x - bx - 1 > 1)::INT) OVER (PARTITION BY book ORDER BY para) AS run FROM l)
SELECT book, unit, min(para) AS first, max(para) AS last, count(*) AS votes FROM r GROUP BY book, run, unit""")
def narrator_runs(spark, sf_dir):
    q = _quotes(spark, sf_dir)
    unit = F.when(dialogue.sentence_type(F.col("text")) == "statement", F.col("speaker"))
    return dialogue.runs(q.select("book", F.col("ord").alias("para"), unit.alias("unit")))


_SESSION = """e AS (SELECT user_id, epoch_us(ts) AS tm, event_id FROM events), d AS (SELECT *, tm - lag(tm) OVER (PARTITION BY user_id ORDER BY tm) AS since FROM e),
s AS (SELECT user_id, tm, coalesce(sum((since > 3600000000)::INT) OVER (PARTITION BY user_id ORDER BY tm), 0) AS session FROM d)"""


@query(f"WITH {_SESSION} SELECT user_id, session::BIGINT AS session, count(*) AS events, max(tm) - min(tm) AS span_us FROM s GROUP BY user_id, session")
def conversations_gap(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    rows = dialogue.sessions(events, F.lit(3_600_000_000), "user_id", "at")
    return rows.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.count("*").alias("events"), (F.max("at") - F.min("at")).alias("span_us"))


# ---- entities and networks, with orders as containers and suppliers as entities

_EDGES = "o AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS e FROM lineitem), g AS (SELECT x.e AS a, y.e AS b, count(*) AS weight FROM o x JOIN o y ON x.c = y.c AND x.e < y.e GROUP BY ALL)"


def _edges(spark, sf_dir):
    return network.edges(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("container")))


@query(f"WITH {_EDGES} SELECT * FROM g")
def network_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


_DEGREE = f"{_EDGES}, u AS (SELECT a AS node, weight FROM g UNION ALL SELECT b, weight FROM g), d AS (SELECT node, count(*) AS degree, sum(weight)::BIGINT AS strength FROM u GROUP BY node)"


@query(f"WITH {_DEGREE} SELECT * FROM d")
def network_degree(spark, sf_dir):
    return network.degrees(_edges(spark, sf_dir))


@query(f"WITH {_DEGREE}, t AS (SELECT node FROM d ORDER BY strength DESC, node LIMIT 20) SELECT g.* FROM g WHERE a IN (SELECT node FROM t) AND b IN (SELECT node FROM t)")
def network_top_nodes(spark, sf_dir):
    return network.strongest(_edges(spark, sf_dir), 20)


@query(f"WITH {_EDGES} SELECT CASE WHEN a = 7 THEN b ELSE a END AS node, weight FROM g WHERE a = 7 OR b = 7 ORDER BY weight DESC, node LIMIT 20")
def focus_neighbours(spark, sf_dir):
    return network.neighbours(_edges(spark, sf_dir), 7)


def network_measures(spark, sf_dir):
    """Centralities of the strongest nodes; the graph that comes to the driver has at most 300 nodes."""
    edges = [tuple(r) for r in network.strongest(_edges(spark, sf_dir), 300).collect()]
    found = network.measures(edges)["nodes"]
    names = ("degree", "strength", "betweenness", "closeness", "eigenvector", "clustering", "component")
    rows = [(int(v), *(round(float(m[n]), 6) for n in names)) for v, m in sorted(found.items())]
    return spark.createDataFrame(rows, "node long, " + ", ".join(f"{n} double" for n in names))


QUERIES["network_measures"] = network_measures


@query("""WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) + 1 AS hi FROM events)
SELECT event_type AS entity, least(99, floor(100 * (epoch_us(ts) - lo) / (hi - lo)))::INTEGER AS bin, count(*) AS n FROM events, b GROUP BY ALL""")
def presence_bins(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("entity"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    ends = events.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    lo, hi = ends["lo"] or 0, (ends["hi"] or 0) + 1
    return entities.presence_bins(events, F.col("at") - lo, F.lit(hi - lo))


_MENTION = "m AS (SELECT l_suppkey AS unit, l_returnflag AS book FROM lineitem), c AS (SELECT unit, book, count(*) AS n FROM m GROUP BY ALL)"


def _mentions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("book"))


@query(f"WITH {_MENTION} SELECT unit, sum(n)::BIGINT AS mentions, count(*) AS books FROM c GROUP BY unit HAVING sum(n) >= 600")
def units_min_combined(spark, sf_dir):
    return entities.units(_mentions(spark, sf_dir), 600)


@query(f"WITH {_MENTION} SELECT unit, sum(n)::BIGINT AS mentions, count(*) AS books FROM c WHERE n >= 150 GROUP BY unit")
def units_min_per_book(spark, sf_dir):
    return entities.units(_mentions(spark, sf_dir), 150, per_book=True)


@query("""WITH c AS (SELECT c_nationkey AS unit, c_mktsegment AS v, count(*) AS n, min(c_custkey) AS f FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY n DESC, f) AS k, sum(n) OVER (PARTITION BY unit)::BIGINT AS total FROM c)
SELECT unit, v AS c_mktsegment, n, total FROM r WHERE k = 1""")
def majority_type(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "unit")
    return entities.top_value(customers, ["unit"], "c_mktsegment", "c_custkey")


@query("""WITH j AS (SELECT p_brand AS item, l_returnflag AS part FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT item, part, count(*) AS n FROM j GROUP BY ALL)
SELECT item, part, n, sum(n) OVER (PARTITION BY item)::BIGINT AS total, round(100.0 * n / sum(n) OVER (PARTITION BY part), 6) AS pct FROM c""")
def by_book(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("item"), F.col("l_returnflag").alias("part"))
    return rounded(entities.by_part(rows, "item", "part"))


@query("SELECT event_type, user_id % 7 AS grp, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (event_type, user_id % 7))")
def type_totals(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 7).alias("grp"))
    return entities.grouping_totals(events, "event_type", "grp")


@query("""WITH p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id AS seen FROM events WHERE event_type = 'view')
SELECT p.user_id, p.event_id, max_by(v.seen, struct_pack(t := v.ts, e := v.seen)) AS seen FROM p LEFT JOIN v ON p.user_id = v.user_id AND v.ts <= p.ts GROUP BY ALL""")
def as_of_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    purchases = events.where("event_type = 'purchase'").drop("event_type")
    views = events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("seen"))
    return entities.as_of(purchases, views, "user_id", "ts", "ts", "seen").select("user_id", "event_id", "seen")


# ---- topics

_CHUNKS = f"""{_WORDS}, k AS (SELECT book, ws, len(ws) AS n, greatest(1, floor(len(ws) / 200) + ((len(ws) - floor(len(ws) / 200) * 200) * 2 >= 200)::INT)::BIGINT AS c FROM w WHERE len(ws) > 0),
u AS (SELECT *, unnest(range(0, c)) AS i FROM k), docs AS (SELECT book || ':' || i AS doc, book, (i * 200)::INTEGER AS start, ws[i * 200 + 1 : CASE WHEN i = c - 1 THEN n ELSE i * 200 + 200 END] AS ws FROM u)"""
_CELLS = f"""{_CHUNKS}, t AS (SELECT count(*) AS total FROM docs), c0 AS (SELECT doc, word, count(*) AS n FROM (SELECT doc, unnest(ws) AS word FROM docs) WHERE length(word) >= 3 GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM c0 GROUP BY word), cells AS (SELECT c0.* FROM c0 JOIN df ON c0.word = df.word, t WHERE df >= 20 AND df <= 0.5 * total)"""


def _chunks(spark, sf_dir):
    return topics.chunks(words(spark, sf_dir), 200)


@query(f"WITH {_CHUNKS} SELECT doc, book, start, len(ws)::INTEGER AS words FROM docs")
def topic_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc", "book", "start", F.size("ws").alias("words"))


@query(f"WITH {_CELLS} SELECT word, count(*) AS df, sum(n)::BIGINT AS n FROM cells GROUP BY word")
def topic_vocabulary(spark, sf_dir):
    return topics.matrix(_chunks(spark, sf_dir), 20, 0.5).groupBy("word").agg(F.count("*").alias("df"), F.sum("n").alias("n"))


def _themes(spark):
    """A fixed table of topics over words, in place of a fitted one, so that figures on it have an oracle."""
    rows = [(t, w, p) for t, ws in enumerate(_THEMES) for w, p in ws]
    return spark.createDataFrame(rows, "topic int, word string, p double")


# Three topics of four words.
_THEMES = (
    (("the", 0.4), ("and", 0.3), ("ing", 0.2), ("her", 0.1)),
    (("der", 0.4), ("und", 0.3), ("ist", 0.2), ("die", 0.1)),
    (("une", 0.4), ("des", 0.3), ("les", 0.2), ("est", 0.1)),
)
_PHI = "phi(topic, word, p) AS (VALUES " + ", ".join(f"({t}, '{w}', {p}::DOUBLE)" for t, ws in enumerate(_THEMES) for w, p in ws) + ")"


@query(f"""WITH {_CHUNKS}, {_PHI}, here AS (SELECT DISTINCT doc, word FROM (SELECT doc, unnest(ws) AS word FROM docs)), h AS (SELECT * FROM here WHERE word IN (SELECT word FROM phi)), d AS (SELECT word, count(*) AS df FROM h GROUP BY word),
n AS (SELECT count(DISTINCT doc)::DOUBLE AS docs FROM here), m AS (SELECT x.word AS a, y.word AS b, count(*) AS both FROM h x JOIN h y ON x.doc = y.doc AND x.word < y.word GROUP BY ALL),
p AS (SELECT x.topic, x.word AS a, y.word AS b FROM phi x JOIN phi y ON x.topic = y.topic AND x.word < y.word), q AS (SELECT p.topic, m.both AS c, da.df AS da, db.df AS db, docs FROM p LEFT JOIN m ON m.a = p.a AND m.b = p.b JOIN d da ON da.word = p.a JOIN d db ON db.word = p.b, n)
SELECT topic, round(avg(CASE WHEN c IS NULL THEN -1.0 WHEN c = docs THEN 1.0 ELSE ln(c / docs * docs * docs / da / db) / -ln(c / docs) END), 6) AS coherence FROM q GROUP BY topic""")
def topic_coherence(spark, sf_dir):
    cells = _chunks(spark, sf_dir).select("doc", F.explode("ws").alias("word")).groupBy("doc", "word").agg(F.count("*").alias("n"))
    return rounded(topics.coherence(cells, _themes(spark)))


@query(f"""WITH {_STREAM}, {_PHI}, t AS (SELECT count(*) AS words FROM s), f AS (SELECT word, count(*)::DOUBLE / any_value(t.words) AS pw FROM s, t GROUP BY word),
r AS (SELECT topic, phi.word, p, 0.6 * ln(p) + 0.4 * ln(p / pw) AS relevance FROM phi JOIN f ON f.word = phi.word)
SELECT topic, word, p, round(relevance, 6) AS relevance, row_number() OVER (PARTITION BY topic ORDER BY relevance DESC, word)::INTEGER AS rank FROM r""")
def topic_relevance(spark, sf_dir):
    counts = corpus.counts(words(spark, sf_dir))
    total = counts.agg(F.sum("n")).first()[0] or 1
    return rounded(topics.relevance(_themes(spark), counts.select("word", (F.col("n") / float(total)).alias("pw"))))


@query(f"""WITH {_CHUNKS}, {_PHI}, l AS (SELECT doc_id, lang FROM documents), c AS (SELECT doc, book, len(ws) AS words, word FROM (SELECT doc, book, ws, unnest(ws) AS word FROM docs)),
g AS (SELECT doc, any_value(book) AS book, any_value(words) AS words, topic, count(*) AS n FROM c JOIN phi ON phi.word = c.word GROUP BY doc, topic), th AS (SELECT doc, book, words, topic, n::DOUBLE / sum(n) OVER (PARTITION BY doc) AS p FROM g),
x AS (SELECT th.*, lang FROM th JOIN l ON l.doc_id = th.book), b AS (SELECT lang, topic, sum(p * words) / sum(words) AS share FROM x GROUP BY ALL), o AS (SELECT topic, sum(p * words) / sum(words) AS overall FROM x GROUP BY topic)
SELECT lang, b.topic, round(share, 6) AS share, round(share / overall, 6) AS ratio FROM b JOIN o ON o.topic = b.topic""")
def topic_shares(spark, sf_dir):
    from pyspark.sql.window import Window as W

    chunks = _chunks(spark, sf_dir)
    hits = chunks.select("doc", F.explode("ws").alias("word")).join(F.broadcast(_themes(spark).select("topic", "word")), "word").groupBy("doc", "topic").agg(F.count("*").alias("n"))
    theta = hits.select("doc", "topic", (F.col("n") / F.sum("n").over(W.partitionBy("doc"))).alias("p"))
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), "lang")
    about = chunks.join(langs, "book").select("doc", F.size("ws").alias("words"), "lang")
    return rounded(topics.shares(theta, about, "lang"))


def topic_lda(spark, sf_dir):
    """Top words of a fitted model; values depend on the seed and the solver, so there is no SQL."""
    cells = topics.matrix(_chunks(spark, sf_dir), 3, 0.5)
    _, phi = topics.fit_lda(cells, topics.vocabulary(cells, None), 6, rounds=80, share=1.0)
    return topics.top_words(phi, 10)


QUERIES["topic_lda"] = topic_lda


# ---- pages, comparison of groups, concordance by batch


@query(r"""WITH t AS (SELECT page_id, regexp_extract_all(lower(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '&[a-z]+;', ' ', 'g')), '[\p{L}\p{N}]+') AS ws FROM pages)
SELECT page_id, len(ws)::INTEGER AS words, len(list_distinct(ws))::INTEGER AS types FROM t""")
def page_words(spark, sf_dir):
    text = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "), "&[a-z]+;", " ")
    return table(spark, sf_dir, "pages").select("page_id", relations.word_array(text).alias("ws")).select("page_id", F.size("ws").alias("words"), F.size(F.array_distinct("ws")).alias("types"))


@query(f"""WITH {_STREAM}, n AS (SELECT book, i, word, lead(word, 1) OVER (PARTITION BY book ORDER BY i) AS w1 FROM s),
m AS (SELECT book, i, CASE WHEN word = 'of' AND w1 = 'the' THEN i + 2 WHEN word IN ('and', 'in') THEN i + 1 END AS e FROM n)
SELECT book, i::INTEGER AS i, e::INTEGER AS "end" FROM m WHERE e IS NOT NULL""")
def batch_query(spark, sf_dir):
    return pattern.search(relations.stream(words(spark, sf_dir)), '"of" "the"\n[word="and|in"]')


@query("""WITH m AS (SELECT l_suppkey AS unit, l_returnflag AS flag, l_orderkey AS o FROM lineitem), g AS (SELECT unit % 4 AS grp, * FROM m)
SELECT grp, count(DISTINCT unit) AS units, count(*) AS mentions, count(DISTINCT o) AS places, round(100.0 * avg((flag = 'R')::INT), 6) AS returned_pct FROM g GROUP BY grp""")
def group_summary(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").withColumn("grp", F.col("l_suppkey") % 4)
    found = m.groupBy("grp").agg(F.countDistinct("l_suppkey").alias("units"), F.count("*").alias("mentions"), F.countDistinct("l_orderkey").alias("places"), (100.0 * F.avg((F.col("l_returnflag") == "R").cast("double"))).alias("returned_pct"))
    return rounded(found)


@query("""WITH j AS (SELECT p_brand AS item, c_mktsegment = 'BUILDING' AS mine FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
k AS (SELECT item, count(*) FILTER (mine)::DOUBLE AS a, count(*) FILTER (NOT mine)::DOUBLE AS b FROM j GROUP BY item), t AS (SELECT sum(a) AS c, sum(b) AS d FROM k)
SELECT item, a::BIGINT AS a, b::BIGINT AS b, round(CASE WHEN a / c >= b / d THEN 1 ELSE -1 END * 2 * (a * ln(a / (c * (a + b) / (c + d))) + b * ln(b / (d * (a + b) / (c + d)))), 5) AS ll FROM k, t""")
def distinctive(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = lines.select(F.col("p_brand").alias("item"), (F.col("c_mktsegment") == "BUILDING").alias("mine"))
    counts = rows.groupBy("item").agg(F.sum(F.col("mine").cast("long")).alias("a"), F.sum((~F.col("mine")).cast("long")).alias("b"))
    totals = counts.agg(F.sum("a").alias("c"), F.sum("b").alias("d"))
    found = counts.crossJoin(F.broadcast(totals))  # one row
    return found.select("item", "a", "b", F.round(stats.compare(F.col("a"), F.col("b"), F.col("c"), F.col("d"))["ll"], 5).alias("ll"))
