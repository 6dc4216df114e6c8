import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexflow.functions import stats
from codexflow.operators import corpus, narrative, network, pattern
from codexflow.sources import relations


def test_p_values():
    assert stats.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_tail(11.070497693516351, 5) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_tail(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-9)
    assert stats.critical(0.05) == pytest.approx(3.841458820694124, abs=1e-9)
    assert stats.chi2_tail(100, 2) == pytest.approx(math.exp(-50))


def test_keyness_keeps_significant_items_of_the_target(spark):
    target = spark.createDataFrame([("a", 50), ("b", 50), ("c", 1)], "item string, n long")
    reference = spark.createDataFrame([("a", 5), ("b", 95), ("d", 100)], "item string, n long")
    rows = stats.keyness(target, reference).collect()
    assert [r.item for r in rows] == ["a"]
    both = {r.item: r for r in stats.keyness(target, reference, direction="both", show_all=True).collect()}
    assert set(both) == {"a", "b", "d"} and both["d"].ll < 0 and both["a"].odds_low < both["a"].odds < both["a"].odds_high
    # a zero count is half a count: 100 * ((0.5 / 101) / (100 / 200) - 1)
    assert both["d"].pct_diff == pytest.approx(100 * (0.5 / 101 / 0.5 - 1)) and both["a"].pct_diff == pytest.approx(100 * (50 / 101 / (5 / 200) - 1))
    assert both["a"].p_ll < 1e-9 and both["b"].p_chi2 == pytest.approx(math.erfc(math.sqrt(abs(both["b"].chi2) / 2)))
    strict = stats.keyness(spark.createDataFrame([("a", 12), ("b", 100)], "item string, n long"), spark.createDataFrame([("a", 3), ("b", 100)], "item string, n long"))
    assert [r.item for r in strict.collect()] == ["a"]


@pytest.mark.parametrize("word, n", [("argue", 1), ("table", 2), ("tree", 1), ("house", 1), ("idea", 2), ("the", 1), ("moorhen", 2), ("blue", 1)])
def test_syllables(spark, word, n):
    from codexflow.operators.narrative import syllables

    assert spark.range(1).select(syllables(F.lit(word))).first()[0] == n


def matches(words, items, at):
    """End of the greedy match by plain backtracking."""
    if not items:
        return at
    item = items[0]
    run = 0
    while run < item.high and at + run < len(words) and all((words[at + run] == c.value) != c.negated for c in item.conditions):
        run += 1
    for n in range(run, item.low - 1, -1):
        end = matches(words, items[1:], at + n)
        if end is not None:
            return end
    return None


@pytest.mark.parametrize("query", ['"a" "b"', '[word="a"]* "b"', '"a" [word!="c"]{1,3} "a"?', '"a"? "b"? "c"'])
def test_patterns_equal_backtracking(spark, query):
    rng = random.Random(3)
    books = [[rng.choice("abc") for _ in range(rng.randint(1, 30))] for _ in range(30)]
    rows = [(b, i, w) for b, words in enumerate(books) for i, w in enumerate(words)]
    tokens = spark.createDataFrame(rows, "book long, i int, word string")
    got = sorted(tuple(r) for r in pattern.search(tokens, query).select("book", "i", "end").collect())
    wanted, items = [], pattern.parse(query)
    for b, words in enumerate(books):
        free = 0
        for i in range(len(words)):
            end = matches(words, items, i)
            if i >= free and end is not None and end > i:
                wanted.append((b, i, end))
                free = end
    assert got == wanted


def test_bad_patterns():
    for text in ("", "[word=]", "[word=a", '[nothing="a"]', '"a"?', '"a"{3,2}', '"a"{11}'):
        with pytest.raises(pattern.PatternError):
            pattern.parse(text)


def test_attributes_and_values(spark):
    rows = [(1, 0, "She", "she", ["PER"], True, None), (1, 1, "said", "say", None, False, "Ann"), (1, 2, "It's", "it", [], False, "Ann"), (1, 3, "a*b", "a*b", ["LOC", "PER"], True, None)]
    tokens = spark.createDataFrame(rows, "book long, i int, word string, lemma string, ent array<string>, event boolean, speaker string")
    find = lambda q, **options: [(r.i, r.end) for r in pattern.search(tokens, q, **options).orderBy("i").collect()]
    assert find("[lemma='say']") == find("[lemma=say]") == find('[LEMMA = "say" & word!=she]') == [(1, 2)]
    assert find("[ent=per]") == [(0, 1), (3, 4)] and find("[ent!=per]") == [(1, 2), (2, 3)]
    assert find("[event=yes]") == find("[event!=no]") == [(0, 1), (3, 4)] and find("[speaker=ann]{2}") == [(1, 3)]
    plain = pattern.Matching(regex=False)
    assert find("[word='s*|it?s']", matching=plain) == [(0, 1), (1, 2), (2, 3)]
    assert find("[word='a*b']", matching=pattern.Matching(False, wildcards=False)) == [(3, 4)]
    assert find("[word=she]", matching=pattern.Matching(case=True)) == [] and find("[lemma=SHE]", matching=pattern.Matching(case=True)) == [(0, 1)]
    assert find("she # it's", simple=True) == [(0, 3)] and find("say", simple=True, match="lemma") == [(1, 2)]
    with pytest.raises(pattern.PatternError):
        find("[dep=x]")


def test_overlapping_hits_are_dropped_from_left_to_right(spark):
    rng = random.Random(12)
    rows = [(b, i, i + rng.randint(1, 6)) for b in range(20) for i in sorted(rng.sample(range(60), 25))]
    kept = []
    for b in range(20):
        free = 0
        for _, i, end in (r for r in rows if r[0] == b):
            if i >= free:
                kept.append((b, i, end))
                free = end
    hits = spark.createDataFrame(rows, "book long, i int, end int")
    assert sorted(map(tuple, pattern.leftmost(hits).collect())) == kept


def test_mattr_equals_brute_force(spark):
    rng = random.Random(4)
    books = [(n, [rng.choice("abcdefgh") for _ in range(size)]) for n, size in enumerate((1, 9, 10, 11, 60))]
    df = spark.createDataFrame(books, "book long, ws array<string>")
    for r in narrative.mattr(df, 10).collect():
        words = books[r.book][1]
        windows = [words[i : i + 10] for i in range(max(1, len(words) - 9))]
        assert r.mattr == pytest.approx(sum(len(set(w)) / len(w) for w in windows) / len(windows))


def test_bases_are_prefix_sums(spark):
    rng = random.Random(5)
    rows = [(k, rng.randint(0, 9)) for k in rng.sample(range(-500, 5000), 200)]
    got = {r.book: r.base for r in relations.bases(spark.createDataFrame(rows, "book long, n long"), buckets=7).collect()}
    total = 0
    for key, n in sorted(rows):
        assert got[key] == total
        total += n


def test_clustering_merges_the_nearest_first():
    points = np.array([0.0, 1.0, 5.0, 5.5, 20.0])
    d = np.abs(points[:, None] - points[None, :])
    for linkage, heights in (("average", [0.5, 1.0, 4.75]), ("complete", [0.5, 1.0, 5.5])):
        got = narrative.cluster(d.copy(), linkage)
        assert [round(h, 6) for _, _, h, _ in got[:3]] == heights and got[-1][3] == 5
    assert [m[:2] for m in narrative.cluster(d.copy(), "ward")[:2]] == [(2, 3), (0, 1)]


def test_measures_of_known_graphs():
    path = network.measures([("a", "b", 1), ("b", "c", 1)])
    assert path["nodes"]["b"]["betweenness"] == 1 and path["nodes"]["a"]["closeness"] == pytest.approx(2 / 3) and path["components"] == 1
    full = network.measures([(a, b, 2) for a, b in itertools.combinations("wxyz", 2)])
    assert full["density"] == 1 and all(n["clustering"] == pytest.approx(1) and n["betweenness"] == 0 for n in full["nodes"].values())


def test_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "One. Two!? x")], "doc_id long, text string")
    w = relations.words(docs)
    assert [r.word for r in corpus.wordlist(w).collect()] == ["one", "two", "x"]
    assert corpus.wordlist(w.where("book < 3")).collect() == []
    got = [(r.sent, r.ws, r.mark) for r in relations.sentences(docs).orderBy("sent").collect()]
    assert got == [(0, ["one"], "."), (1, ["two"], "!"), (2, [], "?"), (3, ["x"], None)]
    assert corpus.ngrams(w, 2, 2, min_freq=1).collect()[0].gram == "one two"
    assert corpus.collocates(w, lambda x: x == "two", min_freq=1).count() == 2
    assert corpus.kwic(w.where(F.lit(False)), lambda x: x == "two").collect() == []


def test_communities_and_graph_files(tmp_path):
    import xml.etree.ElementTree as ET

    cliques = [(f"{g}{a}", f"{g}{b}", 1) for g in "xy" for a, b in itertools.combinations(range(4), 2)] + [("x0", "y0", 1)]
    found = network.communities(cliques)
    assert len(set(found.values())) == 2 and all(found[f"x{k}"] == found["x0"] for k in range(4)) and found["x0"] != found["y1"]
    assert network.modularity(cliques, found) > 0.4 and network.communities([]) == {}
    for kind in ("graphml", "gexf"):
        network.write_graph(cliques, {v: {"community": c} for v, c in found.items()}, str(tmp_path / kind), kind)
        root = ET.parse(tmp_path / kind).getroot()
        assert sum(x.tag.endswith("}edge") for x in root.iter()) == len(cliques) and sum(x.tag.endswith("}node") for x in root.iter()) == 8
