import random

import numpy as np
import pytest

from codexflow.operators import lda, links, topics
from codexflow.streaming import feeds

THEMES = {"sea": ["ship", "wave", "sail", "harbour", "storm", "deck"], "law": ["judge", "court", "verdict", "clerk", "trial", "oath"], "farm": ["field", "plough", "barn", "harvest", "seed", "goat"]}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = []
    for book, words in enumerate(THEMES.values()):
        rows += [(book * 100 + n, [rng.choice(words) for _ in range(60)] + [rng.choice(["thing", "place"]) for _ in range(5)]) for n in range(12)]
    return topics.chunks(spark.createDataFrame(rows, "book long, ws array<string>"), 30)


def test_chunks_merge_short_tails(spark):
    rows = [(1, ["w"] * 70), (2, ["w"] * 80), (3, ["w"] * 5), (4, [])]
    got = topics.chunks(spark.createDataFrame(rows, "book long, ws array<string>"), 30).selectExpr("book", "start", "size(ws) n").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 30), (1, 30, 40), (2, 0, 30), (2, 30, 30), (2, 60, 20), (3, 0, 5)]


def test_factorisation_recovers_the_themes(spark, docs):
    cells = topics.matrix(docs, max_df=0.9).cache()
    vocab = topics.vocabulary(cells)
    theta, phi = topics.fit_nmf(cells, vocab, 3)
    found = [{r.word for r in topics.top_words(phi, 6).where(f"topic = {t}").collect()} for t in range(3)]
    for words in THEMES.values():
        assert max(len(set(words) & f) for f in found) >= 5
    sums = {r[0]: r[1] for r in theta.groupBy("doc").sum("p").collect()}
    assert all(abs(v - 1) < 1e-9 for v in sums.values())
    assert topics.diversity(phi, 6) > 0.8
    assert all(r.coherence > -0.7 for r in topics.coherence(cells, phi, 6).collect())
    share = cells.groupBy("word").agg({"n": "sum"}).selectExpr("word", "`sum(n)` / 1000.0 as pw")
    assert topics.relevance(phi, share, top=3).count() == 9
    with pytest.raises(ValueError):
        topics.fit_nmf(cells, vocab, 3, max_cells=5)


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for n in (1, 2, 4, 5):
        cost = rng.integers(0, 20, (n, n)).astype(float)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n)))
        got = topics.assign(cost)
        assert sorted(got) == list(range(n)) and sum(cost[i, got[i]] for i in range(n)) == best


def test_rank_sum_and_scaling():
    assert topics.mann_whitney([1, 2, 3, 4], [1] * 9) is None
    assert topics.mann_whitney([1, 2, 3, 4, 5], [1, 2, 3, 4, 5]) == pytest.approx(1.0)
    assert topics.mann_whitney(list(range(10)), list(range(20, 30))) < 0.001
    points = np.array([[0.0, 0], [3, 0], [0, 4]])
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    got = topics.mds(d)
    assert np.allclose(np.linalg.norm(got[:, None] - got[None], axis=2), d)


def test_links(spark):
    rows = [("e:a:1", "a", "s", "PER", "Mr. John Smith", "he", 9), ("e:b:4", "b", "s", "PER", "john smith", "he", 5), ("e:b:5", "b", "s", "PER", "Mary Smith", "she", 2), ("e:c:1", "c", "s", "PER", "Jon Smithe", None, 3), ("e:d:1", "d", None, "PER", "John Smith", "he", 3)]
    units = spark.createDataFrame(rows, "unit string, book string, series string, type string, name string, pronouns string, mentions long")
    got = {(r.a, r.b): round(r.score, 3) for r in links.suggest(units).collect()}
    assert got[("e:a:1", "e:b:4")] == 1.0 and ("e:a:1", "e:b:5") not in got and ("e:b:4", "e:b:5") not in got  # .6 - .4 is not over .2
    assert ("e:a:1", "e:c:1") in got and not any("e:d:1" in pair for pair in got)
    assert [r.units for r in links.same_names(units).collect()] == [["e:a:1", "e:b:4", "e:d:1"]]


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    feeds.write(feeds.sessions(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    done = spark.read.schema("user_id long, start timestamp, end timestamp, events long").parquet(str(tmp_path / "out"))
    assert 0 < done.agg({"events": "sum"}).first()[0] <= events.count()


def test_lda_query_does_the_whole_job(spark, monkeypatch):
    from codexflow.plans import relational

    seen, fit = {}, topics.fit_lda

    def spy(cells, vocab, *args, **options):
        theta, phi = fit(cells, vocab, *args, **options | {"rounds": 2})
        seen.update(options, words=vocab.count(), least=cells.groupBy("word").count().agg({"count": "min"}).first()[0], fitted=phi.select("word").distinct().count(), sums=phi.groupBy("topic").sum("p").collect())
        return theta, phi

    monkeypatch.setattr(topics, "fit_lda", spy)
    assert relational.topic_lda(spark, "/root/testdata/sf0.001").count() == 60
    assert seen["rounds"] == 80 and seen["share"] == 1.0 and seen["least"] == 3 and seen["fitted"] == seen["words"] > 500
    assert all(abs(r[1] - 1) < 1e-9 for r in seen["sums"])


def test_network_measures_keep_300_nodes(spark):
    from codexflow.plans import relational

    there = relational.network_degree(spark, "/root/testdata/sf0.01").count()
    assert relational.network_measures(spark, "/root/testdata/sf0.01").count() == min(300, there) > 60


def test_digamma():
    import math

    x = np.array([0.01, 0.2, 1.0, 3.5, 40.0, 1e6])
    slope = np.array([(math.lgamma(v * (1 + 1e-5)) - math.lgamma(v * (1 - 1e-5))) / (2e-5 * v) for v in x])
    assert np.allclose(np.log(lda.exp_digamma(x)), slope, rtol=1e-5, atol=1e-5)


def plain_lda(x, k, seed, rounds, slices):
    """Variational Bayes on a small matrix of counts, a document at a time."""
    draws = [np.random.default_rng([seed, s]).gamma(100.0, 0.01, (len(range(s, x.shape[1], slices)), k)) for s in range(slices)]
    lam = np.array([draws[i % slices][i // slices] for i in range(x.shape[1])])
    gamma = np.ones((len(x), k))
    for n in range(1, rounds + 1):
        beta, sums = lda.exp_digamma(lam) / lda.exp_digamma(lam.sum(axis=0)), np.zeros(lam.shape)
        for d, c in enumerate(x):
            g = np.ones(k) if n <= 10 else gamma[d]
            for _ in range(100):
                e = lda.exp_digamma(g)
                new = 1 / k + e * ((c / (beta @ e)) @ beta)
                change, g = np.abs(new - g).mean(), new
                if change < 1e-3:
                    break
            e = lda.exp_digamma(g)
            sums += np.outer(c / (beta @ e), e) * beta
            gamma[d] = g
        lam = sums + 1 / k
    return gamma / gamma.sum(axis=1, keepdims=True), (lam / lam.sum(axis=0)).T


@pytest.mark.parametrize("most", [lda.BROADCAST, 3])
def test_full_passes_equal_plain_variational_bayes(spark, docs, monkeypatch, most):
    monkeypatch.setattr(lda, "PART", (200, 8_000_000))
    monkeypatch.setattr(lda, "SLICE", (5, 2_000_000))
    monkeypatch.setattr(lda, "BROADCAST", most)
    cells = topics.matrix(docs, max_df=0.9)
    vocab = topics.vocabulary(cells, None)
    ids = {r.word: r.id for r in vocab.collect()}
    names = sorted(r.doc for r in cells.select("doc").distinct().collect())
    x = np.zeros((len(names), len(ids)))
    for r in cells.collect():
        x[names.index(r.doc), ids[r.word]] = r.n
    assert x.shape == (72, 20) and x.sum() > 2000
    theta, phi = topics.fit_lda(cells, vocab, 3, seed=4, rounds=14, share=1.0)
    want_theta, want_phi = plain_lda(x, 3, 4, 14, 4)
    got = theta.collect()
    assert len(got) == 72 * 3 and all(abs(r.p - want_theta[names.index(r.doc), r.topic]) < 1e-3 for r in got)
    got = phi.collect()
    assert len(got) == 60 and all(abs(r.p - want_phi[r.topic, ids[r.word]]) < 1e-4 for r in got)


def test_matrix_reads_texts_once_and_merges_rows_of_one_document(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(f"d{n % 6}", ["sea", "ship", f"word{n % 3}", None, "of"]) for n in range(12)] + [("e", [])]
    docs = spark.createDataFrame(rows, "doc string, ws array<string>")
    got = topics.matrix(docs.mapInArrow(seen, docs.schema), 2, 0.4, stop=("ship",)).select("doc", "word", "n").collect()
    assert sorted(map(tuple, got)) == sorted((f"d{n}", f"word{n % 3}", 2) for n in range(6))
    assert read.value == len(rows)
