"""Packing, token output, mixing, languages and near-duplicates against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from codexflow.llm import dartminhash, graph, hashing, language, mixing, packing, wavelet
from codexflow.llm.encoding import encoder
from codexflow.llm.storage import Scratch

from .data import DOCUMENTS, empty, odd_documents, sentence

PATH = public_tokenizers.path("byte_bpe_50k.json")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---- packing


def check_packing(rows, documents, capacity):
    enc = encoder(PATH)
    none = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    wanted = sorted((none((d, *p)) for d, t in documents for p in cut((enc.whole(t) if t else []) + [2], capacity)))
    assert sorted(none((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows) == wanted
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def cut(ids, capacity):
    at = k = 0
    while at < len(ids):
        size = (len(ids) - at) % capacity or capacity
        yield k, at, size, crc(ids[at : at + size])
        at, k = at + size, k + 1


def test_packing_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = packing.pack(docs, Scratch(spark, "t"), PATH, capacity=64).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], 64)
    assert packing.pack(empty(spark), Scratch(spark, "t"), PATH).collect() == []


def plain_best_fit(lengths, capacity, most):
    """(closed sequences, lengths in the open ones by their age) of one stream, by looking at every open bin."""
    bins, closed, no = [], 0, 0  # (free, age, lengths); the last put in comes last
    for n in lengths:
        fits = [b for b in bins if b[0] >= n]
        got = max((b for b in fits if b[0] == min(fits)[0]), key=bins.index) if fits else None
        if got:
            bins.remove(got)
        else:
            got, no = (capacity, no, []), no + 1
        got = (got[0] - n, got[1], got[2] + [n])
        if got[0] == 0:
            closed += 1
            continue
        bins.append(got)
        if len(bins) > most:
            least = min(b[0] for b in bins)
            bins.remove(got if got[0] == least else [b for b in bins if b[0] == least][-1])
            closed += 1
    return closed, [b[2] for b in sorted(bins, key=lambda b: b[1])]


def test_packing_over_many_tasks_and_rounds_follows_the_rule(spark):
    rng = random.Random(2)
    texts = [(n, sentence(rng, rng.randint(1, 60))) for n in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(9).cache()
    tasks = docs.select("doc_id", F.spark_partition_id().alias("task")).collect()
    rows = packing.pack(docs, Scratch(spark, "t"), PATH, capacity=128, open_bins=8, fan_in=2).collect()
    docs.unpersist()
    used = check_packing(rows, texts, 128)
    pieces = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        pieces.setdefault(r.doc_id, []).append(r.length)
    streams = [[n for r in tasks if r.task == t for n in pieces[r.doc_id]] for t in range(9)]
    closed, rounds = 0, 0
    while rounds < 5:  # 9 tasks, then 5, 3, 2 and 1
        found = [plain_best_fit(x, 128, 8) for x in streams]
        closed, rounds = closed + sum(f[0] for f in found), rounds + 1
        left = [[n for b in f[1] for n in b] for f in found]
        streams = [sum(left[g : g + 2], []) for g in range(0, len(left), 2)]
    assert len(found) == 1 and used == closed + len(found[0][1])


def test_packing_is_dense(spark):
    rng = random.Random(2)
    texts = [(n, sentence(rng, int(rng.lognormvariate(2.5, 1)) + 1)) for n in range(2000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(9)
    rows = packing.pack(docs, Scratch(spark, "t"), PATH, capacity=256, open_bins=64, fan_in=4).collect()
    used = check_packing(rows, texts, 256)
    closed, open_ = plain_best_fit([r.length for r in sorted(rows, key=lambda r: (r.doc_id, r.piece))], 256, 64)
    assert used <= 1.01 * (closed + len(open_)) + 1 and used <= 1.03 * sum(r.length for r in rows) / 256 + 1


def test_best_fit_takes_the_smallest_space_and_closes_the_fullest():
    p = packing.BestFit(10, 2)
    assert p.add(("a",), 6) == [] and p.add(("b",), 7) == []
    assert p.add(("c",), 3) == [(1, [(("b",), 0), (("c",), 7)])]  # fills the bin with 3 free, not the one with 4
    assert p.add(("d",), 9) == []
    closed = p.add(("e",), 5)
    assert closed == [(2, [(("d",), 0)])]
    assert sorted(n for n, _ in p.rest()) == [0, 3]
    with pytest.raises(ValueError):
        p.add(("x",), 11)


# ---- token output


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_wavelet_file_answers_like_the_sequence(tmp_path, monkeypatch, block):
    monkeypatch.setattr(wavelet, "BLOCK", block)
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, np.uint32), np.full(700, 9, np.uint32), rng.integers(0, 50_000, 3000).astype(np.uint32), (rng.zipf(1.3, 5000) % 70_000).astype(np.uint32)):
        path = tmp_path / "m"
        with open(path, "wb") as out:
            wavelet.write_matrix(out, ids, [4, None], np.array([len(ids), 0]))
        with open(path, "rb") as file:
            m = wavelet.WaveletMatrix(file)
            assert m.ids().tolist() == ids.tolist() and m.doc_ids == [4, None] and m.lengths.tolist() == [len(ids), 0]
            places = rng.integers(0, len(ids), 40) if len(ids) else []
            for i in places:
                token = int(ids[i])
                assert m.access(int(i)) == token
                assert m.rank(token, int(i)) == int((ids[:i] == token).sum())
                lo, hi = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
                assert m.count(token, lo, hi) == int((ids[lo:hi] == token).sum())
                assert list(m.occurrences(token))[:50] == np.flatnonzero(ids == token).tolist()[:50]
            assert m.count(123_456) == 0
            with pytest.raises(IndexError):
                m.access(len(ids))


def test_access_reads_a_block_of_each_plane(tmp_path):
    ids = np.random.default_rng(5).integers(0, 50_000, 1 << 20).astype(np.uint32)
    with open(tmp_path / "m", "wb") as out:
        wavelet.write_matrix(out, ids, [1], np.array([len(ids)]))

    class Counted:
        def __init__(self, file):
            self.file, self.bytes = file, 0

        def read(self, n):
            self.bytes += n
            return self.file.read(n)

        def seek(self, at):
            self.file.seek(at)

    with open(tmp_path / "m", "rb") as file:
        counted = Counted(file)
        m = wavelet.WaveletMatrix(counted)
        counted.bytes = 0
        assert m.access(700_001) == ids[700_001] and counted.bytes < (tmp_path / "m").stat().st_size / 10


def test_token_output_of_odd_rows(spark):
    docs = odd_documents(spark)
    scratch = Scratch(spark, "t")
    got = wavelet.read_shards(wavelet.write_shards(docs, scratch, PATH, shard_tokens=500)).collect()
    enc = encoder(PATH)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    wanted, at = [], 0
    for r in rows:
        ids = (enc.whole(r.text) if r.text else []) + [0]
        wanted.append((r.doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == wanted
    files = wavelet.write_shards(docs, scratch, PATH, shard_tokens=500)
    assert files.count() >= 3 and wavelet.read_shards(files).rdd.getNumPartitions() == files.count()  # a file to a task
    assert wavelet.read_shards(wavelet.write_shards(empty(spark), scratch, PATH)).collect() == []


# ---- mixing


def test_targets_stop_at_the_cap_and_reshare():
    got = mixing.targets([10, 100, 100], [3, 1, 2], 1.5)
    assert got[0] == 20 and abs(sum(got) - 315) < 1e-9 and abs(got[2] - 2 * got[1]) < 1e-9 or got[2] == 200
    assert mixing.targets([], [], 1.5) == [] and mixing.targets([0, 5], [3, 1], 1.5) == [0, 7.5]


def test_seats_equal_the_highest_quotients():
    rng = random.Random(6)
    for _ in range(60):
        weights = [rng.choice([0, 1, 5, 5, rng.random() * 100]) for _ in range(rng.randint(1, 7))]
        caps, seats = [rng.randint(0, 30) for _ in weights], rng.randint(0, 60)
        quotients = sorted(((-w / (2 * s + 1), n, s) for n, w in enumerate(weights) if w for s in range(caps[n])))[:seats]
        plain = Counter(n for _, n, _ in quotients)
        got = mixing.sainte_lague(np.array(weights), seats, np.array(caps))
        assert sum(got) == len(quotients)
        for n, w in enumerate(weights):  # ties may fall to either
            if got[n] != plain[n]:
                assert any(abs(w / (2 * got[n] + d) - weights[m] / (2 * got[m] + e)) < 1e-9 for m in range(len(weights)) if m != n and weights[m] for d in (-1, 1) for e in (-1, 1) if 2 * got[n] + d > 0 and 2 * got[m] + e > 0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mix_meets_its_targets(spark):
    rng = random.Random(8)
    rows = [(n, sentence(rng, rng.choice([1, 20, 300])), "en", rng.choice(["a", "b", "b", "b", None, "é"]), 1) for n in range(400)]
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumn("shard", F.lit(1)).withColumn("size", F.lit("x"))
    got = mixing.taken(docs, Scratch(spark, "t"), shard_docs=30).collect()
    again = mixing.taken(docs.repartition(7), Scratch(spark, "t"), shard_docs=30).collect()
    assert sorted(got) == sorted(again)
    source = {r[0]: r[3] for r in rows}
    sums, target = Counter(), {}
    sizes = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.size == len(words(rows[r.doc_id][1]))
        sums[source[r.doc_id]] += r.taken
        sizes[source[r.doc_id]] += r.size
        target[source[r.doc_id]] = r.target
    order = ["a", "b", "é", None]
    assert [target[s] for s in order] == pytest.approx(mixing.targets([sizes[s] for s in order], [3, 1, 2, 3], 1.5))
    for s in order:
        assert abs(sums[s] - target[s]) <= 32
    mixed = mixing.mixed_documents(docs, Scratch(spark, "t"), shard_docs=30)
    assert mixed.columns == docs.columns
    counted = Counter()
    for r in mixed.collect():
        own = words(r.text)
        full = words(rows[r.doc_id][1])
        assert any(full[k : k + len(own)] == own for k in range(len(full) - len(own) + 1)) and r.n_chars == len(r.text)
        counted[r.doc_id] += len(own)
    assert counted == Counter({r.doc_id: r.taken for r in got if r.taken})


def plain_seats(weights, seats, caps):
    """One seat after the other to the highest quotient, ties to the first."""
    got = [0] * len(weights)
    for _ in range(min(seats, sum(c for w, c in zip(weights, caps, strict=True) if w > 0))):
        n = max((n for n in range(len(weights)) if got[n] < caps[n] and weights[n] > 0), key=lambda n: (weights[n] / (2 * got[n] + 1), -n))
        got[n] += 1
    return got


def plain_deal(words, quota, block):
    got = [n * block for n in plain_seats(words, quota // block, [2 * w // block for w in words])]
    for n, w in enumerate(words):
        more = min(2 * w - got[n], quota - sum(got))
        got[n] += more
    return got


@pytest.mark.parametrize("group", [4096, 3])
def test_words_taken_equal_brute_force(spark, group):
    rng = random.Random(8)
    sources = ["a"] * 20 + ["b", "b", "c", None, "d"]
    rows = [(n, sentence(rng, rng.randint(0, 60)), "en", rng.choice(sources), 1) for n in range(400)] + [(7, "same words here", "en", "b", 1)] * 3 + [(900, "tiny", "en", "e", 1), (901, None, "en", "f", 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    options = {"shard_docs": 30, "group": group}
    got = Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.taken(docs, Scratch(spark, "t"), **options).collect())
    placed, _ = mixing.plan(docs, Scratch(spark, "t"), **options)
    placed = placed.withColumn("begin_hash", F.xxhash64(F.lit(17), "source_no", "shard")).collect()
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(words(text))
    order = sorted((s for s in sizes if s is not None)) + [None]
    goal, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), [s for s in order if sizes[s]]
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}
    while open_:  # no target over twice the size
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * unit > 2 * sizes[s]]
        for s in over or open_:
            goal[s] = 2.0 * sizes[s] if over else weight[s] * unit
            left -= goal[s]
        open_ = [s for s in open_ if s not in over] if over else []
    small = [s for s in order if goal[s] < 128]
    large = [s for s in order if goal[s] >= 128]
    quota = dict(zip(small, plain_seats([goal[s] for s in small], round(sum(goal[s] for s in small)), [2 * sizes[s] for s in small]), strict=True))
    blocks = int(sum(goal.values()) - sum(quota.values())) // 16
    quota |= {s: 16 * n for s, n in zip(large, plain_seats([goal[s] for s in large], blocks, [2 * sizes[s] // 16 for s in large]), strict=True)}
    wanted = Counter()
    for s in order:
        shards = defaultdict(list)
        for r in placed:
            if r.source == s:
                shards[r.shard].append(r)
        held = {k: sum(r.size for r in v) for k, v in sorted(shards.items())}
        parts = defaultdict(list)
        for k, n in held.items():
            if n:
                parts[k // group].append(k)
        given = {}
        for (_, ks), part in zip(sorted(parts.items()), plain_deal([sum(held[k] for k in ks) for _, ks in sorted(parts.items())], quota[s], 16), strict=True):
            given |= dict(zip(ks, plain_deal([held[k] for k in ks], part, 16), strict=True))
        for k, docs_of in shards.items():
            line = [n for n, r in enumerate(sorted(docs_of, key=lambda r: (r.order_hash, r.doc_id, r.size))) for _ in range(r.size)]
            count = Counter()
            if line:
                at = docs_of[0].begin_hash % max(1, len(line) // 16) * 16
                for i in range(given[k]):
                    count[line[(at + i) % len(line)]] += 1  # whole rounds count every word once
            for n, r in enumerate(sorted(docs_of, key=lambda r: (r.order_hash, r.doc_id, r.size))):
                wanted[(r.doc_id, r.size, sizes[s], round(goal[s], 6), count[n])] += 1
    assert got == wanted


def test_too_many_sources_are_an_error(spark):
    docs = spark.createDataFrame([(n, "a b c", "en", f"s{n}", 1) for n in range(6)], DOCUMENTS)
    with pytest.raises(ValueError):
        mixing.taken(docs, Scratch(spark, "t"), max_sources=5)


def test_mix_keeps_columns_of_any_name(spark):
    docs = odd_documents(spark).select("*", *[F.lit(c).alias(c) for c in ("_id", "_whole", "_copy", "_order_hash", "row", "copy", "whole", "parts", "no", "hash", "id", "of")])
    mixed = mixing.mixed_documents(docs, Scratch(spark, "t"))
    assert mixed.columns == docs.columns
    assert all(r[c] == c for r in mixed.collect() for c in ("_id", "_whole", "_copy", "_order_hash", "row", "copy", "whole", "parts", "no", "hash", "id", "of"))


def test_mix_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = mixing.taken(docs, Scratch(spark, "t")).collect()
    assert len(got) == docs.count()
    assert all(r.taken <= 2 * r.size for r in got) and all(r.size == 0 and r.taken == 0 for r in got if r.doc_id in (0, 1, 2))
    assert mixing.taken(empty(spark), Scratch(spark, "t")).collect() == []
    assert mixing.mixed_documents(docs, Scratch(spark, "t")).columns == docs.columns


def test_equal_rows_have_shares_of_their_own(spark):
    rows = [(None, "one two three four five six seven eight", "en", source, 1) for source in "aaaaaaabbbbbbb"]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    for options in ({}, {"share": 0.6}):
        shares = mixing.taken(docs, Scratch(spark, "t"), **options).agg({"taken": "sum"}).first()[0]
        words = mixing.mixed_documents(docs, Scratch(spark, "t"), **options).select(F.sum(mixing.word_count(F.col("text")))).first()[0]
        assert words == shares > 0


def test_small_sources_stay_in_the_mix(spark):
    rows = [(n, sentence(random.Random(n), 3), "en", f"s{n:02}", 1) for n in range(30)] + [(99, sentence(random.Random(99), 4000), "en", "z", 1)]
    got = mixing.taken(spark.createDataFrame(rows, DOCUMENTS), Scratch(spark, "t")).collect()
    assert all(r.taken > 0 and abs(r.taken - r.target) <= 1 for r in got if r.doc_id < 99)
    assert abs(sum(r.taken for r in got) - sum(r.target for r in got)) <= 16


# ---- languages


def test_grams_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(9)
    text = " ".join(sentence(rng, 9) + rng.choice(["!", " -- ", "é."]) for _ in range(200))
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "_SLICE", 7)
    assert (language.gram_counts(text) == whole).all()
    assert language.gram_counts("12 !!") is None and language.gram_counts(None) is None


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs, Scratch(spark, "t"))
    got = language.identify(docs, model, [F.col("doc_id"), F.col("lang"), language.held_out(F.col("doc_id")).alias("held_out")]).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in got) <= 0.01 * len(got) and all(0 <= r.score <= 1 for r in got)
    # labels and ids are no inputs
    blind = language.identify(docs.select(F.lit(1).alias("doc_id"), "text"), model).select("lang_pred", "score")
    assert sorted(map(tuple, blind.collect())) == sorted((r.lang_pred, r.score) for r in got)
    alien = spark.createDataFrame([(1, "это совсем другой язык и другие буквы " * 20)], "doc_id long, text string")
    assert language.identify(alien, model).first().rejected


def test_other_languages_and_random_letters_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs, Scratch(spark, "t"))
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej deklaracji bez względu na różnice rasy, koloru, płci, języka, wyznania, poglądów politycznych i innych przekonań."
    rng = random.Random(4)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (50, 200, 1000, 2000)]
    assert all(rejected for _, _, rejected in model.predict([language.gram_counts(t) for t in (polish, *noise)]))


def test_languages_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = language.identify(docs, language.fit(docs, Scratch(spark, "t"), train=F.lit(True)), [F.col("doc_id"), F.col("text")]).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    marks = docs.where("doc_id in (0, 2, 9)")
    assert {r.lang_pred for r in language.identify(marks, language.fit(marks, Scratch(spark, "t"), train=F.lit(True))).collect()} == {"und"}
    nothing = empty(spark)
    assert language.identify(nothing, language.fit(nothing, Scratch(spark, "t"))).collect() == []


def plain_prediction(model, text):
    """Bigrams and trigrams one by one, a vector of logarithms, and every centroid's cosine."""
    import math

    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    seq, before = [32, 32], False
    for c in text.lower():
        if c.isalpha():
            seq.append(ord(c))
        elif before:
            seq.append(32)
        before = c.isalpha()
    count, mask = Counter(), (1 << 32) - 1
    for n in range(2, len(seq)):
        two = (seq[n - 1] * 2654435761 + seq[n] * 2246822519) & mask
        for gram in (two, (seq[n - 2] * 3266489917 + two * 668265263) & mask):
            count[((gram ^ gram >> 15) * 2246822519 & mask) >> 32 - language.BITS] += 1
    vector = {k: math.log1p(n) * float(model.idf[k]) for k, n in count.items()}
    length = math.sqrt(sum(v * v for v in vector.values()))
    cosine = [sum(v * float(c[k]) for k, v in vector.items()) / length for c in model.centroids]
    return model.languages[max(range(len(cosine)), key=lambda n: (cosine[n], -n))], max(0.0, max(cosine))


def test_predictions_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs, Scratch(spark, "t"))
    odd = odd_documents(spark).select("doc_id", "text")
    for r in language.identify(docs.select("doc_id", "text").unionByName(odd), model, [F.col("doc_id"), F.col("text")]).collect():
        lang, score = plain_prediction(model, r.text)
        assert lang == r.lang_pred and abs(score - r.score) < 1e-5


def test_repeated_rows_do_not_swell_the_sample(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(1, "the same labelled row", "en")] * 3000 + [(n, sentence(rng, 9), "en") for n in range(2, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name, keep=Scratch.keep: seen.append((name, keep(self, df, name))) or seen[-1][1])
    language.fit(docs, Scratch(spark, "t"), train=F.lit(True), per_language=20)
    assert dict(seen)["features"].where("is_whole").count() == 20
    with pytest.raises(ValueError):
        language.fit(docs, Scratch(spark, "t"), train=F.lit(True), max_model_bytes=1000)


def test_names_of_carried_columns(spark):
    docs = odd_documents(spark).select("*", F.lit(1).alias("score"), F.lit(2).alias("rejected"), F.lit(3).alias("lang_pred"))
    model = language.fit(docs, Scratch(spark, "t"))
    carry = [F.col(c) for c in docs.columns]
    with pytest.raises(ValueError):
        language.identify(docs, model, carry)
    out = language.verdicts(docs, model, carry, "said").collect()
    assert all((r.score, r.rejected, r.lang_pred) == (1, 2, 3) and 0 <= r.said.score <= 1 for r in out) and len(out) == docs.count()


# ---- near-duplicates


def runs_of(text, n=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def brute_classes(rows, threshold=0.8):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    runs = [(d, t, runs_of(t)) for d, t in rows if t is not None and d is not None]
    for i, (a, ta, x) in enumerate(runs):
        find(a)
        for b, tb, y in runs[:i]:
            total = sum((x | y).values())
            if a == b or ta == tb or total and sum((x & y).values()) >= threshold * total:
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    out = {}
    for x in list(parent):
        out[x] = find(x)
    return {x: min(y for y in out if out[y] == out[x]) for x in out}


def near_copies(rng, text, share):
    w = text.split()
    for _ in range(max(1, int(share * len(w)))):
        w[rng.randrange(len(w))] = "changed" + str(rng.randrange(1000))
    return " ".join(w)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(10)
    rows = []
    for base in range(25):
        text = sentence(rng, rng.choice([3, 12, 80, 400]))
        rows += [text] * rng.choice([1, 1, 3]) + [near_copies(rng, text, rng.choice([0.005, 0.02, 0.03, 0.05])) for _ in range(rng.randint(0, 12))]
    common = sentence(rng, 120)
    rows += [sentence(rng, 60) + " " + common + " " + sentence(rng, 30) for _ in range(20)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = dartminhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got) and len(got) == len(rows)


def test_hot_buckets_in_small_pieces(spark, monkeypatch):
    rng = random.Random(13)
    text = sentence(rng, 150)
    rows = [near_copies(rng, text, 0.02) for _ in range(90)] + [sentence(rng, 40) for _ in range(40)]
    rows = list(enumerate(rows))
    monkeypatch.setattr(dartminhash, "hot_keys", lambda shared: graph.hot_keys(shared, least=1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({"piece": 16}, {"piece_elements": 1000}):
        assert {r.doc_id: r.class_id for r in dartminhash.classes(docs, Scratch(spark, "t"), **options).collect()} == brute_classes(rows)


def test_hot_keys_are_few_and_lose_nothing(spark):
    many = spark.createDataFrame([(1 if n < 900 else n, n) for n in range(2000)], "key long, rep long")
    counts = many.groupBy("key").count().withColumnRenamed("count", "n")
    hot = graph.hot_keys(counts)
    assert hot == [1]
    joined = graph.join_hot(many, counts, hot)
    assert joined.count() == 2000 and joined.columns == ["key", "rep", "n"]


def test_near_duplicates_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = dartminhash.classes(docs, Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    wanted = brute_classes(rows)
    for r in got:
        assert r.class_id == (wanted.get(r.doc_id, r.doc_id))
        assert r.kept == (r.doc_id is None or r.doc_id == r.class_id)
    assert dartminhash.classes(empty(spark), Scratch(spark, "t")).collect() == []


def test_signatures_estimate_the_similarity():
    rng = random.Random(12)
    text = sentence(rng, 500)
    other = near_copies(rng, text, 0.03)
    elements, owner = hashing.shingles_of([text.encode(), other.encode(), b"a b c d e f", b""])
    sigs = dartminhash.signatures(elements, owner, 4)
    x, y = runs_of(text), runs_of(other)
    true = sum((x & y).values()) / sum((x | y).values())
    assert abs((sigs[0] == sigs[1]).mean() - true) < 0.15
    assert (sigs[:3] != dartminhash._EMPTY).all() and (sigs[3] == dartminhash._EMPTY).all()


def test_words_of_long_texts_do_not_depend_on_segments(monkeypatch):
    rng = random.Random(13)
    texts = [sentence(rng, n).encode() for n in (0, 5, 4000, 1, 300)]
    whole = hashing.words_of(texts)
    monkeypatch.setattr(hashing, "_SEGMENT", 100)
    cut = hashing.words_of(texts)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_components_of_chains_stars_and_rings(spark):
    edges = [(n, n + 1) for n in range(0, 300)] + [(1000, n) for n in range(1001, 1100)] + [(2000 + n, 2000 + (n + 1) % 50) for n in range(50)] + [(5000, 5000)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()))
    wanted = {n: 0 for n in range(301)} | {n: 1000 for n in range(1000, 1100)} | {n: 2000 for n in range(2000, 2050)}
    assert got == wanted


def test_lean_functions_give_the_same_batches_and_slices_lose_no_row():
    import pyarrow as pa

    from codexflow.llm.storage import lean, slices

    batches = [pa.RecordBatch.from_pydict({"n": list(range(a, b))}) for a, b in ((0, 0), (0, 700), (700, 701), (701, 1725))]
    cut = list(lean(slices)(iter(batches)))
    assert [n for b in cut for n in b.column(0).to_pylist()] == list(range(1725))
    assert max(b.num_rows for b in cut) == 512
    with pytest.raises(ZeroDivisionError):
        list(lean(lambda found: (1 // 0 for _ in found))(iter(batches)))
