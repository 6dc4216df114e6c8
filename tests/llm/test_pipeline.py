"""The pipeline's stages against brute force, on a small table."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codexflow.llm import mixing
from codexflow.llm.encoding import encoder

from .data import DOCUMENTS, empty, odd_documents
from .test_documents import brute_classes, near_copies, words


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(21)
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = base[:90]
    for doc, text, lang, source, n in base[:20]:
        rows.append((doc + 10_000, text, lang, "src1", n))
        copy = near_copies(rng, text, 0.005) if len(text.split()) > 120 else text
        rows.append((doc + 20_000, copy, lang, source, len(copy)))
    rows += [(30_000, None, None, None, None), (30_001, "", "en", "src1", 0), (30_002, "123 456 !!", "en", "src2", 10)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_each_stage_does_its_work(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    identified, deduped, mixed, packed = None, None, None, None
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "MinHash near-dedup", "source mix", "best-fit packing"]
    identified = stages["language ID"](spark, docs, sf_dir).cache()
    assert identified.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in identified.collect()}
    assert {30_000, 30_001, 30_002} <= gone and len(gone) <= 4
    deduped = stages["MinHash near-dedup"](spark, identified, sf_dir).cache()
    assert deduped.columns == docs.columns
    classes = brute_classes([(r.doc_id, r.text) for r in identified.collect()])
    assert sorted(r.doc_id for r in deduped.collect()) == sorted(set(classes.values()))
    mixed = stages["source mix"](spark, deduped, sf_dir).cache()
    assert mixed.columns == docs.columns
    size, taken = Counter(), Counter()
    for r in deduped.collect():
        size[r.source] += len(words(r.text))
    for r in mixed.collect():
        taken[r.source] += len(words(r.text))
    order = sorted(size)
    goal = mixing.targets([size[s] for s in order], [3, 1, 2] * len(order), 1.5)
    assert all(abs(taken[s] - g) <= 40 for s, g in zip(order, goal, strict=True))
    packed = stages["best-fit packing"](spark, mixed, sf_dir).collect()
    enc = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    whole = Counter()
    for r in mixed.collect():
        whole[r.doc_id] += len(enc.whole(r.text)) + 1
    held, bins = Counter(), defaultdict(list)
    for r in packed:
        held[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert held == whole
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.05 * sum(whole.values()) / 1024 + 1


def test_run_equals_its_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "start", "length", "ids_crc32")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.select(*got.columns).collect()))


def test_stages_stand_odd_rows(spark):
    for docs in (odd_documents(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            if name != "best-fit packing":
                assert out.columns == docs.columns
                docs = out.withColumn("lang", F.coalesce("lang", F.lit("en")))
            out.collect()


CLASHES = ("score", "rejected", "lang_pred", "said", "gone", "again", "row", "id", "_id", "_whole", "_copy", "_order_hash", "class_id", "kept", "rep", "digest", "piece", "length", "offset", "task", "closed", "a.b")


def test_stages_keep_columns_of_any_name(spark):
    docs = odd_documents(spark).withColumns({c: F.lit(c) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        rows = out.collect()
        if name != "best-fit packing":
            assert out.columns == docs.columns and rows
            assert all(r[docs.columns.index(c)] == c for r in rows for c in CLASHES)
            docs = out.withColumn("lang", F.coalesce("lang", F.lit("en")))


def test_rows_of_one_id_leave_the_same_row(spark):
    rows = [(1, f"some text number {n} that differs", "en", "a", n) for n in range(6)] + [(2, "another", "en", "a", 1)]
    stage = dict(corpus_pipeline.STAGES)["MinHash near-dedup"]
    found = {tuple(sorted(map(tuple, stage(spark, spark.createDataFrame(rows[k:] + rows[:k], DOCUMENTS).repartition(3 + k), "").collect()))) for k in (0, 2, 5)}
    assert len(found) == 1 and [r[0] for r in found.pop()] == [1, 2]
