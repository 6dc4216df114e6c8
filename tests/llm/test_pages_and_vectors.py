"""Licences, URLs, WARC, top-k and embedding links against brute force."""

import gzip
import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexflow.llm import embeddings, licences, topk, urls, warc
from codexflow.llm.queries import URL_RULES
from codexflow.llm.storage import Scratch

# ---- licences


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return licences.train(licences.sample_paragraphs(docs))


def test_notices_are_told_apart(spark, model):
    rows = [(family, notice) for family, notices in licences.NOTICES.items() for notice in notices]
    rows += [("none", text) for text in licences.OTHERS] + [("none", "mit der und die"), ("none", "This is licensed to nobody at all, says the judge.")]
    got = {r.paragraph: r for r in licences.scan_paragraphs(spark.createDataFrame(rows, "want string, paragraph string"), model).collect()}
    for family, text in rows:
        if family == "none":
            assert text not in got or not got[text].confirmed
        else:
            assert got[text].family == family and got[text].confirmed, text


def test_licence_scan_of_odd_rows(spark, model):
    mit, apache = licences.NOTICES["mit"][0], licences.NOTICES["apache"][0]
    long = "word " * 50_000 + "\n" + mit
    rows = [(1, f"a b\r\n{mit}\n{mit}\n\n{apache}", "x"), (2, None, None), (3, "", "x"), (4, long, "x"), (None, mit, "x"), (5, "clean text", "x"), (5, mit, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, families string")
    got = sorted(((r.doc_id, r.families, r.paragraphs) for r in licences.scan(docs, model, Scratch(spark, "t")).collect()), key=str)
    assert got == sorted([(1, ["apache", "mit"], 3), (2, [], 0), (3, [], 0), (4, ["mit"], 1), (None, ["mit"], 1), (5, ["mit"], 1), (5, ["mit"], 1)], key=str)
    assert licences.scan(docs.where("false"), model, Scratch(spark, "t")).collect() == []
    plan = licences.scan(docs, model, Scratch(spark, "t"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_notices_of_the_sample_are_not_taught_as_unknown(spark):
    wanted = [("mit", licences.NOTICES["mit"][1]), ("bsd", licences.NOTICES["bsd"][1]), ("cc0", licences.NOTICES["cc0"][0])]
    model = licences.train([p for _, p in wanted] + ["mit der und die", "Some other words of a text."])
    docs = spark.createDataFrame([(n, text) for n, (_, text) in enumerate(wanted)], "doc_id long, text string")
    got = {r.doc_id: r.families for r in licences.scan(docs, model, Scratch(spark, "t")).collect()}
    assert got == {n: [family] for n, (family, _) in enumerate(wanted)}


def test_wrapped_notices(spark, model):
    import textwrap

    rows, wanted = [], {}
    for family in ("mit", "bsd", "gpl", "agpl", "apache"):
        for width, mark in ((72, ""), (76, "# "), (40, " * ")):
            body = [mark + line for line in textwrap.wrap(licences.NOTICES[family][1], width)]
            rows.append((len(rows), "\n".join(["int main;", mark.strip(), *body, mark.strip(), "some other words"])))
            wanted[len(rows) - 1] = ([family], 1)
    mit = textwrap.wrap(licences.NOTICES["mit"][1], 72)
    rows.append((len(rows), "\r\n".join([*mit, *mit, licences.NOTICES["apache"][0]])))
    wanted[len(rows) - 1] = (["apache", "mit"], 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.families, r.paragraphs) for r in licences.scan(docs, model, Scratch(spark, "t")).collect()}
    assert got == wanted


def plain_score(model, text):
    """Family, probability and best template of any paragraph, with or without a cue."""
    grams = licences._grams(licences._tokens(text))
    z = np.array(model.bias) + sum((np.array(model.weights[g]) for g in grams if g in model.weights), np.zeros(len(model.bias)))
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    family = model.families[int(z.argmax())]
    held = max((len(grams & t) / len(t) for t in (licences._grams(licences._tokens(n)) for n in licences.NOTICES.get(family, ()))), default=0.0)
    return family, float(p.max()), held


def test_texts_without_a_cue_are_never_predicted(spark, model):
    words = sorted({w for g in model.weights for w in g.split()} - set(model.cues))
    rng = random.Random(5)
    assert set(words) and set(model.cues)
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 200)))
        family, probability, _ = plain_score(model, text)
        assert family == licences.UNKNOWN or probability < model.least
    # every n-gram without a cue at once, which no text can hold
    open_ = [np.array(w) for g, w in model.weights.items() if not set(g.split()) & set(model.cues)]
    for k in range(len(model.families) - 1):
        z = np.array(model.bias) + sum(np.maximum(w[k] - w, 0) * -1 for w in open_)
        z[k] = model.bias[k]
        assert 1 / np.exp(z - z[k]).sum() < model.least


def test_confirmed_texts_have_an_anchor(model):
    for notice in (n for t in licences.NOTICES.values() for n in t):
        grams = licences._grams(licences._tokens(notice))
        assert sum(not set(g.split()) & set(model.anchors) for g in grams) < model.share * len(grams)


def test_scan_equals_a_plain_scorer_of_every_paragraph(spark, model):
    import re
    import textwrap

    rng = random.Random(6)
    corpus = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect() if r.text and len(r.text) < 3000]
    notices = [n for t in licences.NOTICES.values() for n in t]
    rows = []
    for n in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            pick = rng.random()
            text = rng.choice(notices) if pick < 0.5 else rng.choice(licences.OTHERS) if pick < 0.7 else rng.choice(corpus)[:200]
            if rng.random() < 0.2:
                text = " ".join(w for w in text.split() if rng.random() > 0.15)
            lines += textwrap.wrap(text, rng.choice([30, 60, 500])) + rng.choice([[], [""], ["--"]])
        rows.append((n, "\n".join(lines)))
    got = {r.doc_id: (r.families, r.unconfirmed, r.paragraphs) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model, Scratch(spark, "t")).collect()}
    reach = 3 * max(len(licences._tokens(n)) for n in notices) // 2
    for n, text in rows:
        families, unsure_families, count = set(), set(), 0
        for block in re.split(r"\n(?:[^\w\n]*\n)+", "\n" + text + "\n"):
            lines = block.strip("\n").split("\n")
            tokens = [licences._tokens(x) for x in lines]
            sure, unsure = [], []
            for lo in range(len(lines)):
                for hi in range(lo, len(lines)):
                    if sum(len(t) for t in tokens[lo + 1 : hi]) > reach:
                        break
                    unit = lines[lo] if hi == lo else " ".join([" ".join(tokens[lo][-reach:]), *[" ".join(t[:reach]) for t in tokens[lo + 1 : hi + 1]]])
                    family, p, held = plain_score(model, unit)
                    if family != licences.UNKNOWN and p >= model.least and held > 0:
                        if held >= model.share - 1e-9:
                            sure.append((-held, hi - lo, lo, hi, family))
                        elif lo == hi:
                            unsure.append((lo, family))
            taken = []
            for one in sorted(sure):
                if all(one[3] < t[2] or t[3] < one[2] for t in taken):
                    taken.append(one)
            families |= {t[4] for t in taken}
            unsure_families |= {f for at, f in unsure if not any(t[2] <= at <= t[3] for t in taken)}
            count += len(taken)
        assert got[n] == (sorted(families), sorted(unsure_families), count), text


# ---- urls


def plain_rule(host, path, rules):
    best = None
    for verdict, rule in rules:
        rhost, rpath = rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]
        if (host == rhost or host.endswith("." + rhost)) and path.startswith(rpath):
            key = (rhost.count(".") + 1, len(rpath), verdict == "block")
            if best is None or key > best[0]:
                best = (key, verdict, rule)
    return best[1:] if best else None


def test_trie_equals_all_rules():
    rng = random.Random(1)
    label = lambda: rng.choice(["a", "b", "net", "example"])
    path = lambda: "/" + "/".join(rng.choice(["", "x", "xy", "y"]) for _ in range(rng.randint(0, 3)))
    rules = list({r: (rng.choice(["allow", "block"]), r) for r in (".".join(label() for _ in range(rng.randint(1, 3))) + path() for _ in range(60))}.values())
    trie = urls.Trie(rules)
    for _ in range(3000):
        host, where = ".".join(label() for _ in range(rng.randint(1, 4))), path() + rng.choice(["", "z", "/"])
        assert trie.find(host, where) == plain_rule(host, where, rules), (host, where)


def test_odd_urls(spark):
    rows = ["http://A.Example.NET/en/x?q#f", "http://net", "http://net/", "https://x.org/fr/", "https://x.org/fr", "no scheme", None, "", "http://u?p/q", "a://b#c/d?e", "http://ÄÖ.net/é", "://x.net/", "http://" + "y" * 100_000 + ".net/"]
    pages = spark.createDataFrame([(n, u, "clash") for n, u in enumerate(rows)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, URL_RULES).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("net", "", None, "allow") and got[2] == ("net", "/", "net/", "block")
    assert got[3][2:] == ("org/fr/", "allow") and got[4][2:] == (None, "allow")
    assert got[5] == got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("u", "", None, "allow") and got[9] == ("b", "", None, "allow") and got[10] == ("ÄÖ.net", "/é", "net/", "block")
    assert got[11][:3] == ("x.net", "/", "net/") and got[12][2] == "net/"
    assert urls.judge(pages.where("false"), URL_RULES).collect() == []
    with pytest.raises(ValueError):
        urls.judge(pages, URL_RULES, max_trie_bytes=10)


# ---- warc


def test_archives_round_trip(spark):
    rng = random.Random(2)
    big = "".join(rng.choice("abc é\r\n") for _ in range(5000))
    rows = [(3, "http://a/", big), (1, "u", big), (2, None, None), (7, "x", ""), (5, "y", "same"), (5, "y", "same"), (None, "z", "same"), (None, "z", "lonely"), (9, "bad\r\nurl", "z" * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    scratch = Scratch(spark, "t")
    archives = warc.write_archives(pages, scratch, segment_bytes=64, chunk_bytes=50, archive_bytes=900)
    assert archives.count() > 3
    got = warc.page_records(warc.read_archives(archives, scratch)).collect()
    assert len(got) == len(rows) and all(r.problem is None for r in got)
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    wanted = []
    for page, _, html in rows:
        body = (html or "").encode()
        origin = first.get(html or "")
        wanted.append((page, len(body), warc.base32_sha1(body), "response" if page == origin else "revisit", None if page == origin else origin))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(wanted, key=str)
    # what a revisit names is the id of a record in the archives, and no other
    whole = warc.read_archives(archives, scratch).collect()
    ids = [r.record_id for r in whole]
    assert len(set(ids)) == len(ids) and {r.refers_to for r in whole if r.kind == "revisit"} <= {r.record_id for r in whole if r.kind == "response"}
    none = warc.write_archives(pages.where("false"), scratch)
    assert warc.read_archives(none, scratch).collect() == []


def test_archives_are_read_by_many_tasks(spark):
    from codexflow.llm.storage import spread

    pages = spark.createDataFrame([(n, "u", f"page {n} " * 40) for n in range(40)], "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(pages, Scratch(spark, "t"), archive_bytes=200)
    assert archives.count() == 40 and spread(archives, "bytes", 128 << 20).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert spread(archives, "bytes", 100).rdd.getNumPartitions() == 40


def test_revisits_without_their_response_are_reported(spark, tmp_path):
    def record(kind, name, body, **more):
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + (body if kind == "response" else b"")
        return warc.record_bytes([("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Payload-Digest", "sha1:" + warc.base32_sha1(body)), *more.items()], block)

    named = lambda name: {"WARC-Refers-To": name}
    data = record("response", "<a>", b"x") + record("revisit", "<b>", b"x", **named("<a>")) + record("revisit", "<c>", b"y", **named("<a>")) + record("revisit", "<d>", b"x", **named("<e>"))
    (tmp_path / "f.warc").write_bytes(data)
    files = spark.createDataFrame([("file://" + str(tmp_path / "f.warc"), 1)], "path string, bytes long")
    got = {r.record_id: (r.payload_bytes, r.problem) for r in warc.read_archives(files, Scratch(spark, "t")).collect()}
    assert got["<a>"] == got["<b>"] == (1, None) and got["<c>"] == (None, "the response's payload differs") and got["<d>"] == (None, "no response of that id")


def test_small_payloads_are_not_revisited(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    scratch = Scratch(spark, "t")
    got = warc.page_records(warc.read_archives(warc.write_archives(pages, scratch, revisit_from=3), scratch)).collect()
    assert {r.record_type for r in got} == {"response"}


def test_damaged_segments_are_reported():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"hello world", 4)
    part = lambda n, data, total=None: {"record_id": "r" if n == 1 else f"r/{n}", "origin_id": "r", "segment": n, "total": total, "kind": "response" if n == 1 else "continuation", "target": "t", "refers_to": None, "digest": warc.base32_sha1(b"hello world"), "block": data}
    good = [part(2, block[60:], len(block)), part(1, block[:60])]
    assert warc.reassemble(good)[4:] == (11, warc.base32_sha1(b"hello world"), None)
    assert "segments" in warc.reassemble([part(1, block[:30]), part(3, block[60:], len(block))])[6]
    assert "total length" in warc.reassemble([part(1, block[:60]), part(2, block[60:-1], len(block))])[6]
    assert warc.reassemble([part(1, block[:-9]), part(2, b"", len(block) - 9)])[6]
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"


def test_plain_and_compressed_archives_read_alike():
    record = warc.record_bytes([("WARC-Type", "resource"), ("WARC-Record-ID", "<a>")], b"x\r\n\r\ny")
    for data in (record * 2, gzip.compress(record) * 2, gzip.compress(record * 2)):
        got = list(warc.read_archive(io.BytesIO(data)))
        assert [b for _, b in got] == [b"x\r\n\r\ny"] * 2 and got[0][0]["warc-record-id"] == "<a>"
    assert hashlib.sha1(b"").digest() and warc.base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


# ---- vectors


def odd_vectors(spark, rng, n=120, dim=12):
    rows = [(k, [float(x) for x in rng.standard_normal(dim)], "x") for k in range(n)]
    rows += [(n, None, "x"), (n + 1, [float("nan")] * dim, "x"), (n + 2, [None] + [1.0] * (dim - 1), "x"), (n + 3, [0.0] * dim, "x"), (n + 4, [], "x"), (n + 5, [float("inf")] * dim, "x"), (n + 6, rows[0][1], "x"), (n + 7, rows[3][1][:5], "x"), (None, rows[1][1], "x"), (7, rows[7][1], "x")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    for scale in (1024.0, 2.0**40):
        rows, df = odd_vectors(spark, rng)
        got = topk.search(df, F.col("vec_id") % 10 == 0, Scratch(spark, "t"), k=4, scale=scale, block_rows=32, query_rows=5, most_groups=3).collect()
        fine = [(k, np.float32(v + [0.0] * (12 - len(v))).astype(float)) for k, v, _ in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
        ints = [(k, [int(np.floor(scale * x)) for x in v]) for k, v in fine]
        wanted = []
        for q, v in ints:
            if q % 10 == 0:
                scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), k) for k, w in ints if k != q)[:4]
                wanted += [(q, r + 1, k, -s) for r, (s, k) in enumerate(scores)]
        if scale == 1024.0:
            assert sorted(tuple(r) for r in got) == sorted(wanted)
        else:
            assert len(got) == len(wanted)
    assert topk.search(df.where("false"), F.lit(True), Scratch(spark, "t")).collect() == []


def brute_links(rows, threshold):
    fine = {n: np.float32(v + [0.0] * (16 - len(v))).astype(float) for n, (k, v, _) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    names = sorted(fine)
    x = np.stack([fine[n] for n in names])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    return names, near


def test_links_of_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows, df = odd_vectors(spark, rng)
    got = embeddings.link(df, Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert by[0] == [(1, 0, True)] and by[126] == [(1, 0, False)] and by[7] == [(1, 7, True)] * 2
    assert all(by[k] == [(0, k, True)] for k in range(120, 126)) and by[None] == [(0, None, True)]
    assert embeddings.link(df.where("false"), Scratch(spark, "t")).collect() == []


def test_recall_of_links_and_hot_buckets(spark):
    rng = np.random.default_rng(5)
    dim, rows = 64, []
    centres = rng.standard_normal((40, dim))
    for n in range(1600):
        base = centres[n % 40] * 0.8 + rng.standard_normal(dim)
        rows.append(base)
        if n % 4 == 0:  # a partner with a cosine between .95 and 1
            noise = rng.standard_normal(dim)
            rows.append(base + noise * np.linalg.norm(base) / np.linalg.norm(noise) * rng.uniform(0, 0.32))
    hot = rng.standard_normal(dim)
    rows += [hot + 0.1 * rng.standard_normal(dim) for _ in range(300)]
    rows = [(n, [float(v) for v in x], "x") for n, x in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = {r.vec_id: r for r in embeddings.link(df, Scratch(spark, "t"), block=64).collect()}
    x = np.stack([np.float32(v).astype(float) for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    true = near.sum(axis=1)
    assert all(got[n].n_links <= true[n] for n in range(len(rows)))
    assert sum(r.n_links for r in got.values()) >= 0.97 * true.sum()
    last = len(rows) - 300
    assert {got[n].component_id for n in range(last, len(rows))} == {last}


def test_recall_with_a_common_direction(spark):
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    for common in (0.79, 0.97):  # the mean cosine of the table
        x = unit(np.sqrt(1 - common) * unit(rng.standard_normal((1500, 64))) + np.sqrt(common) * unit(rng.standard_normal(64)))
        away = rng.standard_normal((500, 64))
        away = unit(away - (away * x[:500]).sum(axis=1, keepdims=True) * x[:500])
        c = rng.uniform(0.95, 0.96, (500, 1))
        x = np.concatenate([x, c * x[:500] + np.sqrt(1 - c * c) * away]).astype(np.float32)
        df = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "vec_id long, embedding array<float>")
        got = {r.vec_id: r.n_links for r in embeddings.link(df, Scratch(spark, "t")).collect()}
        x = unit(x.astype(float))
        near = x @ x.T >= 0.95
        np.fill_diagonal(near, False)
        true = near.sum(axis=1)
        assert all(got[n] <= true[n] for n in range(len(x)))
        assert sum(got.values()) >= 0.97 * true.sum(), common


def test_substrings_grow_with_the_table():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    met = []
    for rows in (10**5, 10**9):
        mean, projection, tables, bits = embeddings.shape(x, rows, 0.95, 16, 24)
        away = rng.standard_normal(x.shape)
        away -= (away * x).sum(axis=1, keepdims=True) * x
        c = rng.uniform(0.95, 0.96, (len(x), 1))
        y = c * x + np.sqrt(1 - c * c) * away / np.linalg.norm(away, axis=1, keepdims=True)
        recall = (embeddings.codes(x, mean, projection, tables, bits) == embeddings.codes(y, mean, projection, tables, bits)).any(axis=1).mean()
        print(f"{rows} rows: {tables} substrings of {bits} bits find {recall:.3f} of the partners at .95 to .96")
        assert recall >= 0.97
        met.append((tables, bits))
    assert met[1][0] > met[0][0] and met[1][1] > met[0][1]


def test_bounds_of_other_blocks_drop_candidates():
    rng = np.random.default_rng(10)
    block, ids, query = rng.integers(-99, 99, (16, 500)).astype(float), np.arange(500), rng.integers(-99, 99, (1, 16)).astype(float)
    score = np.sort(query[0] @ block)[::-1]
    (at, found), = topk.best_of_block(query, [-1], block, ids, 10, [score[3]])
    assert found.tolist() == score[:4].tolist() and len(at) == 4
    (at, _), = topk.best_of_block(query, [-1], block, ids, 10, [score[0] + 1])
    assert len(at) == 0
