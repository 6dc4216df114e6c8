"""The registered queries of the operators, with production parameters.

The SQL of op9 and op10 states the exact result; the operators find it by signatures and
codes, and equal it as long as no link is missed.  The other queries without SQL are
tested against brute force, an exact round trip or held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dartminhash, embeddings, language, licences, mixing, packing, topk, urls, warc, wavelet
from .storage import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


URL_RULES = (
    (urls.BLOCK, "net/"),
    (urls.ALLOW, "example.net/en/"),
    (urls.BLOCK, "example.com/de/"),
    (urls.ALLOW, "org/fr/"),
)


def op1_license_scan(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = licences.train(licences.sample_paragraphs(documents))
    return licences.scan(documents, model, Scratch(spark, "op1"))


def op2_url_filter(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_exact_topk(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, Scratch(spark, "op3"))


def op4_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), Scratch(spark, "op4"), tokenizer_path())


def op5_language_id(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = language.fit(documents, Scratch(spark, "op5"))
    carry = [F.col("doc_id"), language.held_out(F.col("doc_id")).alias("held_out")]
    return language.identify(documents, model, carry)


def op6_warc(spark, sf_dir):
    scratch = Scratch(spark, "op6")
    archives = warc.write_archives(table(spark, sf_dir, "pages"), scratch)
    return warc.page_records(warc.read_archives(archives, scratch)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_source_mix(spark, sf_dir):
    return mixing.taken(table(spark, sf_dir, "documents"), Scratch(spark, "op7"))


def op8_wavelet_output(spark, sf_dir):
    manifest = wavelet.write_shards(table(spark, sf_dir, "documents"), Scratch(spark, "op8"), tokenizer_path())
    return wavelet.read_shards(manifest)


def op9_dart_minhash(spark, sf_dir):
    return dartminhash.classes(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))


def op10_itq_near_dup(spark, sf_dir):
    return embeddings.link(table(spark, sf_dir, "embeddings"), Scratch(spark, "op10"))


QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_url_filter, op3_exact_topk, op4_best_fit_packing, op5_language_id, op6_warc, op7_source_mix, op8_wavelet_output, op9_dart_minhash, op10_itq_near_dup)
}

_OP2 = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
), rules(verdict, rule, rhost, rpath) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
         ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT parts.page_id, host, path, best.rule, coalesce(best.verdict, 'allow') AS verdict FROM parts LEFT JOIN best ON parts.page_id = best.page_id
"""

_OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_OP6 = """
WITH held AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), hashed AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM held
), named AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), 'string_agg', '') AS payload_digest,
         min(page_id) OVER (PARTITION BY hex) AS first_id FROM hashed
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM named
"""

_OP9 = """
WITH RECURSIVE texts AS (
  SELECT text, min(doc_id) AS rep FROM documents WHERE text IS NOT NULL GROUP BY text
), words AS (
  SELECT rep, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM texts
), runs AS (
  SELECT rep, array_to_string(w[i : i + 4], ' ') AS run FROM (SELECT rep, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)
), counts AS (
  SELECT rep, run, count(*) AS n FROM runs GROUP BY ALL
), sizes AS (
  SELECT rep, sum(n) AS size FROM counts GROUP BY rep
), shared AS (
  SELECT a.rep AS a, b.rep AS b, sum(least(a.n, b.n)) AS inter FROM counts a JOIN counts b ON a.run = b.run AND a.rep < b.rep GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.rep = a JOIN sizes y ON y.rep = b WHERE inter >= 0.8 * (x.size + y.size - inter)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (
  SELECT rep, rep FROM texts UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), label AS (
  SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(texts.rep, doc_id) AS copy_of, doc_id = coalesce(class_id, doc_id) AS kept
FROM documents LEFT JOIN texts ON documents.text = texts.text LEFT JOIN label ON texts.rep = label.rep
"""

_OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), label AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT label.vec_id, (SELECT count(*) FROM links WHERE links.a = label.vec_id) AS n_links, component_id, label.vec_id = component_id AS kept FROM label
"""

ORACLE_SQL: dict[str, str] = {"op2_url_filter": _OP2, "op3_exact_topk": _OP3, "op6_warc": _OP6, "op9_dart_minhash": _OP9, "op10_itq_near_dup": _OP10}
