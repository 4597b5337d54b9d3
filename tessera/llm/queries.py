"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import read_table
from . import exact_dedup, fingerprints, html_text, mixing, near_dedup, packing, pii, quality, toxicity, warc

TOKENIZER = "byte_bpe_50k.json"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> quality.CompressionClassifier:
    """Fitted on labels of rows that aren't held out."""
    docs = read_table(spark, sf_dir, "documents") if docs is None else docs
    usable = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    sample = quality.labelled_sample(docs, read_table(spark, sf_dir, "labels"), "quality", usable)
    return quality.fit([(text, label) for _, text, label in sample])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(read_table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "good_bytes", "bad_bytes")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    usable = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    sample = quality.labelled_sample(docs, read_table(spark, sf_dir, "labels"), "toxic", usable, toxicity.FIT_ROWS, toxicity.FIT_CHARS)
    scored = toxicity.score_documents(docs, toxicity.fit(docs, sample))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = fingerprints.compare_with_next(read_table(spark, sf_dir, "documents"))
    return compared.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin([k.name for k in pii.BASE]))

    def count(name: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    counts = [count(k.name) for k in pii.BASE]
    added = [count(k.name) for k in pii.ADDED]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), *added)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read_table(spark, sf_dir, "pages"))


#: A page is asked for again after so many further captures.
REVISIT_AFTER = 1000


def capture_log(pages: DataFrame) -> DataFrame:
    """Two records for each page: its response, captured in the order of page_id, and a later not-modified revisit.

    A revisit sees the ETag of its own page, so it disagrees with the latest
    response wherever another page of the same canonical URL came in between.
    """
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")

    def fields(*pairs):
        return F.create_map(*[x for name, value in pairs for x in (F.lit(name), value)])

    response = fields(("Content-Type", F.lit("text/html")), ("Content-Length", size), ("ETag", etag), ("Cache-Control", F.lit("max-age=60")))
    revisit = fields(("Content-Length", F.lit("0")), ("ETag", F.concat(F.lit("W/"), etag)), ("Cache-Control", F.lit("max-age=600")))
    kinds = F.explode(F.array(F.struct(F.lit(200).alias("status"), F.lit(0).alias("after"), response.alias("headers")), F.struct(F.lit(304).alias("status"), F.lit(REVISIT_AFTER).alias("after"), revisit.alias("headers"))))
    both = pages.select("page_id", "url", kinds.alias("_k"))
    return both.select(F.col("page_id").alias("record_id"), "url", F.timestamp_seconds(F.col("page_id") + F.col("_k.after")).alias("time"), F.col("_k.status").alias("status"), F.col("_k.headers").alias("headers"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(capture_log(read_table(spark, sf_dir, "pages")))
    fields = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select(F.col("record_id").alias("page_id"), "canonical_url", "refers_to", "state", fields.alias("headers"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_classes(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_near_dedup": op4_near_dedup,
    "op5_fingerprints": op5_fingerprints,
    "op6_pii": op6_pii,
    "op7_html_text": op7_html_text,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_mixing": op9_mixing,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLES: dict[str, str] = {
    "op4_near_dedup": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), s AS (
          SELECT doc_id, unnest(list_distinct(CASE
            WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
            WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS shingle
          FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
        ), p AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), l AS (
          SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)
        ), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
        ), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
        ), c AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c.least, d.doc_id)) AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
    """,
    "op8_warc_revisits": r"""
        WITH part AS (
          SELECT page_id, html, url,
                 regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)\??([^#]*)', 2)),
                   '^[^@]*@', ''), ':(80|443)?$', ''), '^www[0-9]*\.', '') AS host,
                 regexp_replace(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)\??([^#]*)', 3), '/+$', '') AS path,
                 array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)\??([^#]*)', 4), '&'),
                   lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z_]+|gclid|fbclid|msclkid|mc_eid|mc_cid|igshid)(=|$)'))), '&') AS query
          FROM pages
        ), u AS (
          SELECT page_id, md5(coalesce(html, '')) AS tag, strlen(coalesce(html, '')) AS size,
                 CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical_url
          FROM part
        ), best AS (
          SELECT r.page_id, max(f.page_id) AS refers_to
          FROM u r LEFT JOIN u f ON f.canonical_url = r.canonical_url AND f.page_id < r.page_id + 1000
          GROUP BY r.page_id
        )
        SELECT u.page_id, u.canonical_url, b.refers_to,
               CASE WHEN f.page_id IS NULL THEN 'missing' WHEN f.tag = u.tag THEN 'resolved' ELSE 'changed' END AS state,
               CASE WHEN f.tag = u.tag
                    THEN 'cache-control=max-age=600;content-length=' || f.size || ';content-type=text/html;etag=W/"' || u.tag || '"'
                    ELSE 'cache-control=max-age=600;etag=W/"' || u.tag || '"' END AS headers
        FROM u JOIN best b USING (page_id) LEFT JOIN u f ON f.page_id = b.refers_to
    """,
    "op10_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS t,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
          FROM documents
        ), g AS (
          SELECT doc_id, norm,
                 first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
                 count(*) OVER (PARTITION BY norm) AS group_size
          FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
    """,
}
