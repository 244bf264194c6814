"""The registered queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from . import bpe, langid, lexical, licenses, maintext, manifest, merkle, packing, quality, simhash, topk, toxicity, warc
from .common import id_split, table


def held_out(parts: int, rest: int):
    return F.coalesce(id_split("doc_id", parts) == rest, F.lit(False)).alias("held_out")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests: bpe.Derived = {
        "n_tokens": ("long", pa.int64(), lambda ids, _: len(ids) // 4),
        "ids_sha256": ("string", pa.string(), lambda ids, _: hashlib.sha256(ids).hexdigest()),
        "decoded_sha256": ("string", pa.string(), lambda ids, codec: hashlib.sha256(codec.decode(ids)).hexdigest()),
    }
    return bpe.encode(table(spark, sf_dir, "documents"), digests)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.with_edited(table(spark, sf_dir, "documents"))
    near = lambda other: F.round(merkle.likeness(F.col("fingerprint"), F.col(other)), 6)
    return found.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs, langid.learn_rows()))
    return found.select("doc_id", held_out(4, 2), "lang_pred", "score", "rejected")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(4, 2), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document or so is held against the manifest with its text in lower case."""
    docs = table(spark, sf_dir, "documents")
    changed = F.coalesce(id_split("doc_id", 3) == 0, F.lit(False))
    found = manifest.with_tampered(docs, changed, ascii_lower(F.col("text").cast("string")))
    folded = found.select("doc_id", "leaf", "subroot", "root", manifest.proof("path").alias("proof_sha256"), manifest.fold("path", "other").alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_bpe": op2_bpe,
    "op3_licenses": op3_licenses,
    "op4_fingerprints": op4_fingerprints,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_language": op9_language,
    "op10_toxicity": op10_toxicity,
    "op11_maintext": op11_maintext,
    "op12_lexical": op12_lexical,
    "op13_manifest": op13_manifest,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    # Exact, from the definitions; the other queries are held against brute force in the tests.
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
        SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10""",
    "op7_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages
        ), f AS (SELECT d, min(page_id) AS first_id FROM p WHERE octet_length(b) >= 100 GROUP BY d)
        SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d""",
    "op12_lexical": r"""
        WITH t AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ), d AS (SELECT r, doc_id, len(terms) AS n, terms FROM t WHERE len(terms) > 0
        ), s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d
        ), p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL
        ), q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL
        ), f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, s WHERE term IN (SELECT term FROM q) GROUP BY term, docs
        ), c AS (
            SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score
            FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (r), s GROUP BY ALL
        ), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10""",
    # CRC-32 bit by bit; then the levels of each language's tree, those of the tree over languages, and what is left and right of each node
    "op13_manifest": r"""
        WITH RECURSIVE e AS (
            SELECT doc_id, coalesce('=' || lang, '') AS k, list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda x: coalesce(octet_length(encode(x)) || ':' || x, '-')) AS head, text,
                   xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])), lambda a, b: xor(xor(a, b) >> 1, CAST(3988292384 AS BIGINT) * (xor(a, b) & 1)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 3 = 0 AS hit
            FROM documents
        ), l AS (
            SELECT doc_id, k, sha256(array_to_string(head, '') || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
                   CASE WHEN hit THEN sha256(array_to_string(head, '') || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed FROM e
        ), p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM l
        ), u AS (
            SELECT k, 0 AS lvl, pos, leaf AS d, n FROM p
            UNION ALL SELECT k, lvl + 1, pos // 8, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM u WHERE n > 1 GROUP BY k, lvl, pos // 8
        ), subs AS (SELECT k, d AS subroot, row_number() OVER (ORDER BY encode(k)) - 1 AS place, count(*) OVER () AS n FROM u WHERE n = 1
        ), v AS (
            SELECT 0 AS lvl, place AS pos, subroot AS d, n FROM subs
            UNION ALL SELECT lvl + 1, pos // 8, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM v WHERE n > 1 GROUP BY lvl, pos // 8
        ), sides AS (
            SELECT k, lvl, pos, coalesce(string_agg(d, '') OVER (PARTITION BY k, lvl, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|'
                   || coalesce(string_agg(d, '') OVER (PARTITION BY k, lvl, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS side
            FROM (SELECT k, lvl, pos, d FROM u WHERE n > 1 UNION ALL SELECT NULL, 1000 + lvl, pos, d FROM v WHERE n > 1)
        ), w AS (
            SELECT k, pos, list(side ORDER BY lvl) AS path FROM (
                SELECT p.k, p.pos, s.lvl, s.side FROM p JOIN sides s ON s.k = p.k AND s.pos = p.pos // CAST(pow(8, s.lvl) AS BIGINT)
                UNION ALL SELECT p.k, p.pos, s.lvl, s.side FROM p JOIN subs USING (k) JOIN sides s ON s.k IS NULL AND s.pos = subs.place // CAST(pow(8, s.lvl - 1000) AS BIGINT)) GROUP BY ALL
        ), f AS (
            SELECT p.doc_id, p.leaf, subs.subroot, (SELECT d FROM v WHERE n = 1) AS root, coalesce(path, []) AS path, coalesce(changed, leaf) AS other FROM p JOIN subs USING (k) LEFT JOIN w ON w.k = p.k AND w.pos = p.pos)
        SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256,
               list_reduce(path, lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2)), other) AS folded_root,
               list_reduce(path, lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2)), other) = root AS verified FROM f""",
}
