"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condfuse.llm import bpe, codes, embeddup, exact, langid, linedup, mixing, packing, secrets, sharding, simhash, warc, whitening
from condfuse.llm.common import read_table, shared_dir


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = mixing.quality_weights(read_table(spark, sf_dir, "labels"))
    out = mixing.mix(read_table(spark, sf_dir, "documents"), weights)
    return out.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read_table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/corpus/warc-{uuid.uuid4().hex}")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return linedup.line_dedup(docs, min_words=50).select("doc_id", "n_lines", "n_removed", "words_removed", "found_in", "text")


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(read_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read_table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read_table(spark, sf_dir, "documents"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), capacity=2048)


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddup.near_vectors(read_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.product_codes(read_table(spark, sf_dir, "embeddings")).drop("label")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), components=16)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_and_decode(read_table(spark, sf_dir, "documents"))
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _nearest(round_: int) -> str:
    """SQL of one assignment: the nearest entry of every part by ``books{round_}``, ties to the lower index."""
    return f"""
        near{round_} AS (
          SELECT r, part, x, min(d * 64 + entry)::BIGINT % 64 AS entry, min(d)::BIGINT AS d
          FROM (SELECT p.r, p.part, p.x, b.entry, list_sum([(p.x[j] - b.c[j]) * (p.x[j] - b.c[j]) FOR j IN range(1, w + 1)]) AS d
                FROM parts p JOIN books{round_} b USING (part), w) GROUP BY r, part, x)"""


def _means(round_: int) -> str:
    """SQL of the codebooks after ``near{round_}``: floored means, unused entries as they were."""
    return f"""
        books{round_ + 1} AS (
          SELECT b.part, b.entry, COALESCE(g.c, b.c) AS c FROM books{round_} b LEFT JOIN (
            SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c
            FROM (SELECT part, entry, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM near{round_}, w, range(1, w + 1) t(j) GROUP BY part, entry, j)
            GROUP BY part, entry) g USING (part, entry))"""


QUERIES = {
    "op1_mix": op1_mix,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_lines": op4_lines,
    "op5_shard": op5_shard,
    "op6_secrets": op6_secrets,
    "op7_langid": op7_langid,
    "op8_exact": op8_exact,
    "op9_pack": op9_pack,
    "op10_vectors": op10_vectors,
    "op11_codes": op11_codes,
    "op12_whitening": op12_whitening,
    "op13_bpe": op13_bpe,
}

ORACLE_SQL = {
    "op11_codes": f"""
        WITH v AS (
          SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS q
          FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        w AS (SELECT max(len(q)) // 16 AS w FROM v),
        parts AS (SELECT r, i AS part, q[i * w + 1 : (i + 1) * w] AS x FROM v, w, range(16) t(i)),
        books0 AS (SELECT part, r - 1 AS entry, x AS c FROM parts WHERE r <= 64),{_nearest(0)},{_means(0)},{_nearest(1)},{_means(1)},{_nearest(2)},
        e AS (SELECT r, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY r),
        h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books2)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN e USING (r), h""",
    "op1_mix": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        q AS (SELECT doc_id, round(avg(quality))::INT AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        k AS (SELECT d.*, -ln((('0x' || substr(md5('7:' || COALESCE(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5e0) / 281474976710656e0)
                / CASE q.q WHEN 1 THEN 2e0 WHEN 0 THEN 0.5e0 ELSE 1e0 END AS key
              FROM d LEFT JOIN q USING (doc_id)),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
        f(i, share, n) AS (
          SELECT 0, 0e0, -1::BIGINT
          UNION ALL
          SELECT i + 1,
                 (SELECT (sum(source_size) - COALESCE(sum(3 * source_size) FILTER (3 * source_size < w * share), 0))::DOUBLE
                         / (sum(w) FILTER (NOT 3 * source_size < w * share))::DOUBLE FROM s),
                 (SELECT count(*) FROM s WHERE 3 * source_size < w * share)
          FROM f WHERE i < 60),
        h AS (SELECT max(share) AS share FROM f),
        t AS (SELECT source, source_size, least(3e0 * source_size, w * share) AS target FROM s, h),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
        c AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
                sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) - k.size / 2e0 AS middle
              FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, size, source_size, round(target, 3) AS target,
               (size * (epochs + CASE WHEN middle < budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM c""",
    "op2_warc": r"""
        WITH p AS (SELECT page_id, encode(COALESCE(html, '')) AS b FROM pages),
        f AS (SELECT page_id, octet_length(b)::BIGINT AS n, lower(sha1(b)) AS h FROM p),
        g AS (SELECT f.*, max(page_id) OVER (PARTITION BY h, n) AS keep FROM f)
        SELECT page_id, n AS payload_bytes, h AS payload_digest,
               CASE WHEN n >= 1000 AND page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id < keep THEN keep END AS refers_to FROM g""",
    "op8_exact": r"""
        WITH d AS (SELECT doc_id, length(COALESCE(text, '')) AS n, regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents),
        g AS (SELECT *, count(*) OVER (PARTITION BY body) AS group_size,
                first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id FROM d)
        SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g""",
}
