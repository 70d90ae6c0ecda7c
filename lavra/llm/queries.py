"""The operators' queries over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.llm import attribution, bpe, gif, hardneg, langid, mixing, quality, secrets, simhash, toxicity, trie, vptree, warc
from lavra.runtime import materialise, shared_dir, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def op2_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digests(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


#: Shares of tokens wanted by language and by form; sources have their own shares, tempered.
TARGETS = {
    "lang": {"en": 0.45, "de": 0.2, "fr": 0.2, "es": 0.13, "(none)": 0.02},
    "topic": {"note": 0.05, "brief": 0.15, "article": 0.4, "long read": 0.4},
}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.calibrated(table(spark, sf_dir, "documents"), targets=TARGETS)
    return mixed.select("doc_id", *(F.col(f"mix_{x}").alias(x) for x in ("source", "lang", "topic", "tokens", "weight", "probability", "kept")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.counts(table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predictions(docs, langid.fit(docs))


def op10_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    return hardneg.mine(hardneg.integral(table(spark, sf_dir, "embeddings"), label=label), F.col("id") % 100 == 0)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/lavra/warc-{uuid.uuid4().hex}", payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = materialise(trie.placed(table(spark, sf_dir, "conversations")), "turns")
    return trie.trie(materialise(trie.shared_starts(own), "rebuilt"), own.where("pos = 1").select("conv_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_gif, op3_quality, op4_bpe, op5_secrets, op6_mixing, op7_toxicity, op8_token_counts, op9_langid, op10_vptree, op11_hard_negatives, op12_warc, op13_trie)}


def oracle_sql() -> dict[str, str]:
    return {
        "op10_vptree": """
            WITH v AS (
              SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
              WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            s AS (
              SELECT q.vec_id AS query_id, v.vec_id AS vec_id, max(list_inner_product(q.e, v.e)) AS score
              FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2),
            r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
        "op11_hard_negatives": """
            WITH v AS (
              SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
              FROM embeddings
              WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (
              SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
              FROM v AS a JOIN v AS b ON b.id <> a.id WHERE a.id % 100 = 0),
            p AS (
              SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
            n AS (
              SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
                row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
                AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
            SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
        "op12_warc": """
            WITH p AS (
              SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(encode(coalesce(html, ''))) AS payload_digest FROM pages),
            f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
            SELECT page_id, payload_bytes, payload_digest,
              CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
              CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
            FROM f""",
        "op13_trie": """
            WITH t AS (
              SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
              FROM conversations WHERE conv_id IS NOT NULL),
            bits AS (SELECT range AS n, range::UBIGINT AS c FROM range(256)),
            crc_table AS (
              SELECT n, list_reduce([c] || [0::UBIGINT FOR i IN range(8)], lambda acc, x:
                CASE WHEN acc % 2 = 1 THEN xor(acc >> 1, 3988292384::UBIGINT) ELSE acc >> 1 END) AS v FROM bits),
            lookup AS (SELECT list(v ORDER BY n) AS a FROM crc_table),
            ids AS (SELECT DISTINCT conv_id FROM t),
            h AS (
              SELECT conv_id, conv_id - conv_id % 100 AS base,
                xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT), lambda acc, x:
                  xor(acc >> 8, a[(xor(acc, x) % 256)::BIGINT + 1])), 4294967295::UBIGINT) % 6 AS h
              FROM ids, lookup),
            lead AS (SELECT h.conv_id, t.pos, t.role, t.text FROM h JOIN t ON t.conv_id = h.base AND t.pos <= h.h),
            rebuilt AS (
              SELECT * FROM lead
              UNION ALL
              SELECT t.conv_id, t.pos - h.h::BIGINT + coalesce((SELECT count(*) FROM lead WHERE lead.conv_id = t.conv_id), 0), t.role, t.text
              FROM t JOIN h ON h.conv_id = t.conv_id AND t.pos > h.h),
            path AS (
              SELECT conv_id, pos AS depth, length(text) AS points,
                md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ) OVER (PARTITION BY conv_id ORDER BY pos)) AS node
              FROM rebuilt
              UNION ALL
              SELECT conv_id, 0, 0, 'root' FROM ids),
            node AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(points) AS points FROM path GROUP BY depth, node),
            own AS (
              SELECT n.*, p.node AS parent FROM node n LEFT JOIN path p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
            kids AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM own WHERE depth > 0 GROUP BY ALL),
            full_node AS (
              SELECT own.*, coalesce(k.n_children, 0) AS n_children FROM own LEFT JOIN kids k ON k.depth = own.depth AND k.node = own.node),
            below AS (
              SELECT p.depth, p.node, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((f.n_convs - 1) * f.points)::BIGINT AS saved_tokens
              FROM full_node f JOIN path p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.depth, p.node),
            ends AS (
              SELECT depth, node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
              FROM (SELECT * FROM path QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY depth, node)
            SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves, b.saved_tokens,
              coalesce(e.ends_sha256, sha256('')) AS ends_sha256
            FROM full_node f JOIN below b ON b.depth = f.depth AND b.node = f.node
            LEFT JOIN node q ON q.depth = f.depth - 1 AND q.node = f.parent
            LEFT JOIN ends e ON e.depth = f.depth AND e.node = f.node""",
    }
