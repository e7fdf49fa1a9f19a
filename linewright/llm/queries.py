"""The operators as queries over the test tables, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm import (
    clusters,
    licenses,
    merkle,
    personal,
    phrases,
    pieces,
    quality,
    repeats,
    shards,
    simhash,
    topk,
    toxicity,
    warc,
)
from linewright.llm.common import table

# Fixed values of the queries.
MODEL_NAME = "piece_bpe_32k.model"
EVERY = 100
BEST = 10
N_SHARDS = 24


def model_bytes(path: str | None = None) -> bytes:
    """A SentencePiece model's file; by default the one of the public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL_NAME)
    return Path(path).read_bytes()


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.without_repeats(table(spark, sf_dir, "documents")))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.nearest(vectors, F.col("vec_id") % EVERY == 0, BEST)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("text_key")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.sharded(table(spark, sf_dir, "documents"), N_SHARDS)
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digests(personal.find_personal(table(spark, sf_dir, "documents")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url", "payload")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    written = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", written, "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return phrases.digests(phrases.contamination(documents, benchmark))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode(table(spark, sf_dir, "documents"), model_bytes()))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.digests(*clusters.clustered(table(spark, sf_dir, "embeddings")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = merkle.tampered_text(F.col("doc_id"), F.col("text"))
    documents = table(spark, sf_dir, "documents")
    return merkle.digests(merkle.manifest(documents, changed={"text": text}))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_substring_dedup,
        op2_topk_search,
        op3_quality_classifier,
        op4_license_scan,
        op5_sharding,
        op6_personal_data,
        op7_warc,
        op8_simhash,
        op9_decontamination,
        op10_sentencepiece,
        op11_centroid_clustering,
        op12_merkle_manifest,
        op13_toxicity,
    )
}


def _clustering_sql(rounds: int = 10) -> str:
    """The rounds of op11, one after the other."""
    distance = """list_sum(list_transform(range(1, 65),
                      lambda i: (v.parts[i] - c.parts[i]) * (v.parts[i] - c.parts[i])))::BIGINT"""
    steps = [
        """whole AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)
                   AS parts
            FROM embeddings
            WHERE len(embedding) = 64
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS MATERIALIZED (
            SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INTEGER AS cluster,
                   parts
            FROM whole ORDER BY sha256('3:' || vec_id) LIMIT 8
        )"""
    ]
    for at in range(rounds + 1):
        steps.append(f"""a{at} AS MATERIALIZED (
            SELECT vec_id, any_value(parts) AS parts, min(place) AS place
            FROM (SELECT v.vec_id, v.parts, [{distance}, c.cluster] AS place
                  FROM whole v, c{at} c)
            GROUP BY vec_id
        )""")
        if at < rounds:
            steps.append(f"""c{at + 1} AS MATERIALIZED (
            SELECT c.cluster, coalesce(moved.parts, c.parts) AS parts
            FROM c{at} c LEFT JOIN (
                SELECT place[2] AS cluster, list_transform(range(1, 65), lambda i:
                           (list_sum(list_transform(list(parts), lambda p: p[i]))::BIGINT
                            - (list_sum(list_transform(list(parts), lambda p: p[i]))::BIGINT
                               % count(*) + count(*)) % count(*)) // count(*)) AS parts
                FROM a{at} GROUP BY place[2]) moved ON c.cluster = moved.cluster
        )""")
    return f"""
        WITH {", ".join(steps)}
        SELECT vec_id, cluster, place[1] AS distance,
               (sum(place[1]) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
               (sum(place[1]) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c.parts, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON a.place[2] = c.cluster
    """


ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH words AS MATERIALIZED (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'),
                                       lambda w: w <> '') AS words
            FROM documents
        ), starts AS MATERIALIZED (
            SELECT doc_id, unnest(range(len(words) - 34)) AS start,
                   unnest(list_transform(range(len(words) - 34),
                          lambda i: md5(array_to_string(words[i + 1:i + 35], ' ')))) AS digest
            FROM words WHERE len(words) >= 35
        ), again AS (
            SELECT digest FROM starts GROUP BY digest HAVING count(*) > 1
        ), covered AS (
            SELECT doc_id, list_distinct(flatten(list(range(start, start + 35)))) AS gone
            FROM starts JOIN again USING (digest) GROUP BY doc_id
        )
        SELECT doc_id, len(words)::BIGINT AS n_words,
               coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE
                   list_select(words, list_sort(list_transform(
                       list_except_all, lambda i: i + 1))) END, ' ')) AS kept_sha256
        FROM (SELECT words.doc_id, words, gone,
                     list_filter(range(len(words)), lambda i: NOT list_contains(gone, i))
                     AS list_except_all
              FROM words LEFT JOIN covered USING (doc_id))
    """,
    "op2_topk_search": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding,
                       lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS parts
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scores AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_sum(list_transform(range(1, len(q.parts) + 1),
                       lambda i: q.parts[i] * c.parts[i]))::BIGINT AS score
            FROM whole q, whole c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT query_id, row_number() OVER (
                       PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
                   vec_id, score
            FROM scores
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op7_warc": """
        WITH whole AS (
            SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))
                   AS payload_bytes
            FROM pages
        ), firsts AS (
            SELECT html, min(page_id) AS first_id FROM whole
            WHERE payload_bytes >= 100 GROUP BY html
        )
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
               CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM whole LEFT JOIN firsts USING (html)
    """,
    "op9_decontamination": r"""
        WITH docs AS MATERIALIZED (
            SELECT doc_id, list_filter(string_split_regex(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
            FROM documents
        ), items AS MATERIALIZED (
            SELECT item_id, list_filter(string_split_regex(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
            FROM benchmark WHERE text IS NOT NULL
        ), windows AS MATERIALIZED (
            SELECT DISTINCT item_id, least(13, len(words)) AS size,
                   unnest(list_transform(range(greatest(len(words) - 12, 1)),
                       lambda i: array_to_string(words[i + 1:i + 13], ' '))) AS gram
            FROM items WHERE len(words) > 0
        ), grams AS MATERIALIZED (
            SELECT doc_id, size, unnest(range(len(words) - size + 1)) AS start,
                   unnest(list_transform(range(len(words) - size + 1),
                       lambda i: array_to_string(words[i + 1:i + size], ' '))) AS gram
            FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size
        ), met AS MATERIALIZED (
            SELECT doc_id, item_id, start, size FROM grams JOIN windows USING (size, gram)
        ), hits AS (
            SELECT doc_id, len(list_distinct(flatten(list(range(start, start + size))))) AS n_hit
            FROM met GROUP BY doc_id
        ), owners AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met WHERE item_id IS NOT NULL)
            GROUP BY doc_id
        )
        SELECT docs.doc_id, len(words)::BIGINT AS n_words,
               coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
        FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN owners USING (doc_id)
    """,
    "op11_centroid_clustering": _clustering_sql(),
    "op12_merkle_manifest": r"""
        WITH RECURSIVE checked AS (
            SELECT *, xor(4294967295, list_reduce(
                       list_concat([4294967295::BIGINT], list_transform(
                           string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                       lambda crc, byte: list_reduce(
                           list_concat([xor(crc, byte)], range(8)),
                           lambda c, n: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384)
                                             ELSE c >> 1 END))) AS crc
            FROM documents
        ), leaves AS MATERIALIZED (
            SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
                   list_transform([text, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '')
                                              ELSE text END],
                       lambda body: sha256(array_to_string(list_transform(
                           [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, body],
                           lambda x: coalesce(octet_length(encode(x)) || ':' || x, '-')), ''))
                   ) AS pair
            FROM checked
        ), trees AS (
            SELECT source, 0 AS level, list(pair[1] ORDER BY pos) AS nodes
            FROM leaves GROUP BY source
            UNION ALL
            SELECT source, level + 1, list_transform(range((len(nodes) + 2) // 3),
                       lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')))
            FROM trees WHERE len(nodes) > 1
        ), subroots AS MATERIALIZED (
            SELECT source, nodes[1] AS subroot,
                   row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos
            FROM trees WHERE len(nodes) = 1
        ), crown AS (
            SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots
            UNION ALL
            SELECT level + 1, list_transform(range((len(nodes) + 2) // 3),
                       lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')))
            FROM crown WHERE len(nodes) > 1
        ), places AS (
            SELECT doc_id, level, nodes, leaves.pos // (3 ** level)::BIGINT AS pos
            FROM leaves JOIN trees ON leaves.source IS NOT DISTINCT FROM trees.source
            WHERE len(nodes) > 1
            UNION ALL
            SELECT doc_id, 1000 + level, nodes, subroots.pos // (3 ** level)::BIGINT
            FROM leaves JOIN subroots ON leaves.source IS NOT DISTINCT FROM subroots.source, crown
            WHERE len(nodes) > 1
        ), paths AS (
            SELECT doc_id, list(
                       array_to_string(nodes[pos - pos % 3 + 1:pos], '') || '|' ||
                       array_to_string(nodes[pos + 2:pos - pos % 3 + 3], '')
                       ORDER BY level) AS beside
            FROM places GROUP BY doc_id
        ), folded AS (
            SELECT leaves.doc_id, pair[1] AS leaf, subroot, c.nodes[1] AS root,
                   sha256(replace(array_to_string(coalesce(beside, []), ''), '|', ''))
                   AS proof_sha256,
                   list_reduce(list_concat([pair[2]], coalesce(beside, [])),
                       lambda acc, x: sha256(split_part(x, '|', 1) || acc || split_part(x, '|', 2)))
                   AS folded_root
            FROM leaves JOIN subroots ON leaves.source IS NOT DISTINCT FROM subroots.source
                 LEFT JOIN paths ON leaves.doc_id = paths.doc_id,
                 (SELECT nodes FROM crown WHERE len(nodes) = 1) c
        )
        SELECT *, folded_root = root AS verified FROM folded
    """,
}
