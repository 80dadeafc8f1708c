"""The queries of this subpackage: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary; it is part of the Python environment of driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholium.llm.jaccard_join import ngram_jaccard_join

    return ngram_jaccard_join(_docs(spark, sf_dir))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholium.llm.shared import new_path
    from scholium.llm.warc import page_records, write_pages

    path = new_path(spark, "warc")
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return page_records(spark, path)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholium.llm.byte_bpe import with_byte_bpe

    return with_byte_bpe(_docs(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"))


def op4_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholium.llm.classifier import quality_ranking
    from scholium.llm.rows import remainder

    return quality_ranking(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder("doc_id", 5) == 0)


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholium.llm.rows import remainder
    from scholium.llm.suffix_tree import suffix_tree_scores

    return suffix_tree_scores(_docs(spark, sf_dir), remainder("doc_id", 10) == 0, depth=None)


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholium.llm.packing import harmonic_pack

    return harmonic_pack(_docs(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholium.llm.quality_rules import compression_bands

    return compression_bands(_docs(spark, sf_dir))


def op8_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholium.llm.language import language_of
    from scholium.llm.rows import remainder

    return language_of(_docs(spark, sf_dir), remainder("doc_id", 3) == 1)


def op9_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from scholium.llm.knn import voronoi_top_k

    return voronoi_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op10_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholium.llm.substring_dedup import substring_dedup

    return substring_dedup(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_warc": op2_warc,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_bradley_terry": op4_bradley_terry,
    "op5_suffix_tree": op5_suffix_tree,
    "op6_harmonic_packing": op6_harmonic_packing,
    "op7_compression_bands": op7_compression_bands,
    "op8_cross_parsing": op8_cross_parsing,
    "op9_voronoi_knn": op9_voronoi_knn,
    "op10_fm_index": op10_fm_index,
}
WORDS = r"[^\x20\x09-\x0D]+"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), '{WORDS}') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
              ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
        c AS (SELECT DISTINCT a AS doc_id, a AS reach FROM l UNION SELECT l.a, c.reach FROM c JOIN l ON l.b = c.doc_id)
        SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, min(c.reach))::BIGINT AS component_id,
               coalesce(max(m.n_links), 0)::BIGINT AS n_links
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.doc_id = d.doc_id
             LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a) m ON m.doc_id = d.doc_id GROUP BY d.doc_id
    """,
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        q AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest, body FROM p),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM q)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM r
    """,
    "op9_voronoi_knn": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT DISTINCT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
              FROM e q JOIN e x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """,
    "op10_fm_index": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
        w AS (SELECT doc_id, p, md5(array_to_string(ws[p:p+49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS p FROM d)),
        r AS (SELECT doc_id, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS m FROM w) WHERE m < doc_id),
        g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM r),
        a AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
        FROM d LEFT JOIN a USING (doc_id)
    """,
}
