"""The queries of the corpus operators: thin, each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out, identify, learn

    docs = table(spark, sf_dir, "documents")
    learnt = learn(docs, training=F.col("doc_id").isNotNull() & ~held_out())
    return identify(docs.select("doc_id", "text"), learnt).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), 4096, 1)


def mix_params():
    """The mix that the query and the pipeline ask for: languages to fixed shares, sources and topics flattened."""
    from .mixing import MixParams

    return MixParams(targets={"lang": {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15}})


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_report

    r = mix_report(table(spark, sf_dir, "documents"), mix_params())
    return r.select("doc_id", F.col("tokens").alias("n_tokens"), "topic", F.round("weight", 6).alias("weight"), F.round("prob", 6).alias("prob"), "selected", F.round("off", 6).alias("off_target"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import NearParams, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), NearParams(percent=85))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"))


def op5_kd_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_search import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op8_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report

    return report(table(spark, sf_dir, "documents"))


def op9_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mixing, op2_quality_rules, op3_language_id, op4_minhash_near_dedup, op5_kd_tree_search,
        op6_warc_round_trip, op7_line_dedup, op8_pii_boosting, op9_template_extraction, op10_best_fit_packing,
    )
}
#: Classes of equal sets first, then links between classes by shared shingles, then the least document reachable.
_NEAR_SQL = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    o AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM w),
    h AS (SELECT doc_id, i, n, concat_ws(' ', word, lead(word, 1) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d, lead(word, 4) OVER d) AS g
          FROM o WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    f AS (SELECT DISTINCT doc_id, g FROM h WHERE i <= greatest(1, n - 4)),
    s AS (SELECT doc_id, count(*) AS n, sha256(string_agg(g, chr(10) ORDER BY g)) AS s FROM f GROUP BY doc_id),
    c AS (SELECT s, min(doc_id) AS rep, min(n) AS n FROM s GROUP BY s),
    g AS (SELECT c.rep, c.n, f.g FROM c JOIN f ON f.doc_id = c.rep),
    e AS (SELECT x.rep AS a, y.rep AS b FROM g x JOIN g y ON x.g = y.g AND x.rep <> y.rep
          GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    m AS (SELECT a, min(b) AS low FROM r GROUP BY a),
    k AS (SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(least(c.rep, m.low), c.rep, w.doc_id) AS component_id
          FROM w LEFT JOIN s USING (doc_id) LEFT JOIN c ON s.s = c.s LEFT JOIN m ON m.a = c.rep)
    SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM k"""

ORACLE_SQL: dict[str, str] = {
    "op4_minhash_near_dedup": _NEAR_SQL,
    "op6_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS top, from_hex(sha1(html))::BIT::VARCHAR AS bits FROM p),
        e AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (1 + list_sum(list_transform(range(1, 6), lambda j: substr(bits, 5 * i + j, 1)::INT * (2 ** (5 - j))::INT)))::INT, 1)), '') AS payload_digest FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id < top THEN top END AS refers_to FROM e""",
    "op5_kd_tree_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
              FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
