"""Registered queries of the corpus operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, classifier, neardup, packing, pieces, quality, scoring, secrets, substring, topk_search
from .shared import bound_batches

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bound_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest_documents(table(spark, sf_dir, "documents"), PIECE_BPE)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk_search.quantize(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digests(secrets.scan_documents(table(spark, sf_dir, "documents")))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("failed_rule")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest_kept(table(spark, sf_dir, "documents"))


def op7_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_documents(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat.read_back(chat.format_conversations(rows.unionByName(extra)))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_pieces": op2_pieces,
    "op3_chat": op3_chat,
    "op4_packing": op4_packing,
    "op5_neardup": op5_neardup,
    "op6_scoring": op6_scoring,
    "op7_classifier": op7_classifier,
    "op8_substring": op8_substring,
    "op9_topk": op9_topk,
    "op10_secrets": op10_secrets,
    "pipeline": pipeline,
}

ORACLE: dict[str, str] = {
    "op5_neardup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, s FROM (
                SELECT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
                UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4
            )
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * pairs.n >= 85 * (p.n + q.n - pairs.n)
        ), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
        least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM documents LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
    """,
    "op8_substring": r"""
        WITH w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
        ), windows AS (
            SELECT doc_id, i, array_to_string(list_slice(words, i, i + 19), ' ') AS k
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)
        ), later AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1
        ), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
        each_word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
        left_over AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM each_word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN left_over USING (doc_id)
    """,
    "op1_quality": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents
        ), windows AS (
            SELECT doc_id, i, list_slice(words, i, i + 7) AS w
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d)
        ), twice AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
        ), repeats AS (
            SELECT doc_id, count(DISTINCT p) AS n_repeat_words
            FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
        ), base AS (
            SELECT doc_id, text, lines, CAST(len(words) AS BIGINT) AS n_words,
                   CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
                   CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                   CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
            FROM d LEFT JOIN repeats USING (doc_id)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
               NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
               AND NOT (10 * n_symbols > n_words)
               AND NOT (word_chars < 2 * n_words OR word_chars > 14 * n_words)
               AND NOT (2 * n_dup_lines > len(lines))
               AND NOT (10 * (length(text) - length(regexp_replace(text, '[^\p{L}\s]', '', 'g'))) > 4 * word_chars)
               AND NOT (10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) > 9 * len(lines))
               AND NOT (10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 3 * len(lines)) AS kept
        FROM base
    """,
    "op3_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), e AS (
            SELECT *, role IS NOT DISTINCT FROM lag(role) OVER w AS joined,
                   2 * length(text) - length(regexp_replace(text, '[\\#<]', '', 'g')) AS coded,
                   2 * length(role) - length(regexp_replace(role, '[\\#<\n]', '', 'g')) AS coded_role
            FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(coded + CASE WHEN joined THEN 5 ELSE 4 + coded_role + 1 + 8 END) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op9_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS terms
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, d.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.terms, d.terms), lambda t: t[1] * t[2])) AS BIGINT) AS score
            FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
}
