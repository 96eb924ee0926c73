"""The subpackage's queries, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from .chat_format import canonical_turns, chat_digests, format_chats
from .common import PII_KEY, Workspace, tokenizer_path
from .exact_dedup import exact_duplicates
from .license_scan import scan_licenses
from .mpeg_audio import media_digests, texts_to_media
from .near_dedup import near_duplicates
from .packing import pack_documents, piece_digests
from .piece_tokens import encode_documents, round_trips
from .pii import pseudonymize
from .pii_sql import pseudonym_sql
from .quality import TOP_GRADE, grade, graded_labels, train
from .token_files import read_token_files, token_digests, write_token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, PII_KEY, count_col="n_found")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=2, num=80, den=100)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"), keep="max")


def op4_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    return round_trips(encode_documents(_table(spark, sf_dir, "documents"), path), path)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = canonical_turns(_table(spark, sf_dir, "conversations"))
    odd = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], turns.schema)
    return chat_digests(format_chats(turns.unionByName(own)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return grade(docs, train(docs, graded_labels(_table(spark, sf_dir, "labels")), TOP_GRADE + 1), TOP_GRADE)


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(texts_to_media(_table(spark, sf_dir, "documents")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark).path("tokens")
    write_token_files(_table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return token_digests(read_token_files(spark, path))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return piece_digests(pack_documents(docs, tokenizer_path("word_bpe_49k.json")))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_pii": op1_pii,
    "op2_near_dedup": op2_near_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_piece_tokens": op4_piece_tokens,
    "op5_chat_format": op5_chat_format,
    "op6_quality": op6_quality,
    "op7_mpeg_audio": op7_mpeg_audio,
    "op8_license_scan": op8_license_scan,
    "op9_token_files": op9_token_files,
    "op10_packing": op10_packing,
}

ORACLE_SQL = {
    "op1_pii": pseudonym_sql(PII_KEY),
    "op5_chat_format": r"""
        WITH given AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        turns AS (
            SELECT *, len(regexp_extract_all(text, '<\\*(?:/?s>|</?SYS>>)|\[\\*(?:/?INST\]|/?ROLE\]|TEXT\])')) AS broken,
                   CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 19 + length(role) END AS frame
            FROM given)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(text) + broken + frame)::bigint AS formatted_chars
        FROM turns GROUP BY conv_id""",
    "op2_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE
                   list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b
            ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * common >= 80 * (x.n + y.n - common)),
        ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other)
        SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
        FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
