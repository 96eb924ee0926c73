"""A corpus pipeline: quality, exact and near duplicates, personal data, packing.

Every stage decides by row: a repeated id never takes another row's text with it, equal rows count as copies of each
other, null ids as any other, and columns of any name pass. Null text counts as empty. An empty table gives one.
"""

from __future__ import annotations

from millrace.llm.common import Workspace, free_name, pii_key, quoted, tokenizer_path, without_ids
from millrace.llm.exact_dedup import without_copies
from millrace.llm.near_dedup import near_duplicates
from millrace.llm.packing import pack_documents
from millrace.llm.pii import pseudonymize
from millrace.llm.quality import TOP_GRADE, graded_labels, keep_good, train
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the top grade with a probability of 0.6 or more, neither poor nor toxic; the model is fitted on the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs, train(docs, graded_labels(labels), TOP_GRADE + 1), TOP_GRADE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that of the smallest id."""
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles one row stays, that of the smallest id (a null one only if all are null).

    Rows are numbered in a written table, so that ids that are null or repeated can't stand for each other.
    Documents without words are linked with nothing and stay.
    """
    ws, row = Workspace(spark), free_name(docs, "_row")
    rows = ws.table(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows, width=5, num=80, den=100, id_col=row).select(F.col(row).alias("n"), F.col("component_id").alias("c"))
    found = ws.table(found, "found")
    groups = found.groupBy("c").agg(F.count("*").alias("size")).where("size > 1").select(F.col("c").alias("g"))
    members = found.join(groups, F.col("c") == F.col("g")).select("c", "n")
    named = members.join(rows.select(F.col(row).alias("at"), quoted("doc_id").alias("id")), F.col("n") == F.col("at"))
    ranked = named.select("c", F.struct(F.col("id").isNull().alias("no_id"), "id", "n").alias("rank"))
    best = ranked.groupBy("c").agg(F.min("rank")["n"].alias("stays")).select(F.col("c").alias("of"), "stays")
    gone = ws.table(members.join(best, F.col("c") == F.col("of")).where("n <> stays").select(F.col("n").alias(row)), "gone")
    return without_ids(rows, gone, row).drop(row)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of the same format, under the session's key; n_chars follows the text."""
    done = pseudonymize(docs, pii_key(spark))
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2,048 ids."""
    pieces = pack_documents(docs, tokenizer_path("word_bpe_49k.json"), memo_pieces=300_000)  # workers hold other stages' memos too
    return pieces.withColumn("length", F.size("ids").cast("long"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]
ORACLE_SQL = None  # a fitted model and a tokenizer decide; tests/llm compares with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is a table in the shared folder until the next is written."""
    ws = Workspace(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = ws.table(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
