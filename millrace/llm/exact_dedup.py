"""Exact duplicates: 128-bit content hash, byte comparison inside hash groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, free_name, marked_members, maybe_members, member_filter, quoted


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Group equal texts; one row per row of docs: id, keep_id, group_size, kept, text_sha256.

    keep: "min" or "max" of the ids of a group stays. The hash is MD5 (128 bits). Texts of hash groups
    with two rows or more are regrouped by hash and bytes, so colliding texts part. That regrouping
    combines on the map side, so a group that holds a third of all rows sends one row per task; only
    texts of such groups are shuffled at all, chosen by a filter of fixed size. The joins that hand
    results back to rows carry ids and digests, and AQE may split a hot digest.

    Null text counts as empty. A null id never stays while its group has another id. Repeated rows with
    the same id and text are members each, and each of them is kept if their id stays. Other columns of
    docs are ignored. No rows: no rows.
    """
    ws = Workspace(docs.sparkSession)
    rows = docs.select(quoted(id_col).alias("_id"), F.coalesce(quoted(text_col), F.lit("")).alias("_text"))
    hashed = rows.withColumn("_h", F.unhex(F.md5("_text")))
    keys = ws.table(hashed.select("_id", "_h", F.unhex(F.sha2("_text", 256)).alias("_s")), "keys")
    repeated = keys.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h")
    repeated = ws.table(repeated, "repeated")

    best = F.max("_id") if keep == "max" else F.min("_id")
    by_bytes = (
        maybe_members(hashed, F.col("_h"), member_filter(repeated, "_h"))
        .groupBy("_h", "_text")
        .agg(F.count("*").alias("_n"), best.alias("_keep"))
        .where("_n > 1")
        .select("_h", F.unhex(F.sha2("_text", 256)).alias("_s"), "_n", "_keep")
    )
    groups = ws.table(by_bytes, "groups").select(F.col("_h").alias("_gh"), F.col("_s").alias("_gs"), "_n", "_keep")
    joined = keys.join(groups, (F.col("_h") == F.col("_gh")) & (F.col("_s") == F.col("_gs")), "left")
    keep_id = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return joined.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("_s")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one whole row of each text: that of the smallest id, and of several rows with this id any one by content.

    Found as in exact_duplicates(): rows of an MD5 that occurs twice are grouped by hash and bytes, so
    colliding texts part and a large group combines on the map side; all other rows pass at once. Null
    and empty text are equal, and the row that stays keeps its own. A null id stays only where a text has
    no other. Decisions go by row: other texts under the same id aren't touched. Columns of any name pass
    unchanged. No rows: no rows.
    """
    ws = Workspace(docs.sparkSession)
    names, hash_, text, row = docs.columns, free_name(docs, "_h"), free_name(docs, "_text"), free_name(docs, "_row")
    hashed = docs.withColumn(hash_, F.unhex(F.md5(F.coalesce(quoted(text_col), F.lit("")))))
    repeated = hashed.groupBy(hash_).agg(F.count("*").alias("_n")).where("_n > 1").select(hash_)
    repeated = ws.table(repeated, "repeated")
    marked, maybe = marked_members(hashed, F.col(hash_), member_filter(repeated, hash_))
    whole = F.struct(*map(quoted, names))
    order = F.struct(quoted(id_col).isNull(), quoted(id_col), F.xxhash64(F.to_json(whole)))
    single = (
        marked.where(F.col(maybe))
        .groupBy(hash_, F.coalesce(quoted(text_col), F.lit("")).alias(text))
        .agg(F.min_by(whole, order).alias(row))
        .select(*(F.col(row).getField(n).alias(n) for n in names))
    )
    return marked.where(~F.col(maybe)).select(*map(quoted, names)).unionAll(single)
