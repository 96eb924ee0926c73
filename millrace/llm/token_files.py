"""Token ids as Parquet list columns, with controlled encodings, row groups and page indexes."""

from __future__ import annotations

import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare
from .memo_tokens import MEMO_PIECES, piece_memo, text_batches

FILE_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("shard_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("tokens", T.ArrayType(T.IntegerType(), False)),
    ]
)
DIGEST_SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long"


def list_array(blobs: list[bytes]):
    """Joined little-endian int32 blobs as an Arrow list column, without Python integers."""
    import numpy as np
    import pyarrow as pa

    ends = np.zeros(len(blobs) + 1, dtype=np.int32)
    np.cumsum([len(b) // 4 for b in blobs], out=ends[1:])
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(blobs))])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    kind: str = "space",
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    memo_pieces: int = MEMO_PIECES,
) -> None:
    """Tokenize whole texts, append end_id to each, and write Parquet files in ascending id order.

    Rows are range-partitioned by id and sorted, so part files follow one another in id order, and one
    task writes one file (its shard). tokens is dictionary encoded (about two bytes an id), doc_id and
    the counts are delta encoded; the writer adds column and offset indexes, so reads by id skip pages.
    Row groups and pages have the given sizes. `shard_start` counts the ids before a row in its shard.

    Null text counts as empty (the end id alone); null ids come first; rows with equal ids lie side by
    side in any order. Other columns are ignored. No rows: files without rows.
    """

    def tokenize(chunks):
        import pyarrow as pa

        memo, end = piece_memo(tokenizer_path, kind, memo_pieces), int(end_id).to_bytes(4, "little")
        shard, before = TaskContext.get().partitionId(), 0
        for part in text_batches(chunks):
            blobs = [b + end for b in memo.encode([t for _, t in part])]
            sizes = [len(b) // 4 for b in blobs]
            starts = []
            for n in sizes:
                starts.append(before)
                before += n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in part], pa.int64()),
                    pa.array([shard] * len(part), pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    list_array(blobs),
                ],
                names=FILE_SCHEMA.names,
            )

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    writer = ordered.mapInArrow(tokenize, FILE_SCHEMA).write
    options = {
        "compression": "snappy",
        "parquet.writer.version": "v2",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#shard_start": "false",
        "parquet.enable.dictionary#n_tokens": "false",
    }
    for name, value in options.items():
        writer = writer.option(name, value)
    writer.parquet(path)


def read_token_files(spark: SparkSession, path: str, ids: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of written files. ids reach the scan as a pushed filter (row groups and pages are skipped);
    columns other than tokens are read without touching token pages."""
    df = spark.read.schema(FILE_SCHEMA).parquet(path)
    if ids is not None:
        df = df.where(F.col("doc_id").isin([int(i) for i in ids]))
    return df.select(*columns) if columns else df


def token_digests(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of what the files hold.

    Only one row per shard is summed up in one place; a row's start is its shard's plus its own in it.
    """

    def digest(chunks):
        import numpy as np
        import pyarrow as pa

        for chunk in chunks:
            tokens = chunk.column("tokens")
            ends = tokens.offsets.to_numpy()
            ids = np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False)).astype("<u4", copy=False)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            sizes = pa.array((ends[1:] - ends[:-1]).astype("int64"))
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), chunk.column("shard"), chunk.column("shard_start"), sizes, pa.array(crc, pa.int64())],
                names=["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"],
            )

    prepare(files.sparkSession)
    rows = files.select(*FILE_SCHEMA.names).mapInArrow(digest, DIGEST_SCHEMA)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    from pyspark.sql import Window

    before = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "shard").select(
        "doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32"
    )
