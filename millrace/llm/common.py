"""What several operators share: written intermediate tables, a filter of fixed size, settings."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package

PII_KEY = "millrace demonstration key"  # of the queries; the pipeline takes another one from the session, see pii_key()

_made: list[tuple[SparkSession, str]] = []
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="millrace-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return _local[0]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _made:
        try:
            _remove(spark, path)
        except Exception:  # the session may have ended already, and took its gateway with it
            return


def prepare(spark: SparkSession) -> None:
    """The package on executors, and small Arrow batches unless the session has sizes of its own.

    Rows here are whole texts, and Spark's 10,000 rows or 64 MB are held several times on either side of
    each Python worker; 1,024 rows or 8 MB are as fast.
    """
    ship_package(spark)
    for name, usual, ours in (("maxRecordsPerBatch", "10000", "1024"), ("maxBytesPerBatch", "67108864b", "8m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", ours)


class Workspace:
    """Intermediate tables of one operator call, as Parquet in the shared folder.

    A written table cuts lineage: a lost executor costs a reread of its splits and no recomputation.
    The folder goes when the driver ends, or through drop() as soon as a table isn't needed.
    """

    def __init__(self, spark: SparkSession):
        prepare(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/millrace-{uuid.uuid4().hex}"
        _made.append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.spark, self.path(name))

    def sweep(self) -> None:
        """Shuffle files of jobs that are over go: Spark deletes them once the driver has collected what refers to them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {n.lower() for n in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def member_filter(keys: DataFrame, key: str, bits: int = 1 << 25) -> DataFrame:
    """A one-hash Bloom filter of keys[key], as rows (bucket, bitmap) of `bits` bits in all.

    Its size is fixed (4 MB by default) whatever the input, so it may be broadcast. Beyond about
    `bits` keys it lets everything through: the work grows then, the result stays the same.
    """
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(bits)).cast("long")
    return (
        keys.select(at.alias("_at"))
        .groupBy(F.call_function("bitmap_bucket_number", F.col("_at")).alias("_bucket"))
        .agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("_at"))).alias("_bitmap"))
    )


def marked_members(df: DataFrame, key: Column, filter_rows: DataFrame, bits: int = 1 << 25) -> tuple[DataFrame, str]:
    """df with one more boolean column, and its name: whether the key is perhaps among those of member_filter(); never false for one that is."""
    names = df.columns
    at, bucket, bitmap, maybe = (free_name(df, f"_{n}") for n in ("at", "bucket", "bitmap", "maybe"))
    position = F.call_function("bitmap_bit_position", F.col(at))
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = (
        df.withColumn(at, F.pmod(F.xxhash64(key), F.lit(bits)).cast("long"))
        .withColumn(bucket, F.call_function("bitmap_bucket_number", F.col(at)))
        .join(F.broadcast(filter_rows.toDF(bucket, bitmap)), bucket, "left")
    )
    found = F.coalesce(F.getbit(byte, (position % 8).cast("int")), F.lit(0)) == 1
    return joined.select(*map(quoted, names), found.alias(maybe)), maybe


def maybe_members(df: DataFrame, key: Column, filter_rows: DataFrame, bits: int = 1 << 25) -> DataFrame:
    """Rows of df whose key is perhaps among those of member_filter(); never loses a row that is."""
    marked, maybe = marked_members(df, key, filter_rows, bits)
    return marked.where(F.col(maybe)).drop(maybe)


def without_ids(docs: DataFrame, removed: DataFrame, id_col: str) -> DataFrame:
    """Rows of docs whose id isn't in removed[id_col]; rows with a null id stay. Columns of any name pass unchanged.

    Only rows that a fixed-size filter takes for removed are shuffled; all others pass at once.
    """
    gone = free_name(docs, "_gone")
    ids = removed.select(quoted(id_col).alias(gone)).where(F.col(gone).isNotNull()).distinct()
    marked, maybe = marked_members(docs, quoted(id_col), member_filter(ids, gone))
    passed = marked.where(~F.col(maybe)).drop(maybe)
    rest = marked.where(F.col(maybe)).drop(maybe)
    return passed.unionAll(rest.join(ids, quoted(id_col) == F.col(gone), "left_anti"))


def pii_key(spark: SparkSession) -> str:
    """The key of the session's pseudonyms (spark.millrace.piiKey), or the demonstration key where none is set."""
    return spark.conf.get("spark.millrace.piiKey", None) or PII_KEY


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
