"""A catalog of datasets: files cut into checked chunks, and a log of what was put and deleted."""

from __future__ import annotations

import hashlib
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import base_name

CHUNK = 128 << 20
LEAST_CHUNK, MOST_CHUNK = 64 << 20, 256 << 20
LOG = "seq long, op string, name string, size long, chunks array<struct<id:int,size:long,md5:string>>"


def chunk_size(wanted: int) -> int:
    """A wanted chunk size within its bounds; 0 for the usual one."""
    return CHUNK if wanted == 0 else min(MOST_CHUNK, max(LEAST_CHUNK, wanted))


def fold_log(log: DataFrame) -> DataFrame:
    """(name, size) of what a log (seq, op, name, size) leaves: of each name the last entry counts, if it is a PUT."""
    last = log.groupBy("name").agg(F.max_by("op", "seq").alias("op"), F.max_by("size", "seq").alias("size"))
    return last.where("op = 'PUT'").select("name", "size")


META_LOG = (
    "op string, file_name string, file_meta struct<file_name:string,size:long,chunks:array<struct<chunk_id:long,nodes:array<string>,"
    "size:long,checksum:string>>,created_at:timestamp,lease_expiry:timestamp>"
)


def replay_log(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, n_chunks) of what a metadata log of JSON lines leaves; lines come in file order, broken ones are passed over.

    The order of lines is that of their places in the file, whichever tasks read them.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    rows = raw.select(place.alias("seq"), F.from_json("value", META_LOG).alias("e")).where("e.op IN ('PUT', 'DELETE') AND e.file_name IS NOT NULL")
    last = rows.groupBy(F.col("e.file_name").alias("name")).agg(F.max_by("e", "seq").alias("e"))
    return last.where("e.op = 'PUT'").select(
        "name", F.col("e.file_meta.size").alias("size"), F.coalesce(F.size("e.file_meta.chunks"), F.lit(0)).cast("long").alias("n_chunks")
    )


def cut_points(path: str, size: int) -> list[int]:
    """Ends of a file's chunks. Text chunks go on to the end of the line in which their last byte lies."""
    total, text = Path(path).stat().st_size, path.lower().endswith(".txt")
    cuts, at = [], 0
    with open(path, "rb") as f:
        while at < total:
            at = min(total, at + size)
            if text and at < total:
                f.seek(at - 1)
                f.readline()
                at = f.tell()
            cuts.append(at)
    return cuts


class Catalog:
    """Datasets under a root that Spark reaches. Reads go through Spark; put and get move local files."""

    def __init__(self, spark: SparkSession, root: str, chunk: int = 0):
        self.spark, self.root, self.chunk = spark, root.rstrip("/"), chunk_size(chunk)
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def log(self) -> DataFrame:
        if not self.fs.exists(self._path(f"{self.root}/_log")):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(f"{self.root}/_log")

    def _note(self, op: str, name: str, size: int, chunks: list[tuple]) -> None:
        row = self.spark.createDataFrame([(time.time_ns(), op, name, size, chunks)], LOG)
        row.coalesce(1).write.mode("append").json(f"{self.root}/_log")

    def list(self) -> DataFrame:
        """(name, size) of all datasets."""
        return fold_log(self.log())

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, local: str) -> str:
        """Copy a local file in, in chunks; its name. An existing name is an error."""
        name = Path(local).name
        if self.list().where(F.col("name") == name).head(1):
            raise FileExistsError(f"file already exists: {name}")
        self.fs.delete(self._path(self.folder(name)), True)  # of a put that didn't end
        chunks, start = [], 0
        for i, end in enumerate(cut_points(local, self.chunk)):
            with tempfile.NamedTemporaryFile() as part, open(local, "rb") as f:
                f.seek(start)
                data = f.read(end - start)
                part.write(data)
                part.flush()
                target = self._path(f"{self.folder(name)}/chunk-{i:06d}")
                self.fs.copyFromLocalFile(False, True, self._path(f"file://{part.name}"), target)
            chunks.append((i, end - start, hashlib.md5(data).hexdigest()))
            start = end
        self._note("PUT", name, start, chunks)
        return name

    def chunks(self, name: str) -> DataFrame:
        """(id, size, md5) of a dataset's chunks as the log has them."""
        last = self.log().where(F.col("name") == name).agg(F.max_by("op", "seq").alias("op"), F.max_by("chunks", "seq").alias("chunks"))
        return last.where("op = 'PUT'").select(F.inline("chunks"))

    def verify(self, name: str) -> DataFrame:
        """(id, ok) of each chunk, its bytes hashed where they lie."""
        found = (
            self.spark.read.format("binaryFile")
            .load(self.folder(name))
            .select(F.regexp_extract(base_name(F.col("path")), "([0-9]+)$", 1).cast("int").alias("id"), F.md5("content").alias("found"))
        )
        return self.chunks(name).join(found, "id", "left").select("id", F.coalesce(F.col("md5") == F.col("found"), F.lit(False)).alias("ok"))

    def get(self, name: str, to: str) -> str:
        """Copy a dataset out to a local folder and check it; the file's path."""
        known = self.chunks(name).orderBy("id").collect()
        if not known and not self.list().where(F.col("name") == name).head(1):
            raise FileNotFoundError(f"file not found: {name}")
        Path(to).mkdir(parents=True, exist_ok=True)
        out = Path(to) / name
        with out.open("wb") as whole, tempfile.TemporaryDirectory() as parts:
            for c in known:
                part = f"{parts}/{c.id}"
                self.fs.copyToLocalFile(False, self._path(f"{self.folder(name)}/chunk-{c.id:06d}"), self._path(f"file://{part}"), True)
                data = Path(part).read_bytes()
                if hashlib.md5(data).hexdigest() != c.md5:
                    raise OSError(f"chunk {c.id} of {name} is damaged")
                whole.write(data)
                Path(part).unlink()
        return str(out)

    def delete(self, name: str) -> None:
        if not self.list().where(F.col("name") == name).head(1):
            raise FileNotFoundError(f"file not found: {name}")
        self._note("DELETE", name, 0, [])
        self.fs.delete(self._path(self.folder(name)), True)
