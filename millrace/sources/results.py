"""Results of jobs as text: key-sorted files, one per reducer."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reducer_of


def result_lines(results: DataFrame) -> DataFrame:
    """`key: result` of rows (key, second column)."""
    key, result = results.columns[:2]
    return results.select(F.concat(F.col(key), F.lit(": "), F.col(result).cast("string")).alias("value"))


def job_folder(root: str, job: str) -> str:
    return f"{root.rstrip('/')}/res-{job}"


def write_results(results: DataFrame, root: str, job: str, reducers: int) -> str:
    """Write (key, result) to root/res-<job>, a reducer's keys in ascending byte order in a file of its own.

    An existing folder is an error. Reducers without keys may leave no file.
    """
    key = F.col(results.columns[0])
    dealt = results.withColumn("_r", reducer_of(key, reducers)).repartitionById(reducers, "_r")
    ordered = dealt.sortWithinPartitions(key).drop("_r")
    path = job_folder(root, job)
    result_lines(ordered).write.mode("errorifexists").option("lineSep", "\n").text(path)
    return path


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def download_results(spark: SparkSession, root: str, job: str, to: str) -> list[str]:
    """Copy a job's result files to a local folder; their names."""
    fs, folder = _fs(spark, job_folder(root, job))
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    Path(to).mkdir(parents=True, exist_ok=True)
    names = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-"):
            fs.copyToLocalFile(False, status.getPath(), jvm_path(f"file://{Path(to).resolve()}/res-{job}-{name}"), True)
            names.append(f"res-{job}-{name}")
    return sorted(names)


def delete_results(spark: SparkSession, root: str, job: str) -> bool:
    fs, folder = _fs(spark, job_folder(root, job))
    return bool(fs.delete(folder, True))
