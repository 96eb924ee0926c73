"""Lines and pairs out of files that Spark can reach."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pair_fields


class MissingInput(FileNotFoundError):
    """An input isn't there; found before any work begins."""


def strip_return(line: Column) -> Column:
    return F.regexp_replace(line, r"\r$", "")


def lines(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """One row `value` per line of all paths, each path once. A line ends at \\n; one \\r before it goes."""
    wanted = list(dict.fromkeys([paths] if isinstance(paths, str) else paths))
    try:
        return spark.read.option("lineSep", "\n").text(wanted).select(strip_return(F.col("value")).alias("value"))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise MissingInput(f"file not found: {', '.join(wanted)}") from e
        raise


def pairs(rows: DataFrame) -> DataFrame:
    """(key, value) of lines `key<tab>value`; lines without a tab are left out."""
    both = pair_fields(F.col("value"))
    return rows.where(F.size(both) == 2).select(F.get(both, F.lit(0)).alias("key"), F.get(both, F.lit(1)).alias("value"))


def parse_results(rows: DataFrame) -> DataFrame:
    """(key, n) of lines `key: n`, the last such sign counting; lines of another form are left out."""
    form = r"^(.*): (\S+)\s*$"
    got = rows.where(F.col("value").rlike(form)).select(
        F.regexp_extract("value", form, 1).alias("key"), F.regexp_extract("value", form, 2).try_cast("long").alias("n")
    )
    return got.where("n IS NOT NULL")


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """(key, n) of all result files in a folder."""
    return parse_results(lines(spark, folder))
