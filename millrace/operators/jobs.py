"""The built-in jobs. A job maps a line to keys; its reduce counts, so counts combine before the shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import host_name, tab_fields, white_fields, words


def _field(n: int) -> Callable[[DataFrame], DataFrame]:
    def keys(rows: DataFrame) -> DataFrame:
        fields = tab_fields(F.col("value"))
        return rows.where(F.size(fields) > n).select(F.get(fields, F.lit(n)).alias("key"))

    return keys


def _words(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(words(F.col("value"))).alias("key"))


def _hosts(rows: DataFrame) -> DataFrame:
    # A lambda's variable keeps the optimizer from repeating the search for fields wherever the URL is used, and the
    # generator from repeating the host in a filter.
    url = F.slice(white_fields(F.col("value")), 4, 1)
    hosts = F.filter(F.transform(url, host_name), lambda host: host != "")
    return rows.select(F.explode(hosts).alias("key"))


# Of each line: its words; the third and the fourth field between tabs (an empty one counts); the host of the fourth
# field between white space.
JOBS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "wordcount": _words,
    "unique_ips": _field(2),
    "unique_urls": _field(3),
    "unique_domains": _hosts,
}


def emitted(job: str, rows: DataFrame) -> DataFrame:
    """Keys that a job's map emits for lines (column value), one row each."""
    if job not in JOBS:
        raise ValueError(f"no job {job!r}; there are {', '.join(JOBS)}")
    return JOBS[job](rows)


def run_job_columns(job: str, rows: DataFrame) -> DataFrame:
    """(key, n): how often a job's map emits each key."""
    return emitted(job, rows).groupBy("key").agg(F.count("*").alias("n"))
