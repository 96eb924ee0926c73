"""Reports over (key, n) results and over pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import reducer_of


def sum_by_key(results: DataFrame) -> DataFrame:
    """(key, n) summed over all result files."""
    return results.groupBy("key").agg(F.sum("n").alias("n"))


def top_n(results: DataFrame, n: int) -> DataFrame:
    """The n rows of highest n; of equals the least key. Each task keeps n rows, so nothing is sorted whole."""
    return results.orderBy(F.desc("n"), "key").limit(n)


def total_unique(keys: DataFrame) -> DataFrame:
    """One row `total`: the number of distinct keys, exact."""
    return keys.groupBy("key").agg(F.lit(1).alias("one")).agg(F.count("*").alias("total"))


def reducer_layout(keys: DataFrame, reducers: int) -> DataFrame:
    """(r, n): emitted keys per reducer."""
    return keys.groupBy("key").agg(F.count("*").alias("k")).groupBy(reducer_of(F.col("key"), reducers).alias("r")).agg(F.sum("k").alias("n"))


def bytes_per_reducer(pairs: DataFrame, reducers: int) -> DataFrame:
    """(r, bytes): what lines `key<tab>value` of pairs take per reducer. Equal pairs are hashed once."""
    size = F.octet_length("key") + F.octet_length("value") + 2
    counted = pairs.groupBy("key", "value").agg(F.count("*").alias("k"))
    return counted.groupBy(reducer_of(F.col("key"), reducers).alias("r")).agg(F.sum(size * F.col("k")).alias("bytes"))


def group_values(pairs: DataFrame, parts: int = 1) -> DataFrame:
    """(key, vals): all values of a key, ascending, joined by commas. A row per key holds them all, as the result does.

    With more parts (key, part, vals): values go by their hash to that many rows a key, each ascending, so a
    hot key's values are dealt over tasks and no row holds them all. Equal values share a part.
    """
    vals = F.array_join(F.array_sort(F.collect_list("value")), ",").alias("vals")
    if parts == 1:
        return pairs.groupBy("key").agg(vals)
    return pairs.groupBy("key", F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int").alias("part")).agg(vals)


def node_totals(nodes: DataFrame) -> DataFrame:
    """One row (used_space, free_space): sums over a table of storage nodes; zeros for no nodes."""
    return nodes.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("used_space", "free_space")))
