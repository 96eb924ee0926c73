"""Queries over the harness tables, with the SQL that must give the same rows.

Access logs aren't among the tables: events and pages make one, whose lines are an event's id and type, an
address made of its user, and a page's URL, with tabs between.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as ops
from ..functions import tab_fields
from ..sources import fold_log, parse_results, read_results, result_lines, write_results

Query = Callable[[SparkSession, str], DataFrame]
REDUCERS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Texts of tables as one input. A word never goes over a line's end, so lines needn't be cut."""
    out = None
    for name in names or ("documents",):
        rows = table(spark, sf_dir, name).select(F.col("text").alias("value"))
        out = rows if out is None else out.unionAll(rows)
    return out


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n = pages.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_pages"))  # one row
    user = F.col("user_id")
    address = F.concat_ws(".", F.lit("10"), (F.floor(user / 256) % 256).cast("string"), (user % 256).cast("string"), F.lit("1"))
    events = table(spark, sf_dir, "events").crossJoin(F.broadcast(n)).select(
        "event_id", "event_type", address.alias("address"), (F.col("event_id") % F.col("n_pages")).alias("page_id")
    )
    line = F.concat_ws("\t", F.col("event_id").cast("string"), "event_type", "address", "url")
    return events.join(pages, "page_id").select(line.alias("value"))


def _log_job(job: str) -> Query:
    return lambda spark, d: ops.run_job_columns(job, log_lines(spark, d))


def wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.run_job_columns("wordcount", texts(spark, sf_dir))


def total(job: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = texts(spark, sf_dir) if job == "wordcount" else log_lines(spark, sf_dir)
        return ops.total_unique(ops.emitted(job, rows))

    return query


def top(job: str, n: int) -> Query:
    return lambda spark, d: ops.top_n(ops.run_job_columns(job, log_lines(spark, d)), n)


_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _cleanup() -> None:
    for spark, path in _made:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended already, and took its gateway with it
            return


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one; with a local master and none set, a temporary one. It goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(root or tempfile.gettempdir()).rstrip('/')}/millrace-results-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def results_roundtrip_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address counts written as result files, read back, parsed and summed."""
    path = write_results(ops.run_job_columns("unique_ips", log_lines(spark, sf_dir)), scratch(spark), "trip", REDUCERS)
    return ops.sum_by_key(read_results(spark, path))


def job_results_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts as result lines and parsed again, without files between."""
    return parse_results(result_lines(wordcount(spark, sf_dir)))


def log_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(address, event type) of each log line."""
    p = tab_fields(F.col("value"))
    return log_lines(spark, sf_dir).select(F.get(p, F.lit(2)).alias("key"), F.get(p, F.lit(1)).alias("value"))


def reducer_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.reducer_layout(ops.emitted("unique_ips", log_lines(spark, sf_dir)), REDUCERS)


def bytes_per_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ops.emitted("unique_ips", log_lines(spark, sf_dir)).withColumn("value", F.lit("1"))
    return ops.bytes_per_reducer(keys, REDUCERS)


def field_arity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of a log whose lines by pages of even numbers end after the second field."""
    even = F.col("value").rlike("/[0-9]*[02468]$")
    cut = F.when(even, F.substring_index("value", "\t", 2)).otherwise(F.col("value"))
    return ops.run_job_columns("unique_ips", log_lines(spark, sf_dir).select(cut.alias("value")))


def sorted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_job("unique_urls")(spark, sf_dir).orderBy("key")


def file_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("md5"))


def wal_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a log leaves whose entries are orders: the customer is a file, one in three entries deletes it."""
    op = F.when(F.col("o_orderkey") % 3 == 0, "DELETE").otherwise("PUT")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), op.alias("op"), F.concat(F.lit("f"), "o_custkey").alias("name"), F.floor("o_totalprice").cast("long").alias("size")
    )
    return fold_log(rows)


def _udf_words(line: bytes) -> list[tuple[bytes, bytes]]:
    import re

    return [(w.encode(), b"1") for w in re.findall(r"\w+", line.decode("utf-8", "replace").replace("İ", "i").lower(), re.ASCII)]


def _udf_address(line: bytes) -> list[tuple[bytes, bytes]] | None:
    parts = line.split(b"\t")
    return [(parts[2], b"1")] if len(parts) >= 3 else None


def _udf_count(key: bytes, values) -> bytes:
    return str(sum(map(int, values))).encode()


def _plain(done: DataFrame) -> DataFrame:
    return done.select(F.col("key").cast("string").alias("key"), F.col("result").cast("string").cast("long").alias("n"))


def udf_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(ops.run_user_job(texts(spark, sf_dir), _udf_words, _udf_count, combine=_udf_count))


def udf_unique_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(ops.run_user_job(log_lines(spark, sf_dir), _udf_address, _udf_count))


QUERIES: dict[str, Query] = {
    "wordcount": wordcount,
    "unique_ips": _log_job("unique_ips"),
    "unique_urls": _log_job("unique_urls"),
    "unique_domains": _log_job("unique_domains"),
    "total_unique_words": total("wordcount"),
    "total_unique_ips": total("unique_ips"),
    "total_unique_urls": total("unique_urls"),
    "total_unique_domains": total("unique_domains"),
    "top5_ips": top("unique_ips", 5),
    "top10_domains": top("unique_domains", 10),
    "result_lines": lambda spark, d: result_lines(_log_job("unique_ips")(spark, d)),
    "job_results_parse": job_results_parse,
    "results_roundtrip_sum": results_roundtrip_sum,
    "reducer_layout": reducer_layout,
    "bytes_per_reducer": bytes_per_reducer,
    "group_values": lambda spark, d: ops.group_values(log_pairs(spark, d)),
    "multi_input_wordcount": lambda spark, d: ops.run_job_columns("wordcount", texts(spark, d, "documents", "conversations", "benchmark")),
    "udf_wordcount": udf_wordcount,
    "udf_unique_ips": udf_unique_ips,
    "field_arity_filter": field_arity_filter,
    "sorted_pairs": sorted_pairs,
    "file_checksums": file_checksums,
    "wal_fold": wal_fold,
}

# --- the same in DuckDB's SQL ---
_LOG = """
    log AS (SELECT concat_ws(chr(9), event_id::varchar, event_type,
                   concat_ws('.', '10', ((user_id // 256) % 256)::varchar, (user_id % 256)::varchar, '1'), url) AS value
            FROM (SELECT e.*, event_id % np AS pid FROM events e CROSS JOIN (SELECT count(*) AS np FROM pages) c) e
            JOIN pages ON page_id = pid)"""
_BLANK_FREE = r"[^\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(?:\[([^\]/?#]*)\]|([^:/?#\[\]@]*))(?::[0-9]*)?(?:[/?#]|$)"
_HOSTS = rf"""
    urls AS (SELECT p[4] AS u FROM (SELECT regexp_extract_all(value, '{_BLANK_FREE}') AS p FROM log) WHERE len(p) >= 4),
    hosts AS (SELECT CASE WHEN regexp_replace(regexp_extract(u, '^[^?#]*', 0) || regexp_extract(u, '#.*', 0), '%[0-9A-Fa-f]{{2}}', '', 'g')
                               LIKE '%\%%' ESCAPE '\' OR regexp_matches(u, '[\x00-\x1f\x7f]') OR regexp_matches(host, '[ |\\^`{{}}]')
                          THEN '' ELSE host END AS key
              FROM (SELECT u, regexp_extract(u, '{_AUTHORITY}', 1) || regexp_extract(u, '{_AUTHORITY}', 2) AS host FROM urls)),
    keys AS (SELECT key FROM hosts WHERE key <> '')"""


def _field_keys(n: int) -> str:
    return f"keys AS (SELECT p[{n}] AS key FROM (SELECT string_split(value, chr(9)) AS p FROM log) WHERE len(p) >= {n})"


def _word_keys(*tables: str) -> str:
    rows = " UNION ALL ".join(f"SELECT text FROM {t}" for t in tables)
    return rf"keys AS (SELECT unnest(regexp_extract_all(lower(replace(text, 'İ', 'i')), '\w+')) AS key FROM ({rows}))"


_COUNT = "SELECT key, count(*) AS n FROM keys GROUP BY key"
_WORDS = f"WITH {_word_keys('documents')}"
_IPS, _URLS = (f"WITH {_LOG}, {_field_keys(n)}" for n in (3, 4))
_DOMAINS = f"WITH {_LOG}, {_HOSTS}"
_HASH = (
    "(list_reduce(list_prepend(0::bigint, list_transform(string_split(key, ''), lambda c: ascii(c)::bigint)), "
    "lambda a, x: (a * 31 + x) & 4294967295) & 2147483647)"
)

ORACLE_SQL: dict[str, str] = {
    "wordcount": f"{_WORDS} {_COUNT}",
    "unique_ips": f"{_IPS} {_COUNT}",
    "unique_urls": f"{_URLS} {_COUNT}",
    "unique_domains": f"{_DOMAINS} {_COUNT}",
    "total_unique_words": f"{_WORDS} SELECT count(DISTINCT key) AS total FROM keys",
    "total_unique_ips": f"{_IPS} SELECT count(DISTINCT key) AS total FROM keys",
    "total_unique_urls": f"{_URLS} SELECT count(DISTINCT key) AS total FROM keys",
    "total_unique_domains": f"{_DOMAINS} SELECT count(DISTINCT key) AS total FROM keys",
    "top5_ips": f"{_IPS} {_COUNT} ORDER BY n DESC, key LIMIT 5",
    "top10_domains": f"{_DOMAINS} {_COUNT} ORDER BY n DESC, key LIMIT 10",
    "result_lines": f"{_IPS} SELECT concat(key, ': ', n::varchar) AS value FROM ({_COUNT})",
    "job_results_parse": f"{_WORDS} {_COUNT}",
    "results_roundtrip_sum": f"{_IPS} {_COUNT}",
    "reducer_layout": f"{_IPS} SELECT ({_HASH} % {REDUCERS})::int AS r, count(*) AS n FROM keys GROUP BY 1",
    "bytes_per_reducer": f"{_IPS} SELECT ({_HASH} % {REDUCERS})::int AS r, sum(octet_length(key::blob) + 3)::bigint AS bytes FROM keys GROUP BY 1",
    "group_values": f"WITH {_LOG} SELECT p[3] AS key, string_agg(p[2], ',' ORDER BY p[2]) AS vals "
    "FROM (SELECT string_split(value, chr(9)) AS p FROM log) GROUP BY 1",
    "multi_input_wordcount": f"WITH {_word_keys('documents', 'conversations', 'benchmark')} {_COUNT}",
    "udf_wordcount": f"{_WORDS} {_COUNT}",
    "udf_unique_ips": f"{_IPS} {_COUNT}",
    "field_arity_filter": f"WITH {_LOG}, {_field_keys(3).replace('FROM log', 'FROM cut')} {_COUNT}".replace(
        "keys AS", "cut AS (SELECT CASE WHEN regexp_matches(value, '/[0-9]*[02468]$') THEN array_to_string(string_split(value, chr(9))[:2], chr(9)) "
        "ELSE value END AS value FROM log), keys AS"
    ),
    "sorted_pairs": f"{_URLS} {_COUNT} ORDER BY key",
    "file_checksums": "SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents",
    "wal_fold": "SELECT 'f' || o_custkey AS name, arg_max(floor(o_totalprice), o_orderkey)::bigint AS size FROM orders "
    "GROUP BY 1 HAVING max(o_orderkey) % 3 <> 0",
}
