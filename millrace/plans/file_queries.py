"""Queries that go through files: text, pairs and logs written from the harness tables and read by this library's sources."""

from __future__ import annotations

import contextlib
import hashlib
import io
import tempfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from .. import operators as ops
from ..functions import base_name, text_name
from ..sources import Catalog, delete_results, download_results, lines, pairs, read_results, replay_log, write_results
from ..sources.files import MissingInput
from .job import Job, auto_reducers, run_job
from .queries import _COUNT, _IPS, Query, _word_keys, log_lines, scratch, table


def _written(spark: SparkSession, rows: DataFrame) -> str:
    """Folder of text files of rows (value)."""
    path = scratch(spark)
    rows.write.option("lineSep", "\n").text(path)
    return path


def _texts(spark: SparkSession, sf_dir: str, name: str) -> str:
    return _written(spark, table(spark, sf_dir, name).select(F.coalesce("text", F.lit("")).alias("value")))


def multi_file_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the lines of two inputs, one of them named twice."""
    first, second = (_texts(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return ops.run_job_columns("wordcount", lines(spark, [first, second, first]))


def pair_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of written lines: a key ends at the first tab, lines without one are left out."""
    value = F.when(F.col("event_id") % 7 == 0, F.lit("no tab")).otherwise(
        F.concat_ws("\t", "event_type", F.col("user_id").cast("string"), F.lit("more"))
    )
    path = _written(spark, table(spark, sf_dir, "events").select(value.alias("value")))
    found = pairs(lines(spark, path))
    return found.groupBy("key", "value").agg(F.count("*").alias("n"))


def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a written metadata log leaves, with one broken line in ten: orders are entries, customers files."""
    chunk = F.struct(F.col("o_orderkey").alias("chunk_id"), F.lit(3).cast("long").alias("size"))
    name = F.concat(F.lit("f"), "o_custkey")
    chunks = F.array_repeat(chunk, (F.col("o_orderkey") % 4).cast("int"))
    meta = F.struct(name.alias("file_name"), F.floor("o_totalprice").cast("long").alias("size"), chunks.alias("chunks"))
    op = F.when(F.col("o_orderkey") % 3 == 0, "DELETE").otherwise("PUT")
    line = F.to_json(F.struct(op.alias("op"), name.alias("file_name"), meta.alias("file_meta")))
    orders = table(spark, sf_dir, "orders").orderBy("o_orderkey")
    broken = F.when(F.col("o_orderkey") % 10 == 0, F.lit("broken{")).otherwise(line)
    return replay_log(spark, _written(spark, orders.select(broken.alias("value"))))


def _catalog(spark: SparkSession, sf_dir: str, chunk: int) -> tuple[Catalog, str, str]:
    """A catalog with the benchmark's texts as one file, which a driver holds, as the reference's client does; its name; its local path."""
    local = tempfile.mkdtemp(prefix="millrace-")
    rows = table(spark, sf_dir, "benchmark").orderBy("item_id").select(F.coalesce("text", F.lit("")).alias("value"))
    with open(f"{local}/bench.txt", "w", newline="") as f:
        f.writelines(r.value + "\n" for r in rows.toLocalIterator())
    catalog = Catalog(spark, scratch(spark))
    catalog.chunk = chunk
    return catalog, catalog.put(f"{local}/bench.txt"), local


def catalog_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a file that was put in chunks of whole lines."""
    catalog, name, _ = _catalog(spark, sf_dir, 1000)
    return ops.run_job_columns("wordcount", lines(spark, catalog.folder(name)))


def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog after two puts, a put of a name that is there, which is refused, and a delete."""
    catalog, name, local = _catalog(spark, sf_dir, 1 << 20)
    Path(f"{local}/other.bin").write_bytes(b"\0" * 100)
    catalog.put(f"{local}/other.bin")
    with contextlib.suppress(FileExistsError):
        catalog.put(f"{local}/{name}")
        raise AssertionError("an existing name was put again")
    catalog.delete("other.bin")
    return catalog.list()


def catalog_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks' checksums where they lie, their sizes, and the digest of the file got back."""
    catalog, name, local = _catalog(spark, sf_dir, 1000)
    got = Path(catalog.get(name, f"{local}/back")).read_bytes()
    ok = catalog.verify(name).agg(F.bool_and("ok").alias("ok"))
    return catalog.chunks(name).agg(F.sum("size").alias("size")).crossJoin(ok).withColumn("md5", F.lit(hashlib.md5(got).hexdigest()))


def _two_jobs(spark: SparkSession, sf_dir: str) -> str:
    """Root of the results of jobs one and two; the log of the first is read from files."""
    root = scratch(spark)
    path = _written(spark, log_lines(spark, sf_dir))
    run_job(spark, Job([path], job="unique_ips", reducers=64, id="one"), root)
    run_job(spark, Job([path], job="unique_urls", id="two"), root)
    return root


def _local_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(x,) for f in sorted(Path(folder).iterdir()) for x in f.read_text().splitlines()]
    return spark.createDataFrame(rows, "value string")


def downloaded_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the local files of one of two jobs' results. Reducers without keys leave no file."""
    local = tempfile.mkdtemp(prefix="millrace-")
    names = download_results(spark, _two_jobs(spark, sf_dir), "one", local)
    assert all(n.startswith("res-one-") for n in names)
    return _local_lines(spark, local)


def deleted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether results were there to delete: of a job, of the same again, and of one that never ran."""
    root = _two_jobs(spark, sf_dir)
    found = [(i, delete_results(spark, root, job)) for i, job in enumerate(("two", "two", "none"))]
    left = read_results(spark, f"{root}/res-one").count()
    return spark.createDataFrame([(i, ok, left) for i, ok in found], "call int, deleted boolean, left_over long")


def refused_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a result that a second write of the same name didn't touch."""
    root, words = scratch(spark), ops.run_job_columns("wordcount", lines(spark, _texts(spark, sf_dir, "benchmark")))
    path = write_results(words, root, "same", 3)
    with contextlib.suppress(AnalysisException):
        write_results(words.limit(1), root, "same", 3)
        raise AssertionError("an existing result was written again")
    return read_results(spark, path)


def missing_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by whether their inputs were all there; nothing is written for the others."""
    root, there = scratch(spark), _texts(spark, sf_dir, "benchmark")
    rows = []
    for i, inputs in enumerate(([there], [there, f"{there}-none"])):
        try:
            run_job(spark, Job(inputs, job="wordcount", id=str(i)), root)
            rows.append((i, True))
        except MissingInput:
            rows.append((i, delete_results(spark, root, str(i))))
    return spark.createDataFrame(rows, "job int, ran boolean")


def failing_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by whether a reduce that can't take some of their priorities fails the job."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("value"))

    def reduce(key: bytes, values) -> bytes:
        return str(int(key[:1]) + sum(1 for _ in values)).encode()  # a key that begins with no digit is an error

    out = []
    for i, some in enumerate((rows, rows.unionAll(rows.limit(1).select(F.lit("broken").alias("value"))))):
        try:
            out.append((i, ops.run_user_job(some, lambda line: [(line, b"1")], reduce).count()))
        except Exception as e:
            if "invalid literal" not in str(e):
                raise
            out.append((i, -1))
    return spark.createDataFrame(out, "run int, results long")


def job_reducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reducers of jobs of as many chunks as customers of a nation have orders."""
    found = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("chunks"))
    sizes = [(r.c_nationkey, r.chunks, auto_reducers(r.chunks)) for r in found.collect()]  # a row a nation
    return spark.createDataFrame(sizes, "nation long, chunks long, reducers long")


def node_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over suppliers as storage nodes."""
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("used_space"), F.length("s_name").cast("long").alias("free_space"))
    return ops.node_totals(nodes)


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last parts of URLs, as file names with and without an ending, and whether they say that they are text."""
    path = F.concat("url", F.when(F.col("page_id") % 3 == 0, ".TXT").when(F.col("page_id") % 3 == 1, ".txt.bin").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", base_name(path).alias("name"), text_name(path).alias("is_text"))


def value_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of hot keys in several rows a key, put together again by their number."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("value"))
    parts = ops.group_values(rows, parts=8)
    return parts.groupBy("key").agg(F.sum(F.size(F.split("vals", ","))).alias("n"), F.max(F.length("vals") > 0).alias("filled"))


def _said(*args: str) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        cli.main(["--root", *args])
    return out.getvalue()


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line prints: a job's folder is made, its report, its total, its deletion."""
    root, path = scratch(spark), _written(spark, log_lines(spark, sf_dir))
    folder = _said(root, "run", "--job", "unique_ips", "--inputs", path, "--reducers", "4").split("\n")[-2]
    rows = [("top", x) for x in _said(root, "report", "topn", folder, "-n", "5").splitlines()]
    rows += [("total", x) for x in _said(root, "report", "total", folder).splitlines()]
    rows += [("deleted", x) for x in _said(root, "results", "delete", folder.rsplit("res-", 1)[1]).splitlines()]
    return spark.createDataFrame(rows, "what string, line string")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        multi_file_wordcount, pair_scan, log_replay, catalog_wordcount, catalog_listing, catalog_checks, downloaded_results, deleted_results,
        refused_results, missing_input, failing_functions, job_reducers, node_totals, file_names, value_parts, command_line,
    )
}

_BENCH = "(SELECT string_agg(coalesce(text, '') || chr(10), '' ORDER BY item_id) AS body FROM benchmark)"
ORACLE_SQL: dict[str, str] = {
    "multi_file_wordcount": f"WITH {_word_keys('documents', 'benchmark')} {_COUNT}",
    "pair_scan": "SELECT event_type AS key, user_id || chr(9) || 'more' AS value, count(*) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY ALL",
    "log_replay": "SELECT 'f' || o_custkey AS name, arg_max(floor(o_totalprice), o_orderkey)::bigint AS size, max(o_orderkey) % 4 AS n_chunks "
    "FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY o_custkey HAVING max(o_orderkey) % 3 <> 0",
    "catalog_wordcount": f"WITH {_word_keys('benchmark')} {_COUNT}",
    "catalog_listing": f"SELECT 'bench.txt' AS name, octet_length(encode(body))::bigint AS size FROM {_BENCH}",
    "catalog_checks": f"SELECT octet_length(encode(body))::bigint AS size, true AS ok, md5(body) AS md5 FROM {_BENCH}",
    "downloaded_results": f"{_IPS} SELECT concat(key, ': ', n::varchar) AS value FROM ({_COUNT})",
    "deleted_results": f"{_IPS} SELECT call, call = 0 AS deleted, (SELECT count(DISTINCT key) FROM keys) AS left_over "
    "FROM (SELECT unnest([0, 1, 2])::int AS call)",
    "refused_results": f"WITH {_word_keys('benchmark')} {_COUNT}",
    "missing_input": "SELECT unnest([0, 1])::int AS job, unnest([true, false]) AS ran",
    "failing_functions": "SELECT 0::int AS run, count(DISTINCT o_orderpriority) AS results FROM orders UNION ALL SELECT 1, -1",
    "job_reducers": "SELECT c_nationkey::bigint AS nation, count(*) AS chunks, greatest(1, least(100, (count(*) + 4) // 5)) AS reducers "
    "FROM customer GROUP BY 1",
    "node_totals": "SELECT sum(s_suppkey)::bigint AS used_space, sum(length(s_name))::bigint AS free_space FROM supplier",
    "file_names": "SELECT page_id, regexp_extract(p, '[^/]*$') AS name, lower(p) LIKE '%.txt' AS is_text FROM (SELECT page_id, "
    "url || CASE page_id % 3 WHEN 0 THEN '.TXT' WHEN 1 THEN '.txt.bin' ELSE '' END AS p FROM pages)",
    "value_parts": "SELECT event_type AS key, count(*) AS n, true AS filled FROM events GROUP BY 1",
    "command_line": f"{_IPS}, counts AS ({_COUNT}) SELECT 'top' AS what, concat(key, ': ', n::varchar) AS line FROM (SELECT * FROM counts "
    "ORDER BY n DESC, key LIMIT 5) UNION ALL SELECT 'total', 'Total unique elements: ' || count(*) FROM counts "
    "UNION ALL SELECT 'deleted', 'deleted'",
}
