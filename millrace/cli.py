"""Command line: jobs, their results, reports, and the dataset catalog."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from .operators import JOBS, node_totals, sum_by_key, top_n
from .plans import Job, run_job
from .sources import Catalog, delete_results, download_results, lines, read_results


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("--root", required=True, help="folder of datasets and results")
    commands = p.add_subparsers(dest="command", required=True)

    run = commands.add_parser("run", help="run a job")
    run.add_argument("--job", help=f"{', '.join(JOBS)}, or module:map,reduce")
    run.add_argument("--inputs", required=True, help="paths or catalog names, with commas between")
    run.add_argument("--reducers", type=int, default=0)

    results = commands.add_parser("results", help="fetch or delete a job's results").add_subparsers(dest="action", required=True)
    get = results.add_parser("get")
    get.add_argument("id")
    get.add_argument("to")
    results.add_parser("delete").add_argument("id")

    report = commands.add_parser("report", help="report over result files").add_subparsers(dest="action", required=True)
    topn = report.add_parser("topn")
    topn.add_argument("folder")
    topn.add_argument("-n", type=int, default=10)
    report.add_parser("total").add_argument("folder")

    data = commands.add_parser("data", help="the dataset catalog").add_subparsers(dest="action", required=True)
    put = data.add_parser("put")
    put.add_argument("file")
    put.add_argument("--chunk-size", type=int, default=0, help="MiB, 64 to 256")
    fetch = data.add_parser("get")
    fetch.add_argument("name")
    fetch.add_argument("to")
    for name in ("delete", "verify"):
        data.add_parser(name).add_argument("name")
    data.add_parser("list")
    commands.add_parser("nodes", help="executors: storage used and free, running tasks, and the totals")
    return p


def executors(spark: SparkSession) -> list[tuple[str, int, int, int]]:
    """(host:port, bytes of storage used, free, running tasks) of each executor."""
    infos = spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()
    found = [(f"{i.host()}:{i.port()}", i.usedOnHeapStorageMemory(), i.totalOnHeapStorageMemory(), i.numRunningTasks()) for i in infos]
    return [(name, used, all_ - used, tasks) for name, used, all_, tasks in found]


def make_job(spec: str, inputs: list[str], reducers: int) -> Job:
    if ":" not in spec:
        return Job(inputs, job=spec, reducers=reducers)
    module, names = spec.split(":", 1)
    map_name, reduce_name = names.split(",")
    found = importlib.import_module(module)
    return Job(inputs, map_fn=getattr(found, map_name), reduce_fn=getattr(found, reduce_name), reducers=reducers)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("millrace").getOrCreate()
    catalog = Catalog(spark, a.root, getattr(a, "chunk_size", 0) << 20)
    what = (a.command, getattr(a, "action", None))
    if a.command == "run":
        known = {r.name for r in catalog.list().collect()}  # the names of datasets, not their rows
        inputs = [catalog.folder(i) if i in known else i for i in a.inputs.split(",")]
        print(run_job(spark, make_job(a.job, inputs, a.reducers), a.root))
    elif a.command == "nodes":
        nodes = executors(spark)
        for name, used, free, tasks in nodes:
            print(f"{name} {used} {free} {tasks}")
        total = node_totals(spark.createDataFrame(nodes, "id string, used_space long, free_space long, tasks int")).first()
        print(f"total {total.used_space} {total.free_space}")
    elif what == ("results", "get"):
        print("\n".join(download_results(spark, a.root, a.id, a.to)))
    elif what == ("results", "delete"):
        print("deleted" if delete_results(spark, a.root, a.id) else "no such job")
    elif what == ("report", "topn"):
        for r in top_n(sum_by_key(read_results(spark, a.folder)), a.n).collect():
            print(f"{r.key}: {r.n}")
    elif what == ("report", "total"):
        print(f"Total unique elements: {lines(spark, a.folder).count()}")
    elif what == ("data", "put"):
        print(catalog.put(a.file))
    elif what == ("data", "get"):
        print(catalog.get(a.name, a.to))
    elif what == ("data", "delete"):
        catalog.delete(a.name)
    elif what == ("data", "verify"):
        for r in catalog.verify(a.name).orderBy("id").collect():
            print(f"{r.id} {'ok' if r.ok else 'damaged'}")
    else:
        for r in catalog.list().orderBy("name").collect():
            print(f"{r.size} {r.name}")


if __name__ == "__main__":
    main()
