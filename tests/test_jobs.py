"""Jobs, reports, user functions, sinks, the catalog and the command line."""

import collections

import pytest
from millrace import cli
from millrace.operators import (
    bytes_per_reducer, emitted, group_values, map_lines, node_totals, reducer_layout, run_job_columns, run_user_job, sum_by_key, top_n, total_unique,
)
from millrace.plans import Job, auto_reducers, progress, run_job
from millrace.sources import Catalog, delete_results, download_results, fold_log, lines, pairs, parse_results, read_results, replay_log, result_lines, write_results
from millrace.sources.catalog import chunk_size, cut_points
from millrace.sources.files import MissingInput
from pyspark.errors import AnalysisException

TEXT = b"The the THE\n\ncan't x_y 42 \xc3\xa9l\xc3\xa8ve \xc4\xb0stanbul\r\nlast"
WORDS = {"the": 3, "can": 1, "t": 1, "x_y": 1, "42": 1, "l": 1, "ve": 1, "istanbul": 1, "last": 1}
LOG = (
    "t0\tu0\t10.0.0.1\thttp://A.example.com/x\nt1\tu1\t10.0.0.1\thttp://a.example.com:8080/y\r\n"
    "t2\tu2\t10.0.0.2\thttp://b_c.example.com/z?q=1\textra\nt3\tu3\t10.0.0.2\nt4\tu4\t\thttp://a.example.com/\n"
    "t5 u5 10.0.0.9 http://d.example.com/\n\n2024-01-01 00:00:00\tu7\t10.0.0.3\thttp://e.example.com/\nt8\tu8\t10.0.0.3\t/relative\n"
    "t9\tu9\t10.0.0.4\thttp://[::1]:80/\n"
)
IPS = {"": 1, "10.0.0.1": 2, "10.0.0.2": 2, "10.0.0.3": 2, "10.0.0.4": 1}


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    (d / "text.txt").write_bytes(TEXT)
    (d / "log.txt").write_text(LOG, newline="")
    return d


def counts(df):
    return {tuple(r)[0]: tuple(r)[1] for r in df.collect()}


def test_lines(spark, inputs):
    assert [r.value for r in lines(spark, [f"{inputs}/text.txt"] * 2).collect()] == ["The the THE", "", "can't x_y 42 élève İstanbul", "last"]
    with pytest.raises(MissingInput):
        lines(spark, f"{inputs}/none.txt")


def test_builtin_jobs(spark, inputs):
    text, log = lines(spark, f"{inputs}/text.txt"), lines(spark, f"{inputs}/log.txt")
    assert counts(run_job_columns("wordcount", text)) == WORDS
    ips = run_job_columns("unique_ips", log)
    assert counts(ips) == IPS
    urls = counts(run_job_columns("unique_urls", log))
    assert len(urls) == 7 and set(urls.values()) == {1} and "http://a.example.com:8080/y" in urls
    hosts = ["A.example.com", "a.example.com", "b_c.example.com", "d.example.com", "::1"]
    assert counts(run_job_columns("unique_domains", log)) == dict.fromkeys(hosts, 1)
    assert total_unique(emitted("unique_ips", log)).first().total == 5
    assert [tuple(r) for r in top_n(ips, 4).collect()] == [("10.0.0.1", 2), ("10.0.0.2", 2), ("10.0.0.3", 2), ("", 1)]
    assert counts(run_job_columns("wordcount", text.limit(0))) == {}
    with pytest.raises(ValueError):
        emitted("sort", text)


def test_plans_scale(spark, inputs):
    log = lines(spark, f"{inputs}/log.txt")
    plan = top_n(run_job_columns("unique_ips", log), 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "partial_count" in plan and "Python" not in plan


def test_pairs_and_groups(spark):
    df = spark.createDataFrame([("b\t2",), ("a\tx\ty",), ("none",), ("b\t1",), ("\t",)], "value string")
    assert sorted(map(tuple, pairs(df).collect())) == [("", ""), ("a", "x\ty"), ("b", "1"), ("b", "2")]
    assert counts(group_values(pairs(df))) == {"": "", "a": "x\ty", "b": "1,2"}
    assert sum(counts(reducer_layout(pairs(df), 5)).values()) == 4
    assert sum(counts(bytes_per_reducer(pairs(df), 5)).values()) == 2 + 6 + 4 + 4


def test_node_totals(spark):
    nodes = spark.createDataFrame([("a", 5, 7), ("b", 1, 2)], "id string, used_space long, free_space long")
    assert tuple(node_totals(nodes).first()) == (6, 9) and tuple(node_totals(nodes.limit(0)).first()) == (0, 0)


def test_results_parse(spark):
    df = spark.createDataFrame([(v,) for v in ["a.com: 3", "a.com: 2", "b.com: x", "", "solo", "a: b: 4"]], "value string")
    assert counts(sum_by_key(parse_results(df))) == {"a.com": 5, "a: b": 4}


@pytest.mark.parametrize("reducers", [1, 3, 64])
def test_result_files(spark, inputs, tmp_path, reducers):
    words = run_job_columns("wordcount", lines(spark, f"{inputs}/text.txt"))
    path = write_results(words, str(tmp_path), "j", reducers)
    assert counts(read_results(spark, path)) == WORDS
    for part in (tmp_path / "res-j").glob("part-*"):
        keys = [line.rsplit(": ", 1)[0].encode() for line in part.read_text().splitlines()]
        assert keys == sorted(keys)
    with pytest.raises(AnalysisException):
        write_results(words, str(tmp_path), "j", reducers)
    names = download_results(spark, str(tmp_path), "j", str(tmp_path / "local"))
    assert names and sum(len((tmp_path / "local" / n).read_text().splitlines()) for n in names) == len(WORDS)
    assert delete_results(spark, str(tmp_path), "j") and not (tmp_path / "res-j").exists()
    assert sorted(r.value for r in result_lines(words).collect())[0] == "42: 1"


def test_user_jobs(spark):
    body = [b"a\xff b", b"b", b"", b"a\xff\ta\xff,x\nb"]
    df = spark.createDataFrame([(b,) for b in body], "value binary")
    for combine in (None, lambda k, vs: str(sum(map(int, vs))).encode()):
        done = run_user_job(df, lambda line: [(w, b"1") for w in line.split()], lambda k, vs: str(sum(map(int, vs))).encode(), 3, combine)
        want = collections.Counter(w for b in body for w in b.split())
        assert {bytes(r.key): int(r.result) for r in done.collect()} == want
    assert map_lines(df, lambda line: None).count() == 0
    many = spark.range(35_000).selectExpr("cast(id % 2 as string) value").repartition(2)
    done = run_user_job(many, lambda line: [(line, b"v")], lambda k, vs: b"%d" % sum(1 for _ in vs))
    assert sorted((bytes(r.key), int(r.result)) for r in done.collect()) == [(b"0", 17_500), (b"1", 17_500)]
    first = run_user_job(many, lambda line: [(line, b"v")], lambda k, vs: next(vs))
    assert first.count() == 2


def test_failures_fail_the_job(spark):
    df = spark.createDataFrame([(b"x",)], "value binary")

    def broken(key, values):
        raise OSError("boom")

    with pytest.raises(Exception, match="boom"):
        run_user_job(df, lambda line: [(line, b"1")], broken).collect()
    with pytest.raises(TypeError):
        run_user_job(df, lambda: None, lambda k, vs: b"")
    with pytest.raises(TypeError):
        run_user_job(df, lambda line: None, "reduce")


def test_jobs(spark, inputs, tmp_path):
    assert [auto_reducers(n) for n in (0, 1, 5, 6, 500, 10_000)] == [1, 1, 1, 2, 100, 100]
    job = Job([f"{inputs}/log.txt"], job="unique_ips")
    path = run_job(spark, job, str(tmp_path))
    done, all_ = progress(spark, job.id)
    assert 0 < done <= all_ and progress(spark, "none") == (0, 0)
    assert counts(read_results(spark, path)) == IPS
    user = Job([f"{inputs}/text.txt"], map_fn=lambda b: [(w, b"1") for w in b.split()], reduce_fn=lambda k, vs: b"%d" % len(list(vs)), reducers=2)
    assert counts(read_results(spark, run_job(spark, user, str(tmp_path))))["last"] == 1
    for wrong in ({}, {"job": "wordcount", "map_fn": len, "reduce_fn": len}, {"job": "wordcount", "reducers": -1}):
        with pytest.raises(ValueError):
            Job([], **wrong)


def test_log_fold(spark):
    rows = [(1, "PUT", "a", 10), (2, "PUT", "b", 20), (3, "DELETE", "a", 0), (4, "PUT", "b", 25), (5, "PUT", "c", 30)]
    assert counts(fold_log(spark.createDataFrame(rows, "seq long, op string, name string, size long"))) == {"b": 25, "c": 30}


def test_log_replay(spark, tmp_path):
    chunk = '{"chunk_id":1,"nodes":["n"],"size":3,"checksum":"YQ=="}'
    put = '{{"op":"PUT","file_name":"{}","file_meta":{{"file_name":"{}","size":{},"chunks":[{}],"created_at":"2024-01-01T00:00:00Z"}}}}'
    log = [put.format("a", "a", 10, chunk), "broken{", put.format("b", "b", 20, ""), '{"op":"DELETE","file_name":"a"}']
    log += [put.format("x", "x", 1, ""), '{"op":"DELETE","file_name":"x"}'] * 3000 + [put.format("b", "b", 25, f"{chunk},{chunk}"), put.format("c", "c", 30, "")]
    (tmp_path / "log").write_text("\n".join(log))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    got = sorted(map(tuple, replay_log(spark, str(tmp_path / "log")).collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [("b", 25, 2), ("c", 30, 0)]


def test_catalog(spark, inputs, tmp_path):
    assert (chunk_size(0), chunk_size(1), chunk_size(1 << 40)) == (128 << 20, 64 << 20, 256 << 20)
    catalog = Catalog(spark, str(tmp_path / "cat"))
    assert catalog.list().count() == 0
    catalog.chunk = 20
    (tmp_path / "b.bin").write_bytes(b"\0\n" * 50)
    (tmp_path / "empty.txt").write_bytes(b"")
    for f in (inputs / "text.txt", tmp_path / "b.bin", tmp_path / "empty.txt"):
        catalog.put(str(f))
    assert counts(catalog.list()) == {"text.txt": len(TEXT), "b.bin": 100, "empty.txt": 0}
    assert [r.size for r in catalog.chunks("b.bin").orderBy("id").collect()] == [20] * 5
    assert counts(run_job_columns("wordcount", lines(spark, catalog.folder("text.txt")))) == WORDS
    for name, body in (("text.txt", TEXT), ("b.bin", b"\0\n" * 50), ("empty.txt", b"")):
        with open(catalog.get(name, str(tmp_path / "out")), "rb") as f:
            assert f.read() == body
    with pytest.raises(FileExistsError):
        catalog.put(str(tmp_path / "b.bin"))
    chunk = tmp_path / "cat" / "b.bin" / "chunk-000002"
    chunk.write_bytes(b"damage")
    for crc in chunk.parent.glob(".*.crc"):
        crc.unlink()
    assert counts(catalog.verify("b.bin")) == {0: True, 1: True, 2: False, 3: True, 4: True}
    with pytest.raises(OSError, match="damaged"):
        catalog.get("b.bin", str(tmp_path / "out"))
    catalog.delete("b.bin")
    assert set(counts(catalog.list())) == {"text.txt", "empty.txt"}
    with pytest.raises(FileNotFoundError):
        catalog.delete("b.bin")


def test_cut_points_end_at_lines(inputs):
    cuts = cut_points(f"{inputs}/text.txt", 5)
    assert cuts[-1] == len(TEXT) and all(TEXT[c - 1 : c] == b"\n" for c in cuts[:-1])


def test_command_line(spark, inputs, tmp_path, capsys):
    root = str(tmp_path / "root")

    def call(*args):
        cli.main(["--root", root, *args], spark)
        return capsys.readouterr().out.strip()

    assert call("data", "put", f"{inputs}/log.txt") == "log.txt"
    assert call("data", "list") == f"{len(LOG)} log.txt" and call("data", "verify", "log.txt") == "0 ok"
    folder = call("run", "--job", "unique_ips", "--inputs", "log.txt", "--reducers", "2")
    assert call("report", "total", folder) == "Total unique elements: 5"
    assert call("report", "topn", folder, "-n", "1") == "10.0.0.1: 2"
    job = folder.rsplit("res-", 1)[1]
    assert call("results", "get", job, str(tmp_path / "local")).startswith(f"res-{job}-part-")
    assert call("results", "delete", job) == "deleted" and call("results", "delete", job) == "no such job"
    call("data", "get", "log.txt", str(tmp_path / "local"))
    assert (tmp_path / "local" / "log.txt").read_bytes() == LOG.encode()
    call("data", "delete", "log.txt")
    assert call("data", "list") == ""
    assert call("nodes").splitlines()[-1].startswith("total ")


def test_total_counts_results_of_any_form(spark, tmp_path, capsys):
    for name, text in (("part-0", "a: x,y\nb: 2\n"), ("part-1", "c: 1.5\nno sign\n"), ("part-2", "")):
        (tmp_path / name).write_text(text)
    cli.main(["--root", str(tmp_path), "report", "total", str(tmp_path)], spark)
    assert capsys.readouterr().out.strip() == "Total unique elements: 4"
