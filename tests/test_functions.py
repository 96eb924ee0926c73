"""Columns on the edge corpus, with expectations worked out by hand."""

import pytest
from millrace.functions import base_name, host_name, key_hash, pair_fields, reducer_of, text_name, white_fields, words
from pyspark.sql import functions as F

HOSTS = {
    "http://a_b.com/x": "a_b.com", "http://u:p@H.Com:8080/x": "H.Com", "http://[::1]:80/": "::1", "//h/x": "h", "http://a.com:/": "a.com",
    "http://a.com?x=@b": "a.com", "http://a.com/é": "a.com", "http://a.com/%41": "a.com", "http://a.com/?q=%zz": "a.com",
    "http://a.com/?q=%zz#ok": "a.com", "example.com/x": "", "localhost:80/x": "", "file:///x": "", "mailto:x@y": "", "-": "", "": "",
    "http://a.com:abc/": "", "http://a.com/%zz": "", "http://a.com/#%zz": "", "http://a.com/x#?%zz": "", "http://x|y.com/": "",
    "http://a.com/\x01": "", "http://a:b:80/": "",
}


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_hosts(spark):
    assert dict(zip(HOSTS, column(spark, HOSTS, host_name))) == HOSTS


def test_words(spark):
    got = column(spark, ["The the THE", "", "can't x_y 42 élève İstanbul", None], words)
    assert got == [["the"] * 3, [], ["can", "t", "x_y", "42", "l", "ve", "istanbul"], None]


def test_white_fields(spark):
    assert column(spark, [" a\tb  c\x85d e\x0bf ", "", "　"], white_fields) == [["a", "b", "c", "d", "e", "f"], [], []]


def test_pair_fields_and_names(spark):
    assert column(spark, ["k\tv\tw", "k", "\tv"], pair_fields) == [["k", "v\tw"], ["k"], ["", "v"]]
    assert column(spark, ["/a/b.TXT", "b.txt.gz", "c"], base_name) == ["b.TXT", "b.txt.gz", "c"]
    assert column(spark, ["/a/b.TXT", "b.txt.gz", "c.txt"], text_name) == [True, False, True]


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_key_hash(spark, kind):
    keys = ["", "a", "10.0.0.1", "élève", "x" * 500]
    raw = [k.encode() if kind == "binary" else k for k in keys]

    def plain(key):
        h = 0
        for b in key.encode():
            h = (h * 31 + b) & 0xFFFFFFFF
        return h & 0x7FFFFFFF

    assert column(spark, raw, key_hash, kind) == list(map(plain, keys))
    assert column(spark, raw, lambda k: reducer_of(k, 7), kind) == [plain(k) % 7 for k in keys]
