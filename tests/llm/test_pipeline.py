"""The pipeline against a plain version, stage by stage; helpers that drop rows by id."""

import random

import corpus_pipeline
import numpy as np
import test_near_dedup
import test_pii
import test_quality
from millrace.llm import quality as q
from millrace.llm.common import PII_KEY, maybe_members, member_filter, tokenizer_path, without_ids
from millrace.llm.pii import ANY
from tokenizers import Tokenizer


def fixture(spark, d):
    rng, rows = random.Random(4), []
    for i, text, kind in test_quality.sample(3, 300):
        text += rng.choice(["", "", " mail a.b@c.example.org", " call +1 (606) 555-7814 now", " card 4923437827071911."])
        rows.append((7 * i, text, kind))
        for k in range(rng.choice([0, 0, 1, 2])):
            words = text.split(" ")
            if k and len(words) > 20:
                words[rng.randrange(len(words))] = "changed"
            rows.append((7 * i + 1 + k, " ".join(words), None))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(g > 0), int(g == 1)) for i, _, g in rows if g is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return rows


def test_against_plain_version(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(test_pii, "KEY", PII_KEY)
    rows = fixture(spark, str(tmp_path))
    marked = sorted((g, np.array(sorted(q.features(t)), dtype="<i4").tobytes()) for _, t, g in rows if g is not None)
    w, theta = q.fit_ordinal([np.frombuffer(f, dtype="<i4") for _, f in marked], [g for g, _ in marked], 3)
    good = [(i, t) for i, t, _ in rows if w[sorted(q.features(t))].sum() >= theta[1] + np.log(q.LEAST / (1 - q.LEAST))]
    assert 0 < len(good) < len(rows)
    single = {}
    for i, t in good:
        single[t] = min(i, single.get(t, i))
    unique = sorted((i, t) for t, i in single.items())
    kept = {i for i, _, _, k in test_near_dedup.brute(unique, 5) if k}
    assert len(kept) < len(unique) < len(good)
    final = {i: test_pii.re.sub(ANY, lambda m: test_pii.plain(m.group()), t, flags=test_pii.re.ASCII) for i, t in unique if i in kept}

    docs, states = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        states.append({r.doc_id: r for r in docs.collect()})
    assert set(states[0]) == {i for i, _ in good} and set(states[1]) == {i for i, _ in unique} and set(states[2]) == kept
    assert {i: r.text for i, r in states[3].items()} == final and all(r.n_chars == len(final[i]) for i, r in states[3].items())
    plain = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = {}
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(r.ids)
        assert r.length == len(r.ids) <= 2048
    assert got == {i: plain.encode(t, add_special_tokens=False).ids + [1] for i, t in final.items()}
    nothing = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0


def test_rows_of_repeated_and_null_ids(spark, tmp_path, monkeypatch):
    """Whole rows against a plain version, where ids repeat, rows repeat, ids are null and columns have the helpers' names."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=rng.choice([8, 40, 90]))) for _ in range(40)]
    texts = base + [t + " tail" for t in base[:15]] + [None, "", "  "]
    rows = [(rng.choice([None, *range(25)]), rng.choice(texts)) for _ in range(400)]
    rows += [(4, "dup text"), (5, "dup text"), (5, "unique other text"), (None, "null twice"), (None, "null twice"), (7, "null twice")]
    schema = "doc_id long, text string, _at long, _bucket string, _maybe boolean, _tails int, _gone string, `_row` int, `_h` string, `a.b` int"
    full = [(i, t, k % 3, "b", True, 3, "g", 4, "h", 5) for k, (i, t) in enumerate(rows)]
    full += full[:30]
    df = spark.createDataFrame(full, schema).repartition(3)

    by_text = {}
    for r in full:
        by_text.setdefault(r[1] or "", []).append(r)
    got = [tuple(r) for r in corpus_pipeline.exact_dedup(spark, df, "").collect()]
    assert len(got) == len(by_text) and set(got) <= set(full)
    for r in got:
        ids = [x[0] for x in by_text[r[1] or ""] if x[0] is not None]
        assert r[0] == min(ids, default=None)

    single = spark.createDataFrame(got, schema)
    left = corpus_pipeline.near_dedup(spark, single, "")
    assert left.columns == df.columns
    left = [tuple(r) for r in left.collect()]
    assert set(left) <= set(got)
    _, _, roots, _ = zip(*sorted(test_near_dedup.brute(list(enumerate(r[1] or "" for r in got)), 5)))
    groups = {}
    for r, root in zip(got, roots):
        groups.setdefault(root, []).append(r)
    assert len(left) == len(groups) < len(got)
    for group in groups.values():
        (stays,) = [r for r in left if r in group]
        assert stays[0] == min((r[0] for r in group if r[0] is not None), default=None)

    monkeypatch.setattr(corpus_pipeline, "train", lambda *_: q.fit_ordinal([], [], 3))
    monkeypatch.setattr(corpus_pipeline, "TOP_GRADE", 1)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    same = corpus_pipeline.quality(spark, df, str(tmp_path))
    assert sorted(map(str, same.collect())) == sorted(map(str, df.collect()))


def test_filters_by_id(spark):
    df = spark.range(5000).selectExpr("id doc_id", "id + 1 as _at", "'x' _bucket", "id % 2 = 0 _maybe").unionAll(spark.sql("select null, 1L, 'y', true"))
    some = spark.range(0, 5000, 7).selectExpr("id doc_id")
    maybe = {r.doc_id for r in maybe_members(df, df.doc_id, member_filter(some, "doc_id")).collect()}
    assert maybe >= set(range(0, 5000, 7)) and len(maybe) < 1000
    left = without_ids(df, some, "doc_id")
    want = {(i, i + 1, "x", i % 2 == 0) for i in range(5000) if i % 7} | {(None, 1, "y", True)}
    assert left.columns == df.columns and set(map(tuple, left.collect())) == want
    assert without_ids(df, some.limit(0), "doc_id").count() == 5001


def test_key_of_the_session(spark):
    df = spark.createDataFrame([(1, "from 10.0.0.1", 13)], "doc_id long, text string, n_chars long")
    first = corpus_pipeline.pii(spark, df, "").first().text
    spark.conf.set("spark.millrace.piiKey", "another")
    other = corpus_pipeline.pii(spark, df, "").first().text
    spark.conf.unset("spark.millrace.piiKey")
    assert first != other and first == corpus_pipeline.pii(spark, df, "").first().text
