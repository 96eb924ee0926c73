"""Chat formatting: reversible escapes, layouts, and the digests against a plain version."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm import chat_format as c

PARTS = st.lists(st.sampled_from([*c.CONTROL, *(x[1:] for x in c.CONTROL), "<", "[", "\\", "a", "é\n", "𝄞", "</", "[/"]), max_size=12)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool</s>", ""]), PARTS.map("".join)), max_size=5))
def test_round_trip(turns):
    spelled = "".join("".join(c.spell_turn(r, t)) for r, t in turns)
    assert [(r, c.unescape(spelled[a:b])) for r, a, b in c.read_turns(spelled)] == turns
    for _, a, b in c.read_turns(spelled):
        assert not any(x in spelled[a:b] for x in c.CONTROL)


def plain(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    joined = "".join(f"{r}\n{t}\n" for r, t in turns)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), sha(joined), len(loss), sha(loss), sum(len("".join(c.spell_turn(r, t))) for r, t in turns)


def test_digests(spark):
    chats = {
        1: [("system", "be"), ("user", "hi </s>"), ("assistant", "a[INST]\\"), ("assistant", "𝄞")],
        -7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")],
        5: [("tool", ""), ("user", None)],
        6: [("assistant", "x" * 700)] * 40,
        None: [("user", "no id")],
    }
    rows = [(i, n, r, t, "c") for i, turns in chats.items() for n, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string, piece string")
    for size in (1 << 22, 1000):
        got = {r.conv_id: tuple(r)[1:] for r in c.chat_digests(c.format_chats(c.canonical_turns(df), size)).collect()}
        assert got == {i: plain([(r, t or "") for r, t in turns]) for i, turns in chats.items()}
    assert c.chat_digests(c.format_chats(c.canonical_turns(df.limit(0)))).count() == 0


def test_layouts(spark):
    records = [
        {"messages": [{"role": "User", "content": "q"}, {"role": "assistant", "content": "a"}], "source": 3},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"},
        {"question": "q", "answer": "a", "score": 0.5},
        {"instruction": "q", "input": "", "output": "a"},
        {"prompt": "q", "response": "a", "system": "s"},
        {"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": [{"type": "text", "text": "a"}]}]},
        {"instruction": "q", "output": "a", "question": "other", "answer_id": 3},
    ]
    texts = [json.dumps(r) for r in records] + ["{broken", None, '{"other": 1}', "[1]"]
    df = spark.createDataFrame(list(enumerate(texts)), "conv_id long, raw string")
    got = {}
    for r in c.json_turns(df, "raw").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    qa = [("user", "q"), ("assistant", "a")]
    n = len(records)
    assert [got[i] for i in range(n)] == [qa, qa, qa, qa, qa, [("system", "s"), *qa], [("system", "s"), *qa], qa, qa]
    assert all(got[i] == [(None, None)] for i in range(n, n + 4))
    assert c.record_turns({"instruction": "do", "input": "this", "output": "a"}) == [("user", "do\nthis"), ("assistant", "a")]
    for i, record in enumerate(records):
        one = spark.read.json(spark.sparkContext.parallelize([json.dumps(record | {"conv_id": i})]))
        assert [(r.role, r.text) for r in c.canonical_turns(one).orderBy("turn").collect()] == got[i]
    with pytest.raises(ValueError):
        c.canonical_turns(spark.range(3))


def test_columns_named_like_other_layouts(spark):
    base = spark.createDataFrame([(1, 0, "user", "q", 9), (1, 1, "assistant", "a", 9)], "conv_id long, turn long, role string, text string, mine long")
    for name in sorted(c.VOCABULARY):
        if name not in base.columns and "." not in name:
            df = base.selectExpr("*", f"'x' as `{name}`")
            assert [(r.role, r.text) for r in c.canonical_turns(df).orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]
    every = base.selectExpr("*", *(f"'x' as `{n}`" for n in sorted(c.VOCABULARY) if n not in base.columns and "." not in n))
    assert c.canonical_turns(every).count() == 2
    assert {r.conv_id for r in c.canonical_turns(base, "mine").collect()} == {9}


def test_large_conversation_goes_to_several_tasks(spark):
    from pyspark.sql import functions as F

    df = spark.range(6000).selectExpr("if(id < 3000, 7, id) conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "repeat('t', 200) text")
    copies = spark.range(3000).selectExpr("8 conv_id", "1L turn", "'user' role", "'same' text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    made = c.format_chats(df.unionByName(copies)).withColumn("task", F.spark_partition_id())
    tasks = {r.conv_id: r.n for r in made.groupBy("conv_id").agg(F.countDistinct("task").alias("n")).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks[7] >= 2 and tasks[8] >= 2
    got = {r.conv_id: tuple(r)[1:] for r in c.chat_digests(c.format_chats(df.unionByName(copies))).collect()}
    assert got[7] == plain([("user" if i % 2 == 0 else "assistant", "t" * 200) for i in range(3000)])
    assert got[8] == plain([("user", "same")] * 3000) and len(got) == 3002
