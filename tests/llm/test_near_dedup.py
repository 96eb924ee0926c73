"""Near duplicates against all pairs."""

import random

import pytest
from millrace.llm import near_dedup
from millrace.llm.near_dedup import near_duplicates, shingle_set


def brute(rows, width):
    sets = {i: shingle_set(t or "", width) for i, t in rows}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                comp[max(root(a), root(b))] = min(root(a), root(b))
    return {(i, len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    texts, passage = [], rng.choices(words, k=20)
    while len(texts) < n:
        base = rng.choices(words, weights, k=rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 15, 40, 100, 300]))
        if rng.random() < 0.3:
            base = passage + base
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 12)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [rng.choice(words)], [copy[at], rng.choice(words)]])
                copy = copy or ["x"]
            texts.append(copy)
    rng.shuffle(texts)
    seps = [" ", "  ", "\n", "\t"]
    return [(7 * i, rng.choice(seps).join(t if rng.random() < 0.7 else [w.upper() for w in t])) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "width"), [(1, 2), (2, 5), (3, 1)])
def test_against_all_pairs(spark, seed, width):
    rows = corpus(seed, 700) + [(90001, None), (90002, ""), (90003, " \n "), (90004, "A\x0bB c"), (90005, "a b\x0cC")]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n int, sig string")
    got = {tuple(r) for r in near_duplicates(df, width).collect()}
    assert got == brute(rows, width)


def test_edges(spark):
    df = spark.createDataFrame([(2, "a b c"), (2, "a b c"), (None, "a b c"), (None, "z")], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(df, 2).collect()), key=str)
    assert got == [(2, 2, 2, True), (2, 2, 2, True), (None, 1, None, True), (None, 2, 2, False)]
    assert near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(df, num=70)


def shared_passage(n, seed=1):
    """Documents of a passage that all have and as many words of their own, and some copies of them with a changed word."""
    rng = random.Random(seed)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(n):
        own = [f"w{rng.randrange(10**7)}" for _ in range(rng.randint(100, 140))]
        rows.append((i, " ".join(own[:50] + passage + own[50:])))
    for i in range(0, n, 50):
        words = rows[i][1].split()
        words[rng.randrange(10)] = "changed"
        rows.append((n + i, " ".join(words)))
    return rows


def test_shared_passages_are_linear(spark, monkeypatch):
    compared, seen = near_dedup._compared, []
    monkeypatch.setattr(near_dedup, "_compared", lambda spread, *a: (seen.append(spread.count()), compared(spread, *a))[1])
    for n in (1000, 4000):
        df = spark.createDataFrame(shared_passage(n), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in near_duplicates(df, 2).collect()}
        assert all(got[i] == i for i in range(n)) and all(got[n + i] == i for i in range(0, n, 50))
    assert seen[1] <= 5 * max(seen[0], 100)


@pytest.mark.parametrize("block", [4, 64])
def test_large_families_against_all_pairs(spark, monkeypatch, block):
    """Small blocks, so that families are split and take many blocks and classes of size."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = corpus(7, 350)
    rng = random.Random(3)
    template = [f"t{i}" for i in range(90)]
    for k in range(120):  # alike, and linked or not
        words = list(template)
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = f"u{rng.randrange(40)}"
        rows.append((50000 + k, " ".join(words[: rng.randint(60, 90)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in near_duplicates(df, 2).collect()} == brute(rows, 2)


def test_classes_are_confirmed(spark):
    """Signatures that lie: unequal sets of one signature part, equal ones stay."""
    ws = near_dedup.Workspace(spark)
    df = spark.createDataFrame([(i, t, n, s, w, b"") for i, t, n, s, w in (
        (1, "a b c", 2, b"x", b"1"), (2, "a b c", 2, b"x", b"1"), (3, "a b d", 2, b"x", b"2"), (4, "b c a b c", 2, b"y", b"3"), (5, "a b c a b", 2, b"y", b"4"),
    )], "doc_id long, text string, n long, sig binary, words binary, sketch binary")
    done = near_dedup._confirmed(df.drop("text"), df.select("doc_id", "text"), ws, 2)
    sig = {r.doc_id: bytes(r.sig) for r in done.collect()}
    assert sig[1] == sig[2] == b"x" and sig[3] != b"x" and sig[4] == sig[5] == b"y"


def test_recall_of_near_pairs(spark):
    """Pairs of sets whose similarity lies between 0.80 and 0.85."""
    rng, rows, want = random.Random(11), [], set()
    for k in range(1500):
        n = rng.randint(30, 400)
        common = [f"c{k}x{i}" for i in range(n)]
        extra = int(n * (1 / rng.uniform(0.801, 0.85) - 1) / 2)
        a, b = (common + [f"{s}{k}x{i}" for i in range(extra)] for s in "ab")
        if n / (n + 2 * extra) >= 0.8:
            want.add(k)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.component_id // 2 for r in near_duplicates(df, 1).where("not kept").collect()}
    assert len(want) > 1000 and found == want
