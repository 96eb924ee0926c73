"""Quality grades: the fit against its own loss, held-out accuracy, and odd rows."""

import random

import numpy as np
from millrace.llm import quality as q

GOOD = "the of and to in is that for it as was with be by on are this from at which report water house people time".split()
RUDE = "clod nitwit scum".split()


def sample(seed, n):
    rng, rows = random.Random(seed), []
    for i in range(n):
        kind = rng.choice([0, 1, 2, 2])
        words = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 7))) if rng.random() < 0.5 else rng.choice(GOOD) for _ in range(rng.randint(15, 120))]
        if kind == 1:
            for _ in range(2 + len(words) // 20):
                words[rng.randrange(len(words))] = rng.choice(RUDE)
        elif kind == 0:
            junk = rng.choice([lambda w: w.upper() + "!!", lambda w: w + "$$$", lambda w: " ".join([w] * 6)])
            words = [junk(w) for w in words]
        rows.append((i, ". ".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)), kind))
    return rows


def test_fit_minimises_its_loss():
    rng = np.random.default_rng(1)
    rows = [rng.choice(40, 6, replace=False) for _ in range(300)]
    truth = rng.normal(size=40)
    grades = [int(np.digitize(truth[r].sum() + rng.logistic(), [-1, 1.5])) for r in rows]
    w, theta = q.fit_ordinal(rows, grades, 3, least_docs=1, least_z=0, l2=1e-3, rounds=1500, step=0.05)
    assert theta[0] < theta[1]

    def loss(w, theta):
        cuts = np.concatenate([[-np.inf], theta, [np.inf]])
        s = np.array([w[r].sum() for r in rows])
        p = 1 / (1 + np.exp(cuts[grades] - s)) - 1 / (1 + np.exp(cuts[np.array(grades) + 1] - s))
        return -np.log(p).mean() + 0.5e-3 * (w**2).sum()

    best = loss(w, theta)
    for k in range(40):
        for d in (-0.05, 0.05):
            moved = w.copy()
            moved[k] += d
            assert loss(moved, theta) >= best - 1e-4
    for k in range(2):
        for d in (-0.05, 0.05):
            moved = theta.copy()
            moved[k] += d
            assert loss(w, moved) >= best - 1e-4
    assert np.corrcoef(w[:40], truth)[0, 1] > 0.9
    w, theta = q.fit_ordinal([], [], 3)
    assert not w.any() and theta[0] < 0 < theta[1]


def test_held_out_accuracy(spark):
    rows = sample(1, 1200)
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows], "doc_id long, text string, grade int")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows] + [(5, None), (10**6, 1)], "doc_id long, grade int")
    model = q.train(docs, labels, 3, sample=1000)
    held = sample(2, 400) + [(900, None, None), (901, "", None), (None, "x " * 50000, None)]
    got = q.grade(spark.createDataFrame([(i, t, "e") for i, t, _ in held], "doc_id long, text string, kept string"), model)
    found = {r.doc_id: r for r in got.collect()}
    assert len(found) == 403
    for k in (1, 2):
        right = sum((found[i].p_at_least[k - 1] >= 0.5) == (g >= k) for i, _, g in held[:400])
        assert right > 0.95 * 400
    assert all(r.p_at_least[0] >= r.p_at_least[1] and abs(sum(r.p_at_least) - r.expected_grade) < 1e-9 for r in found.values())
    for good in (1, 2):
        kept = q.keep_good(docs, model, good)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in q.grade(docs, model, good).where("kept").collect()}
    shares = [sum(found[i].p_at_least[1] >= 0.5 for i, _, g in held[:400] if g == k) / sum(g == k for _, _, g in held[:400]) for k in range(3)]
    assert shares[0] < 0.02 and shares[1] < 0.1 and shares[2] > 0.95
    odd = docs.limit(5).selectExpr("doc_id", "text", "1 as _tails", "2 as `a.b`", "text as _at")
    assert q.keep_good(odd, model).columns == odd.columns
    assert q.grade(docs.limit(0), model).count() == 0
    empty = q.train(docs.limit(0), labels.limit(0), 3)
    assert q.grade(docs, empty).where("kept").count() == 1200


def test_sample_is_bounded_by_rows(spark, monkeypatch):
    docs = spark.range(100_000).selectExpr("id % 3 as doc_id", "concat('text ', id % 500) as text")
    labels = spark.range(50_000).selectExpr("id % 40 as doc_id", "cast(id % 3 as int) as grade")
    seen = []
    monkeypatch.setattr(q, "fit_ordinal", lambda rows, grades, n, **_: seen.append(len(rows)))
    for sample in (2, 10):
        q.train(docs, labels, 3, sample=sample)
    assert seen[0] <= 2 and seen[1] == min(3, seen[1])
    q.train(docs, labels, 3, sample=40)
    assert seen[2] == 3


def test_whole_texts_count():
    tail = "plain words here " * 30000
    assert q.features(tail + "clod") - q.features(tail + "words")
