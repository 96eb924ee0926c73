"""Quality grades of documents: cumulative-link regression on hashed text features."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, prepare, quoted

LEAST = 0.6  # probability from which a document counts as of a grade
BITS = 18  # weights are shared by 2^18 hashed features
SIGNS = "!$#%&*|@<>{}=+"
MARKS = ".,!?;:$#%&*"  # go from a word's ends
PREFIXES = (4, 6)  # beginnings of longer words, for inflected and compound forms that no sample has all of


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 150_000:
            self.clear()
        self[word] = b = zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
        return b


_buckets = _Buckets()


def _level(x: float) -> int:
    """A ratio in steps of a factor of two, 0 for none."""
    return 0 if x <= 0 else max(1, 12 + math.floor(math.log2(x)))


def traits(text: str, words: list[str]) -> Iterator[str]:
    """What a text is like as a whole, in coarse steps: signs, capitals, repeats, length."""
    n, lines = max(1, len(text)), text.split("\n")
    letters = sum(map(text.count, SIGNS)) / n
    yield f"\0signs {_level(letters)}"
    for sign in SIGNS:
        if c := text.count(sign):
            yield f"\0sign {sign} {_level(c / n)}"
    yield f"\0capitals {_level(sum(1 for w in words if len(w) > 1 and w.isupper()) / max(1, len(words)))}"
    yield f"\0digits {_level(sum(map(text.count, '0123456789')) / n)}"
    yield f"\0distinct words {round(10 * len(set(words)) / max(1, len(words)))} {len(words).bit_length()}"
    yield f"\0words like the one before {_level(sum(map(eq, words, words[1:])) / max(1, len(words)))}"
    yield f"\0distinct lines {round(10 * len(set(lines)) / len(lines))}"
    yield f"\0words {len(words).bit_length()}"
    yield f"\0word length {round(n / max(1, len(words)))}"


def features(text: str) -> set[int]:
    """Hashed features of a whole text: its lower-case words, each once, their beginnings, and its traits."""
    words = text.split()
    distinct = {w.strip(MARKS) for w in set(text.lower().split())}
    found = set(map(_buckets.__getitem__, distinct))
    for n in PREFIXES:
        found.update(map(_buckets.__getitem__, {f"\0{w[:n]}" for w in distinct if len(w) > n}))
    found.update(map(_buckets.__getitem__, traits(text, words)))
    return found


def evidence(index, at, grades, n_grades: int, least_docs: int):
    """How far a feature's share of some grade and above is off, in standard deviations; 0 for features of fewer than least_docs rows."""
    import numpy as np

    size, n = 1 << BITS, len(grades)
    count = np.bincount(index, minlength=size)
    out = np.zeros(size)
    for k in range(1, n_grades):
        above = (grades >= k).astype(float)
        share = above.mean()
        found = np.bincount(index, weights=above[at], minlength=size)
        spread = np.sqrt(np.maximum(count * share * (1 - share) * (1 - count / n), 1e-12))
        out = np.maximum(out, np.abs(found - count * share) / spread)
    return np.where(count >= least_docs, out, 0.0)


def fit_ordinal(
    rows: list, grades: list[int], n_grades: int, least_docs: int = 5, least_z: float = 4.0, l2: float = 1e-5, rounds: int = 200, step: float = 0.3
):
    """(weights, thresholds) of P(grade >= k) = sigmoid(score - threshold[k]), k from 1, by Adam on all rows.

    Thresholds are ordered: each is the one before plus a positive step. Features of less evidence() than
    least_z get no weight, and l2 weighs on the others by the inverse square of theirs (up to 50), so that
    a few words that always tell count for more than many that did by chance. With least_z 0 it weighs
    on all alike. With no rows the thresholds are those of equally likely grades.
    """
    import numpy as np

    size, y = 1 << BITS, np.array(grades, dtype=np.int64)
    share = (np.bincount(y, minlength=n_grades) + 1) / (len(y) + n_grades)
    above = np.cumsum(share[::-1])[::-1][1:]
    theta = -np.log(above / (1 - above))
    weights = np.zeros(size)
    if len(set(grades)) < 2:
        return weights, theta
    index = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows])
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    z = evidence(index, at, y, n_grades, least_docs)
    chosen = z >= max(least_z, 1e-9) if least_z else np.bincount(index, minlength=size) >= least_docs
    names = np.flatnonzero(chosen)
    keep = chosen[index]
    index, at = np.searchsorted(names, index[keep]), at[keep]
    k = len(names)
    scale = np.minimum(z[names], 50) / 50 if least_z else np.ones(k)
    # Rows and features as runs of one array each, so that sums are one pass; a last place stands for none.
    row_at = np.searchsorted(at, np.arange(len(y)))
    empty = np.append(row_at[1:], len(at)) == row_at
    order = np.argsort(index, kind="stable")
    at_by_name = at[order]
    name_at = np.searchsorted(index[order], np.arange(k))
    w = np.zeros(k + n_grades - 1)
    w[k] = theta[0]
    w[k + 1 :] = np.log(np.expm1(np.maximum(np.diff(theta), 1e-3)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        score = np.zeros(len(y))
        if k:
            score = np.where(empty, 0.0, np.add.reduceat(np.append((w[:k] * scale)[index], 0.0), row_at))
        cuts = np.concatenate([[-np.inf], w[k] + np.concatenate([[0], np.cumsum(np.log1p(np.exp(w[k + 1 :])))]), [np.inf]])
        with np.errstate(over="ignore"):
            low = 1 / (1 + np.exp(cuts[y] - score))  # P(grade >= y)
            high = 1 / (1 + np.exp(cuts[y + 1] - score))  # P(grade > y)
        p = np.maximum(low - high, 1e-9)
        d_low, d_high = low * (1 - low) / p, high * (1 - high) / p
        g_score = -(d_low - d_high) / len(y)
        g = np.zeros_like(w)
        if k:
            g[:k] = scale * np.add.reduceat(g_score[at_by_name], name_at) + l2 * w[:k]
        g_cut = np.zeros(n_grades + 1)
        np.add.at(g_cut, y, d_low / len(y))
        np.add.at(g_cut, y + 1, -d_high / len(y))
        g_cut = g_cut[1:n_grades]
        tail = np.cumsum(g_cut[::-1])[::-1]
        g[k] = tail[0]
        g[k + 1 :] = tail[1:] / (1 + np.exp(-w[k + 1 :]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    weights[names] = w[:k] * scale
    return weights, w[k] + np.concatenate([[0], np.cumsum(np.log1p(np.exp(w[k + 1 :])))])


def train(
    docs: DataFrame, grades: DataFrame, n_grades: int, sample: int = 12_000, id_col: str = "doc_id", text_col: str = "text", **fit
):
    """Fit on at most `sample` graded documents, those whose hashed ids are least; grades has id_col and grade.

    The bound is the feature rows sent to the driver: an id counts once, with its highest grade and the
    text of least hash, however often it is repeated in either table. Null grades, ids and texts don't
    count. Only ids of the sample are broadcast, and their rows' features are made on the executors.
    """
    chosen = (
        grades.select(quoted(id_col).alias("_id"), F.col("grade").cast("int").alias("_grade"))
        .where("_grade IS NOT NULL AND _id IS NOT NULL")
        .groupBy("_id")
        .agg(F.max("_grade").alias("_grade"))
        .orderBy(F.xxhash64(F.lit("sample"), "_id"), "_id")
        .limit(sample)
    )

    def extract(chunks):
        import numpy as np

        for chunk in chunks:
            made = [np.array(sorted(features(t)), dtype="<i4").tobytes() for t in chunk.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(made, pa.binary())], names=["grade", "features"])

    prepare(docs.sparkSession)
    rows = (
        docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"))
        .where("_text IS NOT NULL")
        .join(F.broadcast(chosen), "_id")
        .groupBy("_id", "_grade")
        .agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
        .select("_grade", "_text")
        .mapInArrow(extract, "grade int, features binary")
    )
    import numpy as np

    got = sorted((r.grade, bytes(r.features)) for r in rows.collect())
    return fit_ordinal([np.frombuffer(f, dtype="<i4") for _, f in got], [g for g, _ in got], n_grades, **fit)


def tail_probabilities(spark: SparkSession, model):
    """An Arrow function of a text column: P(grade >= k) for k from 1, of whole texts; null text counts as empty.

    The weights are 2 MB whatever the input.
    """
    prepare(spark)
    weights, theta = model
    shared = spark.sparkContext.broadcast((weights.astype("f8"), theta))

    @F.arrow_udf("array<double>")
    def tails(texts: pa.Array) -> pa.Array:
        import numpy as np

        w, cuts = shared.value
        sums = np.zeros(len(texts))
        for i, text in enumerate(texts):
            sums[i] = w[np.sort(np.fromiter(features(text.as_py() or ""), dtype=np.int64))].sum()
        out = 1 / (1 + np.exp(np.clip(cuts[None, :] - sums[:, None], -700, 700)))
        return pa.array(list(out), pa.list_(pa.float64()))

    return tails


def grade(docs: DataFrame, model, good: int = 1, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, p_at_least (P(grade >= k) for k from 1), expected_grade and kept of each row, from whole texts.

    kept: P(grade >= good) is `least` or more. Null text counts as empty. Rows stay one to one, repeated
    ones and null ids too; other columns are ignored. No rows: no rows.
    """
    tails = tail_probabilities(docs.sparkSession, model)
    return docs.select(quoted(id_col), tails(quoted(text_col)).alias("p_at_least")).select(
        quoted(id_col),
        "p_at_least",
        F.aggregate("p_at_least", F.lit(0.0), lambda a, p: a + p).alias("expected_grade"),
        (F.col("p_at_least")[good - 1] >= least).alias("kept"),
    )


def keep_good(docs: DataFrame, model, good: int = 1, least: float = LEAST, text_col: str = "text") -> DataFrame:
    """Rows of docs, whole, whose P(grade >= good) is `least` or more; each row is judged by its own text, a null one as empty.

    Columns of any name and repeated rows pass unchanged. No rows: no rows.
    """
    tails, name = tail_probabilities(docs.sparkSession, model), free_name(docs, "_tails")
    scored = docs.withColumn(name, tails(quoted(text_col))).where(F.col(name)[good - 1] >= least)
    return scored.select(*map(quoted, docs.columns))


TOP_GRADE = 2


def graded_labels(labels: DataFrame) -> DataFrame:
    """Three grades of labelled documents: 0 poor, 1 good but toxic, 2 good."""
    return labels.select(
        "doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, TOP_GRADE).alias("grade")
    )
