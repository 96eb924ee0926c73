"""License scans: every line of every text is scored by a classifier on word n-grams; templates confirm what it finds.

Scores add up over n-grams, so a text is cut into paragraphs by dynamic programming: a run of lines is a paragraph of
the class whose weights it collects most of, and each paragraph pays the class's bias and a cost of its own. No word or
pattern decides beforehand what is read.
"""

from __future__ import annotations

import random
import re
from functools import cache
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, quoted
from .license_texts import COMMON, FRAMES, NAMES, NEGATIVES, TEMPLATES

UNKNOWN, NONE = "unknown", "none"  # a notice of no known family; text that is no notice
SWITCH = 2.0  # cost of a paragraph, in log odds, besides its class's bias
_TOKEN = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*|\n|\x00")
_VERSION = re.compile(r"(?:version|v\.?|licen[sc]e,?|gpl|gplv|fdl|mpl|ofl|cc0|by(?:-[a-z]{2})*|apache|[a-z])[ /-]*v?\.? ?([0-9](?:\.[0-9]+)?)\b", re.IGNORECASE)


def words_of(text: str) -> list[str]:
    return [t for t in _TOKEN.findall(text.lower()) if t not in "\n\x00"]


def grams(words: list[str], upto: int = 3) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, upto + 1) for i in range(len(words) - n + 1)}


def invented(rng: random.Random, n: int) -> str:
    """Words of no language, as any text around a notice."""
    syllables = "ba en ti or la ment qui ver sch ou re na ko lu di the of and in".split()
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


def _altered(rng: random.Random, words: list[str]) -> list[str]:
    words = list(words)
    for _ in range(rng.randint(0, max(1, len(words) // 10))):
        at = rng.randrange(len(words))
        if len(words) < 10:
            words.insert(rng.choice([0, len(words)]), invented(rng, 1))
        else:
            words[at : at + 1] = rng.choice([[], [invented(rng, 1)], [words[at], words[at]]])
    return words


def sample_paragraphs(seed: int, per_text: int = 24, templates: dict | None = None) -> list[tuple[str, str]]:
    """(class, paragraph) made of templates, frames and negatives.

    Templates come whole and in windows, as wrapped lines have them, with words lost, changed, repeated or
    put around them; frames with a family's names are notices of it. Notices of no known family are frames
    with other names, and legal language: short pieces of several families' paragraphs in a row. Text that is no notice is invented, or sentences about
    licences, their words in any order, and single words of the templates among others.
    """
    rng, out = random.Random(seed), []
    templates = templates or TEMPLATES
    texts = [(f, t.split()) for f, its in templates.items() for t in its]
    long = [words for _, words in texts if len(words) > 20]
    own = {f: [t.split() for t in its] for f, its in templates.items()}
    every = [w for _, words in texts for w in words]
    for family, words in texts:
        for k in range(per_text):
            some = words
            if len(words) > 14 and k % 3:
                n = rng.randint(9, min(len(words), 30))
                at = rng.randint(0, len(words) - n)
                some = words[at : at + n]
                if k % 3 == 2:  # and a piece of the family's next to it
                    other = rng.choice(own[family])
                    n = rng.randint(4, 12)
                    at = rng.randint(0, max(0, len(other) - n))
                    some = some + other[at : at + n]
            some = some if k == 0 else _altered(rng, some)
            around = [invented(rng, rng.randint(1, 12)) if rng.random() < 0.3 else "" for _ in range(2)]
            out.append((family, f"{around[0]} {' '.join(some)} {around[1]}".strip()))
    for family, names in NAMES.items():
        for name in names:
            for _ in range(per_text if family in templates else 0):
                words = _altered(rng, rng.choice(FRAMES).format(name).split())
                around = [invented(rng, rng.randint(1, 12)) if rng.random() < 0.2 else "" for _ in range(2)]
                out.append((family, f"{around[0]} {' '.join(words)} {around[1]}".strip()))
    for _ in range(40 * per_text):
        name = invented(rng, rng.randint(1, 3)) if rng.random() < 0.8 else rng.choice(["same", "software", "usual", "general", "standard"])
        out.append((UNKNOWN, " ".join(_altered(rng, rng.choice(FRAMES).format(name).split()))))
    for _ in range(15 * per_text):
        pieces = []
        for _ in range(rng.randint(6, 20)):
            words, n = rng.choice(long), rng.randint(1, 3)
            at = rng.randint(0, len(words) - n)
            pieces += words[at : at + n] + ([invented(rng, 1)] if rng.random() < 0.3 else [])
        out.append((UNKNOWN, " ".join(pieces)))
    for text in NEGATIVES:
        for k in range(per_text):
            out.append((NONE, " ".join(_altered(rng, text.split())) if k else text))
    plain = [w for text in NEGATIVES for w in text.split()]
    for _ in range(40 * per_text):
        out.append((NONE, invented(rng, rng.randint(1, 60))))
        out.append((NONE, " ".join(rng.choices(every, k=rng.choice([1, 1, 2, 3])))))
        mixed = rng.choices(plain, k=rng.randint(5, 60)) + rng.choices(every, k=rng.randint(0, 4))
        rng.shuffle(mixed)
        out.append((NONE, " ".join(mixed)))
        for words, share in ((every, 0.05), (COMMON, 0.4), (COMMON, 1.0)):
            n = rng.randint(20, 300)
            sparse = invented(rng, n).split() + rng.choices(words, k=1 + int(share * n * rng.random()))
            rng.shuffle(sparse)
            out.append((NONE, " ".join(sparse)))
    return out


class Classifier:
    """Multinomial logistic regression on the presence of a paragraph's word n-grams, its confidence calibrated.

    Trained on the driver on generated paragraphs with fixed seeds, so it is the same everywhere; a few MB of
    weights go to executors. The temperature is fitted on paragraphs of another seed. A family below `least`
    is unknown. templates: paragraphs by family; more of them (read_templates()) tell more of long licences.
    """

    def __init__(self, seed: int = 7, least: float = 0.6, steps: int = 220, l2: float = 3e-5, templates: dict | None = None, batch: int = 1024):
        import numpy as np

        templates = templates or TEMPLATES
        self.least, self.temperature, self.classes = least, 1.0, [*templates, UNKNOWN, NONE]
        self.templates = {f: [{g for g in grams(words_of(t)) if " " in g} or set(words_of(t)) for t in own] for f, own in templates.items()}
        paragraphs = sample_paragraphs(seed, templates=templates)
        counts: dict[str, int] = {}
        sets = [grams(words_of(p)) for _, p in paragraphs]
        for s in sets:
            for g in s:
                counts[g] = counts.get(g, 0) + 1
        known = sorted(g for g, n in counts.items() if n >= 6)
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for g in known for w in g.split()}))}
        self.size = len(self.vocabulary) + 1
        by_length = [[], [], []]
        for g in known:
            by_length[g.count(" ")].append(self._key([self.vocabulary[w] for w in g.split()]))
        self.keys = [np.array(sorted(k), dtype=np.int64) for k in by_length]
        self.starts = [0, len(self.keys[0]), len(self.keys[0]) + len(self.keys[1])]
        n_features = sum(map(len, self.keys))
        rows = [self.features([p])[0] for _, p in paragraphs]
        y = np.array([self.classes.index(f) for f, _ in paragraphs])
        w = np.zeros((n_features + 1, len(self.classes)), dtype=np.float32)  # the last row is the bias
        m, v = np.zeros_like(w), np.zeros_like(w)
        order = np.random.default_rng(seed).permutation(np.resize(np.arange(len(y)), steps * batch))
        for t in range(1, steps + 1):
            at = order[(t - 1) * batch : t * batch]
            cols = np.concatenate([np.append(rows[i], n_features) for i in at])
            lengths = np.array([len(rows[i]) + 1 for i in at])
            first = np.cumsum(lengths) - lengths
            z = np.add.reduceat(w[cols], first, axis=0)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            by = np.argsort(cols, kind="stable")
            starts = np.flatnonzero(np.diff(cols[by], prepend=-1))
            g = l2 * w
            g[cols[by][starts]] += np.add.reduceat((p / len(at))[np.repeat(np.arange(len(at)), lengths)[by]], starts, axis=0)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights, self.bias = w[:-1], w[-1]
        held = sample_paragraphs(seed + 1, 8, templates)
        truth = [self.classes.index(f) for f, _ in held]
        scores = self.scores([p for _, p in held])

        def loss(temperature: float) -> float:
            z = scores / temperature
            z = z - z.max(axis=1, keepdims=True)
            return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean())

        self.temperature = min((0.25 * 1.15**i for i in range(30)), key=loss)

    def _key(self, ids: list[int]) -> int:
        out = 0
        for i in ids:
            out = out * self.size + i
        return out

    def occurrences(self, texts: list[str]):
        """(unit, feature) of every known n-gram, and units' texts and lines. A unit is a line; n-grams stay within a paragraph.

        Arrays: unit and feature of each occurrence; of each unit with words its text, its line in it, and its block,
        a run of lines with words.
        """
        import numpy as np

        tokens = _TOKEN.findall("\0".join(t.lower().replace("\0", " ") for t in texts))
        ids = np.fromiter(map(self.vocabulary.get, tokens, repeat(-1)), dtype=np.int64, count=len(tokens))
        unknown = np.flatnonzero(ids < 0)
        marks = np.array([{"\n": 1, "\0": 2}.get(tokens[i], 0) for i in unknown.tolist()], dtype=np.int8)
        breaks, ends = unknown[marks > 0], unknown[marks == 2]
        is_word = np.ones(len(tokens), dtype=bool)
        is_word[breaks] = False
        line = np.zeros(len(tokens), dtype=np.int64)
        line[breaks] = 1
        line = np.cumsum(line)
        text = np.zeros(len(tokens), dtype=np.int64)
        text[ends] = 1
        text = np.cumsum(text)[is_word]
        first_line = np.append(0, line[ends])  # of each text, in lines of the whole batch
        ids, line = ids[is_word], line[is_word]
        if not len(ids):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none, none, none
        new_line = np.append(True, line[1:] != line[:-1])
        unit = np.cumsum(new_line) - 1
        lines, texts_of = line[new_line], text[new_line]
        block = np.cumsum(np.append(True, (np.diff(lines) > 1) | (np.diff(texts_of) > 0))) - 1
        block_of = block[unit]
        known = ids >= 0
        pair = known[:-1] & known[1:] & (block_of[:-1] == block_of[1:])
        triple = pair[:-1] & pair[1:]
        units, features = [], []
        keys = ids
        for n, good in ((1, known), (2, pair), (3, triple)):
            if n > 1:
                keys = keys[:-1] * self.size + ids[n - 1 :]
            at = np.flatnonzero(good)
            mine = keys[at]
            place = np.minimum(np.searchsorted(self.keys[n - 1], mine), max(0, len(self.keys[n - 1]) - 1))
            hit = self.keys[n - 1][place] == mine if len(self.keys[n - 1]) else np.zeros(len(at), dtype=bool)
            units.append(unit[at[hit]])
            features.append(place[hit] + self.starts[n - 1])
        return np.concatenate(units), np.concatenate(features), texts_of, lines - first_line[texts_of], block

    def features(self, paragraphs: list[str]) -> list:
        """Sorted distinct features of each paragraph, taken as one line."""
        import numpy as np

        units, found, texts_of, _, _ = self.occurrences([p.replace("\n", " ") for p in paragraphs])
        out = [np.zeros(0, dtype=np.int64)] * len(paragraphs)
        for u, t in enumerate(texts_of.tolist()):
            out[t] = np.unique(found[units == u])
        return out

    def likeness(self, paragraph: str, family: str) -> float:
        """The largest share of a template's word pairs and triples that the paragraph has, or, for paragraphs of
        eight words or more, of the paragraph's that a template has."""
        words = words_of(paragraph)
        own = {g for g in grams(words) if " " in g or len(words) == 1}
        either = [len(t & own) / max(1, min(len(t), len(own) if len(words) >= 8 else len(t))) for t in self.templates.get(family, [])]
        return max(either, default=0.0)

    def scores(self, paragraphs: list[str]):
        import numpy as np

        return np.stack([self.bias + self.weights[f].sum(axis=0, dtype=np.float64) for f in self.features(paragraphs)])

    def predict(self, paragraph: str) -> tuple[str, float]:
        """Class and its probability; unknown where no family reaches `least`."""
        return self.decide(self.scores([paragraph])[0])

    def decide(self, score) -> tuple[str, float]:
        import numpy as np

        z = score / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        if self.classes[best] not in (UNKNOWN, NONE) and p[best] < self.least:
            return UNKNOWN, float(1 - p[best])
        return self.classes[best], float(p[best])

    def paragraphs(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """Of each text: (first line, last line, class, probability) of the paragraphs that aren't of the class none."""
        import numpy as np

        units, features, texts_of, lines, block = self.occurrences(texts)
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        n = len(texts_of)
        if not len(units):
            return out
        width = np.int64(len(self.weights))
        once = np.unique(units * width + features)
        unit, feature = once // width, once % width
        first = np.flatnonzero(np.diff(unit, prepend=-1))
        gain = np.zeros((n, len(self.classes)))
        gain[unit[first]] = np.add.reduceat(self.weights[feature], first, axis=0)
        gain -= gain[:, -1:]  # over none, which is the last class
        start = self.bias.astype(np.float64) - float(self.bias[-1]) - SWITCH
        # A block where even the best class of each line gains less than any paragraph costs has none.
        best = np.maximum(gain[:, :-1].max(axis=1), 0)
        edges = np.append(np.flatnonzero(np.diff(block, prepend=-1)), n)
        able = np.add.reduceat(best, edges[:-1]) + start[:-1].max() > 0
        for a, b in zip(edges[:-1][able].tolist(), edges[1:][able].tolist()):
            for x, y, _ in _segments(gain[a:b], start):
                mine = np.unique(feature[(unit >= a + x) & (unit <= a + y)]) if b - a > 1 else feature[unit == a]
                family, p = self.decide(self.bias + self.weights[mine].sum(axis=0, dtype=np.float64))
                if family != NONE:
                    out[int(texts_of[a])].append((int(lines[a + x]), int(lines[a + y]), family, p))
        return out


def _segments(gain, start) -> list[tuple[int, int, int]]:
    """The best cut of lines into paragraphs: (first, last, class), without those of the last class, none.

    Line i in class c gains gain[i, c]; a paragraph of class c pays -start[c]. The best sum up to line i that
    ends in class c comes from the same class, or from the best of all classes plus start[c].
    """
    import numpy as np

    n, classes = gain.shape
    value = gain[0] + np.where(np.arange(classes) == classes - 1, 0.0, start)
    begins, came = np.zeros((n, classes), dtype=bool), np.zeros(n, dtype=np.int64)
    begins[0] = True
    enter = np.where(np.arange(classes) == classes - 1, 0.0, start)
    for i in range(1, n):
        top = int(value.argmax())
        fresh = value[top] + enter
        begins[i] = fresh > value
        came[i] = top
        value = np.where(begins[i], fresh, value) + gain[i]
    out, c, last = [], int(value.argmax()), n - 1
    for i in range(n - 1, -1, -1):
        if begins[i, c]:
            if c != classes - 1:
                out.append((i, last, c))
            c, last = int(came[i]), i - 1
    return out[::-1]


@cache
def classifier() -> Classifier:
    return Classifier()


def read_templates(folder: str, families: dict[str, str], least_words: int = 8) -> dict[str, list[str]]:
    """TEMPLATES and the paragraphs of the named files of a local folder (on the driver), by the family that families gives them."""
    out = {f: list(texts) for f, texts in TEMPLATES.items()}
    for name, family in families.items():
        with open(f"{folder}/{name}", encoding="utf-8", errors="replace") as f:
            paragraphs = re.split(r"\n\s*\n", f.read())
        out.setdefault(family, []).extend(" ".join(p.split()) for p in paragraphs if len(words_of(p)) >= least_words)
    return out


def version_of(paragraph: str, family: str) -> str | None:
    """The first number in the paragraph that a licence's name, "version" or the like stands before."""
    found = _VERSION.search(paragraph) if family != UNKNOWN else None
    return found[1] if found else None


def scan_texts(texts: list[str], model: Classifier, confirm: float = 0.5) -> list[list[tuple]]:
    """Of each text: (start, end, family, probability, likeness, confirmed, version) of its paragraphs that are notices."""
    out = []
    for text, found in zip(texts, model.paragraphs(texts)):
        rows = []
        if found:
            edges = [0]
            for line in text.split("\n"):
                edges.append(edges[-1] + len(line) + 1)
            for first, last, family, p in found:
                start, end = edges[first], edges[last + 1] - 1
                alike = model.likeness(text[start:end], family)
                rows.append((start, end, family, p, alike, family != UNKNOWN and alike >= confirm, version_of(text[start:end], family)))
        out.append(rows)
    return out


FOUND = "array<struct<start:int,end:int,family:string,probability:double,likeness:double,confirmed:boolean,version:string>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Classifier | None = None) -> DataFrame:
    """One row per row of docs: id, family, n_confirmed, paragraphs.

    Every line of the whole text is scored. paragraphs has each run of lines that is a notice, with its span
    in the text, family, calibrated probability, likeness to the family's nearest template, and version;
    family the confirmed families, sorted and joined by commas, "unknown" where notices stay unconfirmed,
    null where there are none. Null and empty texts have none. Texts are scored in batches of about 1 MB, a
    longer one alone. Repeated rows get equal results; other columns are ignored. No rows: no rows.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or classifier())

    def scan(chunks):
        import pyarrow as pa

        known = shared.value
        entry = pa.struct(
            [("start", pa.int32()), ("end", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64()),
             ("confirmed", pa.bool_()), ("version", pa.string())]
        )
        names = [entry.field(i).name for i in range(entry.num_fields)]
        for chunk in chunks:
            step = max(1, int(chunk.num_rows * (1 << 20) / max(1, chunk.nbytes)))
            for i in range(0, chunk.num_rows, step):
                part = chunk.slice(i, step)
                families, counts, lists = [], [], []
                for found in scan_texts(part.column(1).to_pylist(), known):
                    sure = sorted({f[2] for f in found if f[5]})
                    families.append(",".join(sure) if sure else UNKNOWN if found else None)
                    counts.append(sum(f[5] for f in found))
                    lists.append([dict(zip(names, f)) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(families, pa.string()), pa.array(counts, pa.int64()), pa.array(lists, pa.list_(entry))],
                    names=["id", "family", "n_confirmed", "paragraphs"],
                )

    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]
    done = rows.mapInArrow(scan, f"id {kind}, family string, n_confirmed long, paragraphs {FOUND}")
    return done.withColumnRenamed("id", id_col)
