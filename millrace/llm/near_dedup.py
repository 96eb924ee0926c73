"""Near duplicates: bottom-k sketches, inverted lists of retained values, union-sketch estimates, exact Jaccard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, maybe_members, member_filter, quoted
from .components import connected_components

K = 64  # retained values
RUN = 3  # retained values, next to each other, of one inverted list
WIDE = 512  # retained values where components are told apart
BLOCK = 256  # documents of a family that are compared at a time
RARE = 256  # retained values by which large families are split
HOLDERS = (1, 16, 256)  # steps of how many members have a value
BITS = 1 << 25  # of a bitmap of values
LOWEST = 0.5  # estimates below are dropped: six standard deviations of a sketch of 64 under 0.8
LOWEST_WIDE = 0.7  # and of one of 512


class _WordHashes(dict):
    def __init__(self, most: int = 200_000):
        import xxhash

        self.of, self.most = xxhash.xxh64_intdigest, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = self.of(word)
        return h


_hashes: list[_WordHashes] = []


def _mix(h):
    """A bijection of 64-bit integers that spreads every bit."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Runs of other bytes than blank and 0x09 to 0x0D, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def hashed_shingles(text: str, width: int):
    """The sorted distinct hashes of a text's shingles; all words as one shingle where they are fewer than width."""
    import numpy as np

    if not _hashes:
        _hashes.append(_WordHashes())
    words = words_of(text)
    h = np.fromiter(map(_hashes[0].__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(width, len(words))
    if not n:
        return h
    out = _mix(h[: len(h) - n + 1] + np.uint64(n))
    for j in range(1, n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
    return np.unique(out)


def shingle_set(text: str, width: int) -> set:
    words = words_of(text)
    n = min(width, len(words))
    return set(zip(*(words[j : len(words) - n + 1 + j] for j in range(n)))) if n else set()


def list_keys(sketches: list[bytes], sizes: list[int]):
    """(keys, rows): the inverted lists that each document is in.

    A list is named by RUN retained values that are neighbours in the sketch. Two sets of similarity 0.8
    or more differ in at most a fifth of their union; where sketches hold whole sets, so many breaks leave
    three shared neighbours in the union's order, for any union of more than five. In sketches of 64 they
    are missed with probability 2e-10. Unions of five, a set of four within one of five, get lists of
    their own. Smaller sets are that similar only if equal.
    """
    import numpy as np

    values = np.frombuffer(b"".join(sketches), dtype=np.uint64)
    lengths = np.array([len(s) // 8 for s in sketches], dtype=np.int64)
    row = np.repeat(np.arange(len(sketches)), lengths)
    m = np.uint64(0x9E3779B97F4A7C15)
    if len(values) >= RUN:
        same = row[RUN - 1 :] == row[: len(row) - RUN + 1]
        h = values[: len(values) - RUN + 1]
        for j in range(1, RUN):
            h = _mix(h * m + values[j : len(values) - RUN + 1 + j])
        keys, rows = [h[same]], [row[: len(row) - RUN + 1][same]]
    else:
        keys, rows = [], []
    starts = np.cumsum(lengths) - lengths
    for i in [i for i, n in enumerate(sizes) if n in (4, 5)]:
        own = values[starts[i] : starts[i] + lengths[i]]
        for left in range(5) if sizes[i] == 5 else [None]:
            four = own if left is None else np.delete(own, left)
            h = np.array([4], dtype=np.uint64)
            for v in four:
                h = _mix(h * m + v)
            keys.append(h)
            rows.append(np.array([i]))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(rows)


def estimates(left, right):
    """Jaccard estimates of rows of padded sketches (pad: the largest value): the share of the union's least values in both."""
    import numpy as np

    pad, width = np.uint64(0xFFFFFFFFFFFFFFFF), left.shape[1]
    out = np.empty(len(left))
    for s in range(0, len(left), 2048):
        both = np.sort(np.concatenate([left[s : s + 2048], right[s : s + 2048]], axis=1), axis=1)
        real = both != pad
        again = np.zeros(both.shape, dtype=bool)
        again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
        rank = np.cumsum(real & ~again, axis=1)
        # Only the least values of the union that both sketches reach tell whether a set has them.
        whole = [(x[s : s + 2048] == pad).any(axis=1) for x in (left, right)]
        last = [np.where(w, pad, x[s : s + 2048].max(axis=1)) for w, x in zip(whole, (left, right))]
        reach = np.minimum(*last)[:, None]
        seen = real & (both <= reach) & (rank <= width)
        union = (seen & ~again).sum(axis=1)
        out[s : s + 2048] = (seen & again).sum(axis=1) / np.maximum(union, 1)
    return out


def packed(values) -> bytes:
    """The upper 40 bits of sorted values, five bytes each; order and, but for one pair of values in 10^12, inequality stay."""
    import numpy as np

    return np.ascontiguousarray(values).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def unpacked(blob: bytes):
    import numpy as np

    out = np.zeros((len(blob) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def linked_across(first: tuple, second: tuple | None, num: int, den: int):
    """(rows of first, rows of second) of pairs of unlike components that pass; second None: pairs within first.

    Each side is (component, set size, packed sketch of WIDE values) by row. Where both sketches hold whole sets the
    similarity is exact, and one link from a row to each component is enough. Else the union sketch's
    estimate decides. Overlaps of all pairs come from one product of incidence matrices over shared values.
    """
    import numpy as np

    def side(x):
        return unpacked(b"".join(x[2])), np.repeat(np.arange(len(x[2])), [len(b) // 5 for b in x[2]])

    other = first if second is None else second
    (va, ra), (vb, rb) = side(first), side(other)
    shared = np.unique(va) if second is None else np.intersect1d(va, vb)
    overlap = np.zeros((len(first[2]), len(other[2])), dtype=np.float32)
    places = [np.searchsorted(shared, v) for v in (va, vb)]
    for low in range(0, len(shared), 1 << 14):
        sides = []
        for v, r, at, n in ((va, ra, places[0], len(first[2])), (vb, rb, places[1], len(other[2]))):
            use = (at >= low) & (at < low + (1 << 14)) & (at < len(shared))
            use[use] = shared[at[use]] == v[use]
            m = np.zeros((n, min(1 << 14, len(shared) - low)), dtype=np.float32)
            m[r[use], at[use] - low] = 1
            sides.append(m)
        overlap += sides[0] @ sides[1].T
    comp_a, comp_b = np.asarray(first[0]), np.asarray(other[0])
    n_a, n_b = np.asarray(first[1], dtype=np.int64)[:, None], np.asarray(other[1], dtype=np.int64)[None, :]
    fits = (comp_a[:, None] != comp_b) & (den * np.minimum(n_a, n_b) >= num * np.maximum(n_a, n_b))
    if second is None:
        fits &= np.triu(np.ones(fits.shape, dtype=bool), 1)
    whole = (n_a <= WIDE) & (n_b <= WIDE)
    exact = fits & whole & (den * overlap >= num * (n_a + n_b - overlap))
    a, b = np.nonzero(exact)
    once = np.unique(np.stack([a, comp_b[b]], axis=1), axis=0, return_index=True)[1] if len(a) else slice(0)
    a, b = a[once], b[once]
    c, d = np.nonzero(fits & ~whole & (overlap >= LOWEST * np.minimum(np.minimum(n_a, n_b), WIDE)))
    if len(c):
        pa_, pb_ = (_padded([unpacked(b).tobytes() for b in x[2]], WIDE) for x in (first, other))
        good = np.concatenate(
            [estimates(pa_[c[i : i + 2048]], pb_[d[i : i + 2048]]) >= LOWEST_WIDE for i in range(0, len(c), 2048)]
        )
        a, b = np.concatenate([a, c[good]]), np.concatenate([b, d[good]])
    return a, b


def _padded(blobs: list[bytes], width: int):
    import numpy as np

    out = np.full((len(blobs), width), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for i, b in enumerate(blobs):
        v = np.frombuffer(b, dtype=np.uint64)
        out[i, : len(v)] = v
    return out


def _parts(chunk, most: int):
    step = max(1, int(chunk.num_rows * most / max(1, chunk.nbytes)))
    for i in range(0, chunk.num_rows, step):
        yield chunk.slice(i, step)


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    def sketch(chunks):
        import hashlib

        import pyarrow as pa
        import xxhash

        for chunk in chunks:
            for part in _parts(chunk, 4 << 20):
                texts = part.column(1).to_pylist()
                sets = [hashed_shingles(t, width) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([hashlib.sha256(b" ".join(words_of(t))).digest() for t in texts], pa.binary()),
                        pa.array([s[:K].tobytes() for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n", "sig", "words", "sketch"],
                )

    return docs.mapInArrow(sketch, "doc_id long, n long, sig binary, words binary, sketch binary")


def _confirmed(sketched: DataFrame, rows: DataFrame, ws: Workspace, width: int) -> DataFrame:
    """sketched, where rows of one sig but unequal sets of words, if there are any, get signatures of their own.

    Rows with the same sequence of words (SHA-256) have the same set. One row of each other sequence of a
    sig is compared, set by set, with that of the smallest id. Rows with null ids go by their signature.
    """
    variants = sketched.where("sig IS NOT NULL AND doc_id IS NOT NULL").groupBy("sig", "words").agg(F.min("doc_id").alias("cid"))
    variants = ws.table(variants, "variants")
    several = variants.groupBy("sig").agg(F.count("*").alias("k"), F.min("cid").alias("rep")).where("k > 1")
    others = ws.table(variants.join(several.select(F.col("sig").alias("_sig"), "rep"), F.col("sig") == F.col("_sig")).where("cid <> rep"), "others")

    def compare(chunks):
        import hashlib

        import pyarrow as pa

        for chunk in chunks:
            for part in _parts(chunk, 8 << 20):
                made = []
                for a, b in zip(part.column("ta").to_pylist(), part.column("tb").to_pylist()):
                    mine = shingle_set(a, width)
                    same = mine == shingle_set(b, width)
                    made.append(None if same else hashlib.sha256(b"\n".join(sorted(b" ".join(x) for x in mine))).digest())
                yield pa.RecordBatch.from_arrays([part.column("sig"), part.column("words"), pa.array(made, pa.binary())], names=["_s", "_w", "own"])

    ids = others.select(F.explode(F.array("cid", "rep")).alias("id"))
    texts = ws.table(maybe_members(rows, F.col("doc_id"), member_filter(ids, "id")).groupBy("doc_id").agg(F.min("text").alias("text")), "doubtful")
    left = texts.select(F.col("doc_id").alias("cid"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("rep"), F.col("text").alias("tb"))
    pairs = others.join(left, "cid").join(right, "rep").select("sig", "words", "ta", "tb")
    unequal = ws.table(pairs.mapInArrow(compare, "_s binary, _w binary, own binary").where("own IS NOT NULL"), "unequal")
    for name in ("variants", "others", "doubtful"):
        ws.drop(name)
    if not unequal.head(1):
        return sketched
    joined = sketched.join(unequal, (F.col("sig") == F.col("_s")) & (F.col("words") == F.col("_w")), "left")
    return joined.withColumn("sig", F.coalesce("own", "sig")).drop("_s", "_w", "own")


def _listed(classes: DataFrame) -> DataFrame:
    def keys(chunks):
        import pyarrow as pa

        for chunk in chunks:
            for part in _parts(chunk, 2 << 20):
                got, rows = list_keys(part.column(2).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got.view("int64")), part.column(0).take(pa.array(rows))], names=["key", "cid"]
                )

    return classes.select("cid", "n", "sketch").mapInArrow(keys, "key long, cid long")


def _estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) whose estimate is LOWEST or more."""

    def keep(chunks):
        import pyarrow as pa

        for chunk in chunks:
            for part in _parts(chunk, 8 << 20):
                good = estimates(*(_padded(part.column(c).to_pylist(), K) for c in ("sa", "sb"))) >= LOWEST
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").filter(pa.array(good)), part.column("b").filter(pa.array(good))], names=["a", "b"]
                )

    left = sketches.select(F.col("cid").alias("a"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("cid").alias("b"), F.col("sketch").alias("sb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(keep, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Pairs whose whole shingle sets have den * intersection >= num * union."""

    def check(chunks):
        import pyarrow as pa

        last, held = None, set()
        for chunk in chunks:
            for part in _parts(chunk, 8 << 20):
                good = []
                for b, ta, tb in zip(part.column("b").to_pylist(), part.column("ta"), part.column("tb")):
                    if b != last:
                        last, held = b, shingle_set(tb.as_py(), width)
                    mine = shingle_set(ta.as_py(), width)
                    both = len(mine & held)
                    good.append(den * both >= num * (len(mine) + len(held) - both))
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").filter(pa.array(good)), part.column("b").filter(pa.array(good))], names=["a", "b"]
                )

    left = texts.select(F.col("cid").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("cid").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.select("a", "b", "ta", "tb").sortWithinPartitions("b").mapInArrow(check, "a long, b long")


def _rare_values(members: DataFrame, wide: DataFrame, num: int, den: int) -> DataFrame:
    """(value, cid): of each member the values of which every document that it may be linked with shares one.

    Of RARE retained values, two linked sets share `need` or more: num / den of the larger set where sketches
    hold whole sets, and else the expected number less six standard deviations. So if values are put in any
    one order, they share one of their first (size - need + 1). The order is by how many members have a
    value, in steps of HOLDERS. Values that members of one component alone have stand first and need no
    rows, so members that share a passage and little else have none left.

    The steps are bitmaps of BITS bits each, the only thing that goes to the driver and back, whatever the
    input. Beyond some BITS values they set rarer ones apart less well; the result stays whole.
    """
    share = num / den
    least = int(RARE * share - 6 * (RARE * share * (1 - share)) ** 0.5)

    def spell(chunks):
        import numpy as np
        import pyarrow as pa

        for chunk in chunks:
            for part in _parts(chunk, 1 << 20):
                values = [unpacked(b).view("<i8")[:RARE] for b in part.column("sketch").to_pylist()]
                comps = part.column("comp").to_numpy().repeat([len(v) for v in values])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values)), pa.array(comps)], names=["value", "comp"])

    short = wide.select("cid", "n", F.substring("sketch", 1, 5 * RARE).alias("sketch"))
    sketches = members.join(short, "cid").select("cid", "comp", "n", "sketch")
    held = sketches.mapInArrow(spell, "value long, comp long").groupBy("value")
    held = held.agg(F.count("*").alias("holders"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    at = F.pmod("value", F.lit(BITS)).cast("long") + 1  # buckets begin at one
    step = sum((F.col("holders") > h).cast("int") for h in HOLDERS[1:])
    marks = (
        held.select(at.alias("at"), F.explode(F.sequence(F.lit(0), step)).alias("step"))
        .groupBy("step", F.call_function("bitmap_bucket_number", F.col("at")).alias("bucket"))
        .agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("at"))).alias("bits"))
    )
    rows = marks.collect()  # at most len(HOLDERS) * BITS bits
    shared = members.sparkSession.sparkContext.broadcast([(r.step, r.bucket, bytes(r.bits)) for r in rows])

    def pick(chunks):
        import numpy as np
        import pyarrow as pa

        bitmaps = np.zeros((len(HOLDERS), BITS // 8), dtype=np.uint8)
        for step, bucket, bits in shared.value:
            bitmaps[step, (bucket - 1) * len(bits) : bucket * len(bits)] = np.frombuffer(bits, dtype=np.uint8)
        for chunk in chunks:
            for part in _parts(chunk, 1 << 20):
                found, cids = [], []
                for cid, n, blob in zip(part.column("cid").to_pylist(), part.column("n").to_pylist(), part.column("sketch").to_pylist()):
                    values = unpacked(blob).view("<i8")[:RARE]
                    need = min(-(-num * n // den), least) if n <= RARE else least
                    place = values % BITS
                    steps = (bitmaps[:, place >> 3] >> (place & 7).astype(np.uint8) & 1).sum(axis=0)
                    first = np.lexsort((values, steps))[: len(values) - need + 1]
                    first = first[steps[first] > 0]
                    found.append(values[first])
                    cids.append(np.full(len(first), cid, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(cids))], names=["value", "cid"])

    return sketches.mapInArrow(pick, "value long, cid long")


def _places(members: DataFrame, wide: DataFrame, ws: Workspace, num: int, den: int) -> DataFrame:
    """Where members are compared: place, side, cid, comp, n, sketch.

    members: deep, fam, cid, comp. A family's members go by classes of size, of which only equal and next ones
    can be linked, and by whether they are of its largest component, which isn't compared with itself; of
    these in blocks of BLOCK. A place is two blocks, or one (side 0 alone), that are to be compared.
    """
    per_comp = members.groupBy("deep", "fam", "comp").agg(F.count("*").alias("c"))
    most = per_comp.groupBy("deep", "fam").agg(F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("most")).where("comps > 1")
    most = ws.table(most.select(F.col("deep").alias("_d"), F.col("fam").alias("_f"), F.col("most.comp").alias("major")), "most")
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int") if num < den else F.col("n").cast("int")
    placed = members.join(most, (F.col("deep") == F.col("_d")) & (F.col("fam") == F.col("_f"))).join(wide.select("cid", "n"), "cid")
    placed = ws.table(placed.select("deep", "fam", "cid", "comp", size_class.alias("s"), (F.col("comp") == F.col("major")).alias("own")), "sized")
    counts = placed.groupBy("deep", "fam", "s", "own").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    counts = ws.table(counts, "counts")
    block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("b")
    unit = ["deep", "fam", "s", "own"]
    placed = placed.join(counts, unit).select(*unit, block, "cid", "comp")

    blocks = counts.select(*unit, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    other = blocks.select(*(F.col(c).alias(f"{c}2") for c in blocks.columns))
    same = (F.col("deep") == F.col("deep2")) & (F.col("fam") == F.col("fam2")) & ~(F.col("own") & F.col("own2"))
    equal = same & (F.col("s") == F.col("s2")) & (F.struct("own", "b") <= F.struct("own2", "b2"))
    following = same & (F.col("s") + 1 == F.col("s2"))
    pairs = blocks.join(other, equal).unionAll(blocks.join(other, following))
    pairs = ws.table(pairs.withColumn("place", F.monotonically_increasing_id()), "places")
    first = pairs.select("place", F.lit(0).alias("side"), *blocks.columns)
    second = pairs.where("NOT (s = s2 AND own = own2 AND b = b2)").select(
        "place", F.lit(1).alias("side"), *(F.col(f"{c}2").alias(c) for c in blocks.columns)
    )
    spread = placed.join(first.unionAll(second), blocks.columns).select("place", "side", "cid", "comp")
    return spread.join(wide, "cid").select("place", "side", "cid", "comp", "n", "sketch")


def _compared(spread: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of unlike components that meet in a place and may be linked."""

    def compare(chunks):
        import numpy as np
        import pyarrow as pa

        def pairs(group: list[tuple]):
            alone = not any(r[1] for r in group)
            sides = [[r for r in group if r[1] == k] for k in ((0,) if alone else (0, 1))]
            if not all(sides):
                return
            columns = [tuple(list(x) for x in zip(*((r[3], r[4], r[5]) for r in side))) for side in sides]
            a, b = linked_across(columns[0], None if alone else columns[1], num, den)
            if len(a):
                ids = [np.array([r[2] for r in side]) for side in (sides[0], sides[-1])]
                x, y = ids[0][a], ids[1][b]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

        group: list[tuple] = []
        for chunk in chunks:
            for part in _parts(chunk, 4 << 20):
                for row in zip(*(part.column(c).to_pylist() for c in range(6))):
                    if group and row[0] != group[0][0]:
                        yield from pairs(group)
                        group = []
                    group.append(row)
        if group:
            yield from pairs(group)

    dealt = spread.repartition("place").sortWithinPartitions("place")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _across(placed: DataFrame, texts: DataFrame, ws: Workspace, width: int, num: int, den: int) -> DataFrame:
    """Pairs of unlike components that share a list and may be linked.

    placed: key, cid, comp. Lists with several components go by the least of them, their family, so that a
    document counts once in a family and not once a list. Families of more than BLOCK documents, as those
    of a passage that many have, are split into the components that their rare values make; documents
    whose rare values nobody shares drop out. What is left of them are documents that are alike.
    """
    mixed = placed.groupBy("key").agg(F.min("comp").alias("fam"), F.max("comp").alias("high")).where("fam < high").select("key", "fam")
    mixed = ws.table(mixed, "mixed")
    members = ws.table(placed.join(mixed, "key").select("fam", "cid", "comp").distinct(), "members")
    ws.drop("placed")
    ws.drop("mixed")

    def widen(chunks):
        import pyarrow as pa

        for chunk in chunks:
            for part in _parts(chunk, 8 << 20):
                sets = [hashed_shingles(t, width) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([packed(x[:WIDE]) for x in sets], pa.binary())],
                    names=["cid", "n", "sketch"],
                )

    own = members.select("cid").distinct()
    wide = ws.table(texts.join(own, "cid").select("cid", "text").mapInArrow(widen, "cid long, n long, sketch binary"), "wide")

    ws.sweep()
    large = ws.table(members.groupBy("fam").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).select(F.col("fam").alias("_f")), "large")
    small = members.join(large, F.col("fam") == F.col("_f"), "left_anti").select(F.lit(False).alias("deep"), "fam", "cid", "comp")
    crowd = members.join(large, F.col("fam") == F.col("_f"), "left_semi").select("cid", "comp").distinct()
    rare = ws.table(_rare_values(crowd, wide, num, den), "rare")
    heads = rare.groupBy("value").agg(F.min("cid").alias("b"))
    ws.sweep()
    edges = rare.join(heads, "value").where("cid <> b").select(F.col("cid").alias("a"), "b")
    labels = connected_components(edges, ws, "rare_links").select(F.col("v").alias("cid"), F.col("label").alias("fam"))
    deep = crowd.join(labels, "cid").select(F.lit(True).alias("deep"), "fam", "cid", "comp")
    families = ws.table(small.unionAll(deep), "families")
    return _compared(_places(families, wide, ws, num, den), num, den)


def near_duplicates(
    docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id reachable over links), kept.

    Words are runs of bytes other than blanks and 0x09 to 0x0D, A-Z lowered. Two documents are linked if
    den * intersection >= num * union over their sets of distinct width-word shingles (num / den is 0.8
    or more). One 64-bit hash function orders all shingles; a sketch keeps a set's 64 least hashes.

    Documents with equal sets form a class and take one representative on, so copies cost one row each.
    Inverted lists of three neighbouring retained values give overlaps. First each list offers its members
    its head, and each member is compared with the two heads it overlaps most with; that is linear in the
    lists and makes one component of most groups. Then, where lists still hold several components, large
    families of them are split by their rare values, and pairs across components, of sizes that fit, are
    compared by union sketches of 512 values, in blocks of 256 documents; only those that pass leave the
    task. Every link is confirmed on the whole sets of words of both texts, within classes by one
    comparison for each sequence of words. No list, candidate or component is capped, and nothing is
    gathered on the driver.

    Null or empty text and text without words: n_shingles 0, linked with nothing. Texts of any length count
    whole. Rows with a null id link through equal sets alone. Repeated equal rows get equal results; rows of
    one id but different texts are one document in links, each with the size of its own set (number rows
    first where that isn't wanted). Other columns are ignored. No rows: no rows.
    """
    if 5 * num < 4 * den:
        raise ValueError("the inverted lists hold for a similarity of 0.8 or more")
    ws = Workspace(docs.sparkSession)
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    sketched = _confirmed(ws.table(_sketched(rows, width), "sketched"), rows, ws, width)
    classes = ws.table(
        sketched.where("sig IS NOT NULL")
        .groupBy("sig")
        .agg(F.min("doc_id").alias("cid"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
        .where("cid IS NOT NULL"),
        "classes",
    )
    narrow = ws.table(sketched.select("doc_id", "n", "sig"), "narrow")
    reps = ws.table(classes.select("sig", "cid"), "reps")
    ws.drop("sketched")
    ws.sweep()
    keys = _listed(classes).groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    keys = ws.table(keys, "keys")
    listed = maybe_members(_listed(classes), F.col("key"), member_filter(keys, "key")).join(keys, "key")
    listed = ws.table(listed, "listed")
    ws.drop("keys")

    involved = ws.table(listed.groupBy("cid").agg(F.sum("size").alias("weight")), "involved")
    chosen = member_filter(involved, "cid")
    sketches = ws.table(maybe_members(classes.select("cid", "n", "sketch"), F.col("cid"), chosen), "sketches")
    ws.drop("classes")
    texts = maybe_members(rows.withColumnRenamed("doc_id", "cid"), F.col("cid"), chosen)
    texts = ws.table(texts, "texts")

    # A list's head is its member in the most and longest lists: of a text and its changed copies, the text.
    heads = listed.join(involved, "cid").groupBy("key").agg(F.max(F.struct("weight", -F.col("cid"))).alias("head"))
    heads = ws.table(heads.select("key", (-F.col("head")["col2"]).alias("head")), "heads")
    closest = Window.partitionBy("a").orderBy(F.desc("overlap"), "b")
    stars = (
        listed.join(heads, "key")
        .where("cid <> head")
        .groupBy(F.col("cid").alias("a"), F.col("head").alias("b"))
        .agg(F.count("*").alias("overlap"))
        .withColumn("rank", F.row_number().over(closest))
        .where("rank <= 2")
    )
    first = ws.table(_verified(_estimated(stars, sketches), texts, width, num, den), "links_1")
    ws.drop("sketches", "heads")
    ws.sweep()
    comps = connected_components(first, ws, "stars").select(F.col("v").alias("cid"), F.col("label").alias("comp"))
    placed = ws.table(listed.join(comps, "cid", "left").select("key", "cid", F.coalesce("comp", "cid").alias("comp")), "placed")
    ws.drop("listed")
    ws.sweep()
    pairs = ws.table(_across(placed, texts, ws, width, num, den), "pairs")
    ws.drop("wide")
    ws.sweep()
    second = ws.table(_verified(pairs, texts, width, num, den), "links_2")
    ws.drop("texts")
    ws.sweep()
    both = first.unionAll(second)
    labels = connected_components(both, ws, "all").select(F.col("v").alias("cid"), "label")

    named = ws.table(
        reps.join(labels, "cid", "left").select(F.col("sig").alias("_sig"), F.coalesce("label", "cid").alias("label")),
        "named",
    )
    for name in ("reps", "involved", "members", "large", "rare", "families", "most", "sized", "counts", "places", "pairs"):
        ws.drop(name)
    out = narrow.join(named, F.col("sig") == F.col("_sig"), "left")
    component = F.coalesce("label", "doc_id")
    return out.select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
