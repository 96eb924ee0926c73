"""Token files and packing against a plain version; exact duplicates with forced cases."""

import zlib
from array import array

import pytest
from millrace.llm.exact_dedup import exact_duplicates
from millrace.llm.packing import pack_documents, piece_digests, powers_of_two, window_cuts
from millrace.llm.common import tokenizer_path
from millrace.llm.token_files import read_token_files, token_digests, write_token_files
from tokenizers import Tokenizer

TEXTS = [
    (5, "Hello world. This is  a test.\n\n Twice   spaced \n end "),
    (1, ""),
    (2, None),
    (9, "ΣΑΣ ΟΔΟΣ İstanbul é  x  y \x1cz 12345 don't!!"),
    (7, "A sentence here. " * 900),
    (7, "A sentence here. " * 900),
    (11, "x" * 30000),
    (12, "日本語の文章です。 混ぜる text"),
    (13, " leading <|endoftext|> inside"),
    (None, "no id"),
]


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, shard int")


def test_token_files(spark, docs, tmp_path):
    path = str(tmp_path / "t")
    write_token_files(docs, path, tokenizer_path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want, start = [], 0
    for i, t in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    got = sorted(map(tuple, token_digests(read_token_files(spark, path)).collect()), key=lambda r: r[1])
    assert got == want
    some = read_token_files(spark, path, ids=[9], columns=["doc_id", "tokens"]).collect()
    assert some[0].tokens == plain.encode(dict(TEXTS)[9], add_special_tokens=False).ids + [2]
    write_token_files(docs.limit(0), path + "0", tokenizer_path("byte_bpe_50k.json"))
    assert token_digests(read_token_files(spark, path + "0")).count() == 0


def test_packing(docs):
    plain = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces = pack_documents(docs, tokenizer_path("word_bpe_49k.json"), block_tokens=5000).collect()
    seqs = {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append(p)
        assert len(p.ids) > 0
    padding = 0
    for members in seqs.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at
            at += len(p.ids)
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    want = sorted(tuple(plain.encode(t or "", add_special_tokens=False).ids + [1]) for _, t in TEXTS)
    found, whole = [], {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        if p.start == 0:
            found.append([])
        assert len(found[-1]) == p.start
        found[-1] += p.ids
        whole[len(found)] = p.doc_tokens
    assert sorted(map(tuple, found)) == want
    assert [whole[k + 1] for k in range(len(found))] == list(map(len, found))
    assert padding < 0.05 * sum(map(len, found)) + 2048
    digests = piece_digests(pack_documents(docs, tokenizer_path("word_bpe_49k.json"), block_tokens=5000))
    assert sorted(r.ids_crc32 for r in digests.collect()) == sorted(crc(p.ids) for p in pieces)
    assert pack_documents(docs.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_window_cuts_are_optimal():
    import random

    rng = random.Random(3)
    for _ in range(200):
        size, points = 16, []
        while not points or points[-1] < 90:
            points.append((points[-1] if points else 0) + rng.randint(1, 10))
        cost = [rng.choice([0, 3, 9]) for _ in points]
        best = {0: 0}
        for p, c in zip(points, cost):
            best[p] = c + min(best[q] + size - (p - q) for q in best if p - q <= size)
        cuts, at, total = window_cuts(points, cost, size), 0, 0
        for p in cuts:
            assert 0 < p - at <= size
            total, at = total + size - (p - at) + cost[points.index(p)], p
        assert total == best[points[-1]]
    assert powers_of_two(4096 + 1536 + 1, 2048) == [2048, 2048, 1024, 512, 1]


def test_exact_duplicates(spark):
    rows = [(3, "a", 1), (1, "a", 2), (2, "b", 3), (None, "a", 4), (4, None, 5), (5, "", 6), (5, "", 7), (6, "a ", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _n long")
    for keep, a, e in (("min", 1, 4), ("max", 3, 5)):
        got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(df, keep=keep).collect()}
        assert got == {
            (3, a, 3, a == 3), (1, a, 3, a == 1), (None, a, 3, False), (2, 2, 1, True), (6, 6, 1, True),
            (4, e, 3, e == 4), (5, e, 3, e == 5),
        }
    assert exact_duplicates(df, keep="max").count() == len(rows)
    assert exact_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "space"), ("word_bpe_49k.json", "words")])
def test_memo_is_exact(name, kind):
    import random

    from millrace.llm.memo_tokens import PieceMemo

    rng = random.Random(5)
    parts = [
        *"abcXYZéÈßñΣςİıſﬁ.,!?;:'\"|$#0123 \n\t\r\v\f\xa0 \x1c\x00\x01́​日本한", " ", "  ", "\n\n", "\n", " the", "The", "Grün.",
        "don't", "I'll", "'s", "<|endoftext|>", "é", "ẛ̣", "123", "a,", "b.\nC", " \n", "\n ", "ΟΔΟΣ", "ΑΣ.", "ß,",
    ]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(20000)]
    memo, plain = PieceMemo(tokenizer_path(name), kind, most=3000), Tokenizer.from_file(tokenizer_path(name))
    for i in range(0, len(texts), 100):
        some = texts[i : i + 100]
        got = [list(array("i", b)) for b in memo.encode([t.encode() for t in some])]
        want = [e.ids for e in plain.encode_batch_fast(some, add_special_tokens=False)]
        assert got == want, next((t, g, w) for t, g, w in zip(some, got, want) if g != w)
