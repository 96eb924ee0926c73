"""SentencePiece ids against the library, for any chunk size; decoding as a round trip."""

import hashlib
import random
from array import array

import sentencepiece
from millrace.llm import piece_tokens as p
from millrace.llm.common import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
PARTS = [*"abcdeäéñßtheing  \n\t.,!?'\"0123日本한𝄞▁\x00", " the", "ing", "tion", "   ", "\n\n", "    ", "aaaa", "====", "http://", " D", "<s>"]


def texts(seed, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, longest))) for _ in range(n)]


def test_against_library():
    lib, model = sentencepiece.SentencePieceProcessor(model_file=PATH), p.PieceModel(PATH)
    for chunk, some in ((1 << 14, texts(1, 1500, 40)), (40, texts(2, 500, 120)), (64, texts(3, 60, 900)), (48, ["x" * 300, "ab" * 200, " " * 200, "th" * 90])):
        for text, want in zip(some, lib.encode(some)):
            got = list(array("i", p.encode_text(model, text, chunk)))
            assert got == want, (chunk, text)
            assert p.decode_bytes(model, got).decode() == text.replace("▁", " ")


def test_product_is_associative():
    model = p.PieceModel(PATH)
    doc = p.escaped("".join(texts(5, 1, 400)) + "internationalisation" * 20)
    cuts = p.cuts_of(model, len(doc), 50)
    a, b, c, *_ = [p.transfer(model, doc, x, y) for x, y in zip(cuts, cuts[1:])]
    assert p.product(p.product(a, b), c) == p.product(a, p.product(b, c))


def test_tables(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    some = [*texts(7, 30, 600), "", None, "word " * 3000, "internationalisation" * 300, "word " * 3000]
    rows = [(i % 33, t, 1, "c") for i, t in enumerate(some)] + [(None, "no id " * 500, 1, "c"), (5, some[5], 1, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk int, copy string")
    coded = p.encode_documents(df, PATH, giant=700)
    got = sorted(((r.doc_id, list(r.ids)) for r in coded.collect()), key=str)
    assert got == sorted(((i, lib.encode(t or "")) for i, t, *_ in rows), key=str)
    back = sorted(((r.doc_id, r.text) for r in p.decode_documents(coded, PATH).collect()), key=str)
    assert back == sorted(((i, (t or "").replace("▁", " ")) for i, t, *_ in rows), key=str)
    shas = sorted(r.decoded_sha256 for r in p.round_trips(coded, PATH).collect())
    assert shas == sorted(hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest() for _, t, *_ in rows)
    assert p.encode_documents(df.limit(0), PATH).count() == 0
