"""MPEG audio: exact round trip, damage, tags and tables built by hand."""

import hashlib
import random
import zlib

from millrace.llm import mpeg_audio as m


def frame(header, fill=0):
    return header + bytes([fill]) * (m.header_of(header + b"....", 0)[0] - 4)


def test_headers():
    assert m.header_of(bytes((0xFF, 0xFB, 0x90, 0x00)), 0)[:4] == (417, 1152, 44100, 128)
    assert m.header_of(bytes((0xFF, 0xFB, 0x92, 0x00)), 0)[0] == 418
    assert m.header_of(bytes((0xFF, 0xF3, 0x80, 0xC0)), 0)[:5] == (208, 576, 22050, 64, 9)
    assert m.header_of(bytes((0xFF, 0xFF, 0x14, 0x00)), 0)[:3] == (32, 384, 48000)
    for wrong in ((0xFF, 0xEB, 0x90, 0), (0xFF, 0xFB, 0xF0, 0), (0xFF, 0xFB, 0x9C, 0), (0xFF, 0xFB, 0x00, 0), (0xFF, 0xF9, 0x90, 0)):
        head = m.header_of(bytes(wrong), 0)
        assert head is None
    slow = [m.crc16(bytes([b])) for b in range(4)]
    assert len(set(slow)) == 4 and m.crc16(b"123456789") == 0xAEE7  # CRC-16/CMS


def test_resync_tables_and_tags():
    a, b = bytes((0xFF, 0xFB, 0x90, 0x00)), bytes((0xFF, 0xFB, 0xB0, 0x00))  # 128 and 192 kbit/s
    tag = b"ID3\3\0\0" + m.syncsafe(10 + 5) + b"TIT2" + (5).to_bytes(4, "big") + b"\0\0" + b"\0Song"
    old = (b"TAG" + b"Other".ljust(30, b"\0") + b"Me".ljust(30, b"\0")).ljust(128, b"\0")
    junk = b"\xff\xfb\x90junk\xff\xe0"
    data = tag + frame(a) + frame(a) + junk + frame(b) + frame(a) + frame(b) + old
    found = m.parse(data)
    assert found["n_frames"] == 5 and found["lost_bytes"] == len(junk) and found["kbps"] == [128, 192]
    at = len(tag) + 2 * 417 + len(junk)
    assert found["seek"].tolist() == [len(tag), len(tag) + 417, at, at + 626, at + 626 + 417]
    assert found["tags"] == {"TIT2": "Song", "TPE1": "Me"}
    assert (found["duration_num"], found["duration_den"]) == (32, 245)  # 5 * 1152 / 44100
    xing = a + bytes(32) + b"Xing" + (1).to_bytes(4, "big") + (2).to_bytes(4, "big") + b"LAME3.100" + bytes(12) + (576 << 12 | 100).to_bytes(3, "big")
    found = m.parse(xing.ljust(417, b"\0") + frame(a) + frame(b))
    assert (found["table_kind"], found["table_frames"], found["n_frames"], found["samples"]) == ("Xing", 2, 2, 2 * 1152 - 676)
    vbri = a + bytes(32) + b"VBRI" + bytes(6) + (999).to_bytes(4, "big") + (7).to_bytes(4, "big") + bytes((0, 2, 0, 3, 0, 1, 0, 1, 5, 6))
    assert m.parse(vbri.ljust(417, b"\0") + frame(a))["toc"] == [0, 15]
    assert m.parse(b"")["n_frames"] == 0 and m.parse(b"\xff" * 99)["n_frames"] == 0


def test_damage_is_found():
    payload = bytes(random.Random(1).randbytes(192 * 40))
    media = bytearray(m.frames_of(payload, 5))
    whole = m.parse(bytes(media))
    assert m.payload_of(bytes(media), whole["seek"]) == payload and whole["crc_good"] == 40 and whole["lost_bytes"] == 0
    media[whole["seek"][7] + 10] ^= 1  # side information
    cut = bytes(media[: whole["seek"][20]] + media[whole["seek"][20] + 100 :])
    found = m.parse(cut)
    assert found["n_frames"] == 39 and (found["crc_good"], found["crc_bad"]) == (38, 1) and found["lost_bytes"] == 140


def test_texts(spark):
    texts = ["a", "", None, "é" * 96, "x" * 193, "word " * 50000, "a"]
    df = spark.createDataFrame([(i, t, b"z") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    got = m.media_digests(m.texts_to_media(df)).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        raw = (text or "").encode()
        padded = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (row.n_bytes, row.payload_bytes, row.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-16:]))
        assert row.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert f"frames={len(padded) // 192};" in row.feature and "+0;lost=0" in row.feature
    assert got[0][1:] == got[6][1:]
    assert m.media_digests(m.texts_to_media(df.limit(0))).count() == 0
    probed = m.probe_media(m.texts_to_media(df).withColumn("tags", m.F.lit(1)), "doc_id", "media").orderBy("doc_id").collect()
    assert probed[4].n_frames == 2 and len(probed[4].seek) == 2 and probed[4].tags == {"payload_bytes": "193"} and probed[4].table_frames == 2


def test_text_that_looks_like_a_tag(spark):
    one = "x" * 64 + "TAG" + "y" * 125
    texts = [one, "z" * 192 + one, one[:190], "x" * 64 + "TAG", one * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = m.media_digests(m.texts_to_media(df)).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        raw = text.encode()
        padded = raw.ljust(-(-len(raw) // 192) * 192, b" ")
        assert (row.payload_bytes, row.tail_crc32, row.payload_sha256) == (len(padded), zlib.crc32(padded[-16:]), hashlib.sha256(padded).hexdigest())
        assert f"frames={len(padded) // 192};" in row.feature and "+0;lost=0" in row.feature
    media = m.frames_of(one.encode(), 192)
    assert set(m.parse(media)["tags"]) == {"payload_bytes"}
    tagged = m.parse(media + (b"TAG" + b"Other").ljust(128, b"\0"))
    assert tagged["n_frames"] == 1 and tagged["lost_bytes"] == 0 and tagged["tags"]["TIT2"] == "Other"
    data = bytearray(frame(bytes((0xFF, 0xFB, 0x14, 0xC0))) * 9)  # 96 bytes each: the tag's place is in the last but one
    data[-128:-125] = b"TAG"
    found = m.parse(bytes(data))
    assert found["n_frames"] == 9 and found["lost_bytes"] == 0 and found["tags"] == {}
