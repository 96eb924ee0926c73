"""MPEG audio columns: frames found again after damage, tags, variable-bitrate tables, checksums, seek offsets."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bitrate index (0: free format, 15: forbidden), Hz by rate index.
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

UNIT = 192  # payload bytes in a frame
FRAME = 240  # bytes of a frame: layer III, 80 kbit/s, 48 kHz
HEADER = bytes((0xFF, 0xFA, 0x64, 0xC0))  # MPEG-1 layer III, protected, 80 kbit/s, 48 kHz, no padding, mono
INFO_HEADER = bytes((0xFF, 0xFB, 0x64, 0xC0))  # the same without a checksum
SIDE = 17  # bytes of side information of such a frame; zeros mean silence


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1
        table.append(c)
    return table


CRC_TABLE = _crc_table()


def crc16(data: bytes) -> int:
    c = 0xFFFF
    for byte in data:
        c = (c << 8 & 0xFFFF) ^ CRC_TABLE[c >> 8 ^ byte]
    return c


def syncsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def from_syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def header_of(data: bytes, at: int):
    """(frame bytes, samples, Hz, kbit/s, side information's bytes, protected, layer, version, mono), or None for no header.

    Free format, whose frame length the header doesn't tell, counts as no header."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3)
    rate, index = data[at + 2] >> 2 & 3, data[at + 2] >> 4
    if version == 1 or layer == 4 or rate == 3 or index in (0, 15) or data[at + 3] & 3 == 2:
        return None
    low = version != 3
    kbps = KBPS[(2, 1 if layer == 1 else 2) if low else (1, layer)][index]
    hertz, padding, mono = HERTZ[version][rate], data[at + 2] >> 1 & 1, data[at + 3] >> 6 == 3
    samples = 384 if layer == 1 else 576 if layer == 3 and low else 1152
    length = (12 * kbps * 1000 // hertz + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hertz + padding
    side = ((9 if mono else 17) if low else (17 if mono else 32)) if layer == 3 else 0
    return length, samples, hertz, kbps, side, not data[at + 1] & 1, layer, version, mono


def id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """Bytes of the tag at the start, and its text frames (TXXX by its description)."""
    if len(data) < 10 or data[:3] != b"ID3" or any(b & 128 for b in data[6:10]):
        return 0, {}
    end = min(len(data), 10 + from_syncsafe(data[6:10]))
    at, tags, wide = 10, {}, data[3] < 4
    if data[5] & 0x40 and at + 4 <= end:
        at += int.from_bytes(data[at : at + 4], "big") + 4 if wide else from_syncsafe(data[at : at + 4])
    while data[3] >= 3 and at + 10 <= end and data[at]:
        size = int.from_bytes(data[at + 4 : at + 8], "big") if wide else from_syncsafe(data[at + 4 : at + 8])
        name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : min(at + 10 + size, end)]
        if name[0] == "T" and body:
            codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8")
            text = body[1:].decode(codec, "replace").rstrip("\0")
            if name == "TXXX":
                name, _, text = text.partition("\0")
            tags[name] = text
        at += 10 + size
    return end + (10 if data[5] & 0x10 else 0), tags


def id3v1(data: bytes) -> dict[str, str]:
    tag = data[-128:]
    if len(tag) < 128 or tag[:3] != b"TAG":
        return {}
    fields = {"TIT2": tag[3:33], "TPE1": tag[33:63], "TALB": tag[63:93], "TDRC": tag[93:97]}
    return {k: s for k, v in fields.items() if (s := v.split(b"\0")[0].decode("latin-1").strip())}


def vbr_table(data: bytes, at: int, head) -> dict | None:
    """The Xing, Info or VBRI table in the frame at `at`: frames, bytes, toc (byte offsets), delay and padding."""
    side, protected = head[4], head[5]
    for start in {at + 4 + side, at + 4 + side + 2 * protected}:
        if data[start : start + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(data[start + 4 : start + 8], "big"), start + 8
            out = {"kind": data[start : start + 4].decode(), "frames": None, "bytes": None, "toc": [], "delay": 0, "padding": 0}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 4:
                out["toc"] = [x * (out["bytes"] or 0) // 256 for x in data[p : p + 100]]
                p += 100
            p += 4 * bool(flags & 8)
            if data[p : p + 4] in (b"LAME", b"Lavf", b"Lavc") and p + 24 <= at + head[0]:
                n = int.from_bytes(data[p + 21 : p + 24], "big")
                out["delay"], out["padding"] = n >> 12, n & 0xFFF
            return out
    if data[at + 36 : at + 40] == b"VBRI" and at + 62 <= len(data):
        size, frames, entries, scale, width = (
            int.from_bytes(data[at + a : at + b], "big") for a, b in ((46, 50), (50, 54), (54, 56), (56, 58), (58, 60))
        )
        toc, total = [], 0
        for i in range(entries if 1 <= width <= 4 else 0):
            toc.append(total)
            total += scale * int.from_bytes(data[at + 62 + i * width : at + 62 + (i + 1) * width], "big")
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "delay": 0, "padding": 0}
    return None


def checksum_bytes(head) -> int | None:
    """Bytes after the checksum that it covers; None where that hangs on layer II tables or the joint stereo bound."""
    if head[6] == 3:
        return head[4]
    return 16 if head[6] == 1 and head[8] else None


def parse(data: bytes) -> dict:
    """Everything that is stored of one MPEG audio file.

    After damage the next place counts where a header is followed, one frame on, by a header of the same
    version, layer and rate, by a tag or by the end. Runs of frames with the same header are read as one
    array. The frame that holds a variable-bitrate table is no audio frame. An ID3v1 tag counts unless a
    frame covers its place, and ends with the file or before another such header.
    """
    import numpy as np

    start, tags = id3v2(data)
    end = len(data) - (128 if data[-128:-125] == b"TAG" else 0)
    bytes_ = np.frombuffer(data, dtype=np.uint8)
    table_ = np.array(CRC_TABLE, dtype=np.uint16)
    offsets, lost, good, bad, table = [], 0, 0, 0, None
    rates: dict[int, int] = {}
    kbit: set[int] = set()
    at, trusted = start, False

    while at < end and at + 4 <= len(data):
        head = header_of(data, at)
        after = at + head[0] if head else end
        if head and (not trusted or after > end):
            follows = header_of(data, after)
            if after in (end, len(data)) or follows and (follows[2], follows[6], follows[7]) == (head[2], head[6], head[7]):
                end = len(data) if after > end else end  # what looks like a tag belongs to a frame
            else:
                head = None
        if not head or at + head[0] > end:
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            lost, at, trusted = lost + found - at, found, False
            continue
        length = head[0]
        trusted = True
        if not offsets and table is None and (table := vbr_table(data, at, head)):
            at += length
            continue
        n = (end - at) // length
        rows = bytes_[at : at + n * length].reshape(n, length)
        same = (rows[:, :4] == rows[0, :4]).all(axis=1)
        n = n if same.all() else int(same.argmin())
        rows = rows[:n]
        if head[5] and (covered := checksum_bytes(head)) is not None:
            crc = np.full(n, 0xFFFF, dtype=np.uint16)
            for column in (2, 3, *range(6, 6 + covered)):
                crc = (crc << np.uint16(8)) ^ table_[(crc >> np.uint16(8)) ^ rows[:, column]]
            ok = int((crc == rows[:, 4].astype(np.uint16) << np.uint16(8) | rows[:, 5]).sum())
            good, bad = good + ok, bad + n - ok
        offsets.append(at + length * np.arange(n, dtype=np.int64))
        rates[head[2]] = rates.get(head[2], 0) + n * head[1]
        kbit.add(head[3])
        at += n * length
    lost += max(0, end - at)
    tags = id3v1(data) | tags if end < len(data) else tags
    trim = table["delay"] + table["padding"] if table else 0
    if trim and len(rates) == 1:
        rates = {hz: max(0, s - trim) for hz, s in rates.items()}
    duration = sum((Fraction(s, hz) for hz, s in rates.items()), Fraction(0))
    return {
        "n_frames": sum(map(len, offsets)),
        "samples": sum(rates.values()),
        "duration_num": duration.numerator,
        "duration_den": duration.denominator,
        "sample_rates": sorted(rates),
        "kbps": sorted(kbit),
        "crc_good": good,
        "crc_bad": bad,
        "lost_bytes": lost,
        "table_kind": table and table["kind"],
        "table_frames": table and table["frames"],
        "table_bytes": table and table["bytes"],
        "toc": table["toc"] if table else [],
        "tags": tags,
        "seek": np.concatenate(offsets) if offsets else np.zeros(0, dtype=np.int64),
    }


def frames_of(payload: bytes, n_bytes: int) -> bytes:
    """A silent MPEG-1 layer III file that carries the payload in the ancillary bytes of its frames.

    payload is a positive multiple of 192 bytes; n_bytes, its unpadded length, goes to a tag.
    """
    import numpy as np

    body = b"\x03payload_bytes\0" + str(n_bytes).encode()
    tag = b"TXXX" + syncsafe(len(body)) + b"\0\0" + body
    units = len(payload) // UNIT
    rows = np.zeros((units, FRAME), dtype=np.uint8)
    head = HEADER + crc16(HEADER[2:] + bytes(SIDE)).to_bytes(2, "big")
    rows[:, : len(head)] = np.frombuffer(head, dtype=np.uint8)
    rows[:, FRAME - UNIT :] = np.frombuffer(payload, dtype=np.uint8).reshape(units, UNIT)
    info = INFO_HEADER + bytes(SIDE) + b"Info" + (7).to_bytes(4, "big") + units.to_bytes(4, "big")
    info += ((units + 1) * FRAME).to_bytes(4, "big") + bytes(256 * i // 100 for i in range(100))
    return b"ID3\4\0\0" + syncsafe(len(tag)) + tag + info.ljust(FRAME, b"\0") + rows.tobytes()


def payload_of(media: bytes, seek) -> bytes:
    """The payload of frames_of() out of the frames at the given offsets."""
    import numpy as np

    rows = np.frombuffer(media, dtype=np.uint8)[seek[:, None] + np.arange(FRAME - UNIT, FRAME)] if len(seek) else np.zeros(0, np.uint8)
    return rows.tobytes()


def _slices(chunk, most: int = 16 << 20):
    """Slices of an Arrow batch of about `most` bytes, so results of long rows don't gather."""
    step = max(1, int(chunk.num_rows * most / max(1, chunk.nbytes)))
    for i in range(0, chunk.num_rows, step):
        yield chunk.slice(i, step)


def texts_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media: each whole text as UTF-8, padded with blanks to a positive multiple of 192 bytes, as MPEG audio.

    Null text counts as empty. Equal texts give equal bytes. Rows, also repeated ones, stay one to one;
    other columns are ignored.
    """

    def encode(chunks):
        import pyarrow as pa

        for chunk in chunks:
            for part in _slices(chunk):
                media = []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    pad = UNIT if not text else -len(text) % UNIT
                    media.append(frames_of(text + b" " * pad, len(text)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, media binary")


PROBE = (
    "n_frames long, samples long, duration_num long, duration_den long, sample_rates array<int>, kbps array<int>, crc_good long, "
    "crc_bad long, lost_bytes long, table_kind string, table_frames long, table_bytes long, toc array<long>, "
    "tags map<string,string>, seek array<long>"
)


def probe_media(files: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per file: its id, and what parse() finds (PROBE). A null file has zero frames and null elsewhere.

    duration_num / duration_den is the exact duration in seconds; seek has the byte offset of each audio
    frame. Bytes that belong to no frame or tag count as lost. Other columns are ignored.
    """

    def probe(chunks):
        import pyarrow as pa

        for chunk in chunks:
            for part in _slices(chunk):
                out = [parse(b) if b is not None else {"n_frames": 0} for b in part.column(1).to_pylist()]
                for row in out:
                    row["tags"] = list(row["tags"].items()) if "tags" in row else None
                yield pa.RecordBatch.from_arrays(
                    [part.column(0)] + [pa.array([r.get(f.name) for r in out], f.type) for f in schema], names=names
                )

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(PROBE))
    schema = [schema.field(i) for i in range(len(schema.names))]
    names = [id_col, *(f.name for f in schema)]
    id_type = dict(files.dtypes)[id_col]
    prepare(files.sparkSession)
    return files.select(id_col, media_col).mapInArrow(probe, f"`{id_col}` {id_type}, {PROBE}")


def media_digests(files: DataFrame) -> DataFrame:
    """Of texts_to_media(): the payload read back from the stored bytes, digests, and features, for each row."""
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string"
    )

    def digest(chunks):
        import hashlib
        import zlib

        import pyarrow as pa

        names = [f.split()[0] for f in schema.split(", ")]
        for chunk in chunks:
            rows = []
            for name, media in zip(chunk.column(0).to_pylist(), chunk.column(1)):
                media = media.as_py()
                found = parse(media)
                payload = payload_of(media, found["seek"])
                feature = (
                    f"frames={found['n_frames']};duration={found['duration_num']}/{found['duration_den']}s;"
                    f"hz={','.join(map(str, found['sample_rates']))};kbps={','.join(map(str, found['kbps']))};"
                    f"crc={found['crc_good']}+{found['crc_bad']};lost={found['lost_bytes']};"
                    f"table={found['table_kind']}:{found['table_frames']};seek={found['seek'][0]}..{found['seek'][-1]}"
                )
                rows.append(
                    (
                        name,
                        int(found["tags"]["payload_bytes"]),
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-16:]),
                        len(media),
                        hashlib.sha256(media).hexdigest(),
                        feature,
                    )
                )
            columns = list(zip(*rows)) or [[]] * len(names)
            kinds = [pa.string() if "string" in f else pa.int64() for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    prepare(files.sparkSession)
    return files.select("doc_id", "media").mapInArrow(digest, schema)
