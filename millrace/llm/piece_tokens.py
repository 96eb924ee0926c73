"""SentencePiece encoding and decoding as a max-plus scan over chunks.

A BPE segmentation is the one sequence of pieces of which every two neighbours, taken alone, are segmented
into just these two: a merge across a border would show in the pair already, and where none shows none
happens. So segmentations are paths through the lattice of pieces whose edges weigh 0 if the pair holds
and -inf if not; the segmentation of a text is its only path of weight 0, and of any prefix there is just
one too. A chunk of a text takes a border state (the piece that reaches over or up to its left end) to
border states at its right end: a matrix of weights 0 and -inf, stored as the entries that are 0. Their
max-plus product is associative, so the matrices of a document's chunks combine in any grouping; then each
chunk is backtraced alone between its two states. Between two characters that no piece has side by side
every path has a border, so stretches between such places are segmented once and remembered.
"""

from __future__ import annotations

import re
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, prepare
from .memo_tokens import Memo
from .token_files import list_array

BLANK = "▁"  # how pieces spell a blank
State = tuple[int, int]  # start and end of the piece at a border, in the document's characters


class PieceModel:
    """A BPE model file of the sentencepiece library: identity normalisation, dummy prefix, byte fallback."""

    def __init__(self, path: str, most: int = 600_000):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if (
            proto.trainer_spec.model_type != 2
            or spec.precompiled_charsmap
            or spec.remove_extra_whitespaces
            or not (spec.add_dummy_prefix and spec.escape_whitespaces and proto.trainer_spec.byte_fallback)
            or any(p.type in (4, 5) for p in proto.pieces)
        ):
            raise ValueError("a BPE model is needed, of identity normalisation, dummy prefix and byte fallback")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.spelled = [
            p.piece.replace(BLANK, " ").encode() if p.type == 1 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b""
            for p in proto.pieces
        ]
        self.longest = max(map(len, self.ids))
        self.prefixes = {p[:i] for p in self.ids for i in range(1, len(p) + 1)}
        self.inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        blanks = not any(BLANK in p.lstrip(BLANK) for p in self.ids)  # no piece has a blank after another sign
        lines = not any("\n" in p for p in self.ids)
        if not (blanks and lines):
            raise ValueError("stretches are cut before blanks and at line feeds")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.most = most
        self.young, self.old = Memo(), Memo()  # generations of stretches, as in memo_tokens
        for memo, other in ((self.young, self.old), (self.old, self.young)):
            memo.other, memo.sign, memo.make = other, self._before_sign, self._stretch
        self.signs = {sign: self.blob([sign]) for sign in ".,!?;:"}

    def merged(self, text: str) -> list[str]:
        """The segmentation by merges, best score first and leftmost of equals; for pairs of pieces."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best[0]):
                    best = score, i
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def holds(self, left: str, right: str) -> bool:
        """Whether the edge from left to right weighs 0. left "" is the start of a text."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= self.most:
                self.pairs.clear()
            whole = [left, right] if left else [right]
            known = left[-1:] + right[:1] not in self.inner if left else False
            known = known and self.merged(right) == [right] and self.merged(left) == [left] or self.merged(left + right) == whole
            self.pairs[(left, right)] = known
        return known

    def forward(self, text: str, at: int, last: str, stop: int) -> dict[int, int]:
        """End of each path of weight 0 from `at`, where the piece `last` ends, mapped to its last piece's start.

        Pieces start before `stop` and may end after it, as far as text goes.
        """
        back: dict[int, int] = {at: -1}
        ids, prefixes, pairs, n = self.ids, self.prefixes, self.pairs, len(text)
        for i in range(at, stop):
            start = back.get(i)
            if start is None:
                continue
            piece = last if start < 0 else text[start:i]
            for j in range(i + 1, min(n, i + self.longest) + 1):
                new = text[i:j]
                if j - i > 1:
                    if new not in prefixes:
                        break
                    if new not in ids:
                        continue
                if j not in back:
                    known = pairs.get((piece, new))
                    if known if known is not None else self.holds(piece, new):
                        back[j] = i
        return back

    def pieces_between(self, text: str, at: int, last: str, end: int) -> list[str]:
        """The path of weight 0 from `at` to `end`."""
        back, out = self.forward(text, at, last, end), []
        while end > at:
            out.append(text[back[end] : end])
            end = back[end]
        return out[::-1]

    def blob(self, pieces: list[str]) -> bytes:
        """Ids of pieces, as little-endian int32; characters without a piece by their bytes."""
        ids = array("i")
        for p in pieces:
            known = self.ids.get(p)
            if known is None:
                ids.extend(self.byte_ids[b] for b in p.encode())
            else:
                ids.append(known)
        return ids.tobytes()

    def _stretch(self, text: str) -> bytes:
        return self.blob(self.pieces_between(text, 0, "", len(text)))

    def _before_sign(self, text: str) -> bytes | None:
        """Ids of a stretch that ends in a sign which no piece has after the character before; such aren't kept."""
        if text[-1] not in ".,!?;:" or len(text) < 2 or text[-2:] in self.inner:
            return None
        return self.young[text[:-1]] + self.signs[text[-1]]

    def joined(self, stretches: list[str]) -> bytes:
        """Ids of stretches that no path crosses on either side."""
        if len(self.young) >= self.most:
            self.young, self.old = self.old, self.young
            self.young.clear()
        return b"".join(map(self.young.__getitem__, stretches))


# Stretches begin at a run of blanks after another sign, and lie on either side of line feeds.
_STRETCHES = re.compile(f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+")
_open: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _open:
        _open[path] = PieceModel(path)
    return _open[path]


def escaped(text: str) -> str:
    """The characters that are segmented: blanks spelled as in pieces, one more in front; nothing for nothing."""
    return BLANK + text.replace(" ", BLANK) if text else ""


def _borders(text: str, low: int, high: int) -> list[int]:
    """The first and the last place in [low, high] where every path has a border."""
    spots = [m.start() for m in _STRETCHES.finditer(text, max(0, low - 1), high) if m.start() >= low]
    spots = [s for s in spots if s and (text[s] in f"{BLANK}\n" and text[s - 1] != BLANK or text[s - 1] == "\n")]
    return [spots[0], spots[-1]] if spots else []


def entries(model: PieceModel, text: str, low: int) -> list[State]:
    """All border states at `low`: pieces, and single characters before it, that start before and end at or after it."""
    out = []
    for i in range(max(0, low - model.longest), low):
        for j in range(low, min(len(text), i + model.longest) + 1):
            if text[i:j] in model.ids or j - i == 1:
                out.append((i, j))
    return out


def transfer(model: PieceModel, text: str, low: int, high: int) -> dict[State, list[State]]:
    """The matrix of the chunk [low, high) of text: for each entry state the exit states of weight 0.

    text has at least the longest piece's length around the chunk, or is the document's. At the start of
    a document the one entry is (0, 0); at its end an exit ends there.
    """
    starts = entries(model, text, low) if low else [(0, 0)]
    whole = high == len(text)

    def exits(back: dict[int, int]) -> list[State]:
        return [(i, j) for j, i in back.items() if i >= 0 and j >= high and i < high and (j == high or not whole)]

    spots = _borders(text, low, high)
    spots = [s for s in spots if s < high]
    if not spots:
        return {s: got for s in starts if (got := exits(model.forward(text, s[1], text[slice(*s)], high)))}
    first, last = spots
    right = exits(model.forward(text, last, "", high))
    return {
        s: right
        for s in starts
        if s[1] == first or s[1] < first and first in model.forward(text, s[1], text[slice(*s)], first)
    }


def product(a: dict[State, list[State]], b: dict[State, list[State]]) -> dict[State, list[State]]:
    """The max-plus product of two matrices of neighbouring chunks."""
    out = {x: sorted({z for y in ys for z in b.get(y, ())}) for x, ys in a.items()}
    return {x: zs for x, zs in out.items() if zs}


def border_states(matrices: list[dict[State, list[State]]]) -> list[State]:
    """The states of the one path of weight 0 through all chunks, the start included."""
    suffixes = [matrices[-1]]
    for m in matrices[-2::-1]:
        suffixes.append(product(m, suffixes[-1]))
    suffixes.reverse()
    states = [(0, 0)]
    for k, m in enumerate(matrices):
        after = suffixes[k + 1] if k + 1 < len(matrices) else None
        (one,) = [y for y in m[states[-1]] if after is None or y in after]
        states.append(one)
    return states


def backtrace(model: PieceModel, text: str, low: int, high: int, entry: State, exit: State) -> bytes:
    """Ids of the pieces that start in the chunk, between two border states."""
    spots = [s for s in _borders(text, low, high) if s < high]
    at, end, last = entry[1], exit[1], text[slice(*entry)]
    if not spots or not at <= spots[0] <= end:
        return model.blob(model.pieces_between(text, at, last, end))
    first, final = spots
    left = model.blob(model.pieces_between(text, at, last, first))
    middle = model.joined(_STRETCHES.findall(text, first, final))
    return left + middle + model.blob(model.pieces_between(text, final, "", end))


def cuts_of(model: PieceModel, n: int, chunk: int) -> list[int]:
    """Chunk ends of n characters, the start included. No chunk is so short that a piece could cover it."""
    cuts = [*range(0, n, max(chunk, 2 * model.longest)), n]
    if len(cuts) > 2 and n - cuts[-2] < 2 * model.longest:
        del cuts[-2]
    return cuts


def encode_text(model: PieceModel, text: str, chunk: int = 1 << 14) -> bytes:
    """Ids of one text on one machine, by the same chunks, matrices and backtraces."""
    doc = escaped(text)
    if len(doc) <= chunk:
        return model.joined(_STRETCHES.findall(doc))
    cuts = cuts_of(model, len(doc), chunk)
    states = border_states([transfer(model, doc, a, b) for a, b in zip(cuts, cuts[1:])])
    return b"".join(backtrace(model, doc, *z) for z in zip(cuts, cuts[1:], states, states[1:]))


CHUNKS = "doc_id long, copy long, chunk int, low int, high int, shift int, text string"
STATES = "doc_id long, copy long, chunk int, entry array<int>, exit array<int>"


def encode_documents(
    docs: DataFrame, model_path: str, giant: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and ids (array of int) of each whole text.

    Texts of up to `giant` characters are one chunk each and stay where they are. Longer ones are written to
    the shared folder and cut into chunks of that many characters, which are spread over tasks; only their matrices, a few states each,
    meet by document, and the chunks are backtraced where they are made again. Then a giant document's ids
    come together in one row, as its text did.

    Null and empty texts have no ids. Rows stay one to one, repeated ones too; other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    names = ["doc_id", "ids"]

    def encode(chunks):
        import pyarrow as pa

        model = piece_model(model_path)
        for chunk in chunks:
            step = max(1, int(chunk.num_rows * (1 << 20) / max(1, chunk.nbytes)))
            for i in range(0, chunk.num_rows, step):
                part = chunk.slice(i, step)
                blobs = [encode_text(model, t, giant + 1) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), list_array(blobs)], names=names)

    small = rows.where(F.length("text") <= giant).mapInArrow(encode, "doc_id long, ids array<int>")

    def cut(chunks):
        import pyarrow as pa

        model = piece_model(model_path)
        around = model.longest + 1
        for chunk in chunks:
            for name, copy, text in zip(*(chunk.column(i) for i in range(3))):
                doc = escaped(text.as_py())
                cuts = cuts_of(model, len(doc), giant)
                for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
                    shift = max(0, low - around)
                    row = [[name.as_py()], [copy.as_py()], [k], [low], [high], [shift], [doc[shift : high + around]]]
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, t) for v, t in zip(row, kinds)], names=[f.split()[0] for f in CHUNKS.split(", ")]
                    )

    # The content tells rows with the same id apart; equal rows have equal results.
    ws = Workspace(docs.sparkSession)
    giants = ws.table(rows.where(F.length("text") > giant).select("doc_id", F.xxhash64("text").alias("copy"), "text"), "giants")
    pieces = giants.dropDuplicates(["doc_id", "copy"]).mapInArrow(cut, CHUNKS)
    spread = ws.table(pieces.repartition("doc_id", "copy", "chunk"), "chunks")

    def matrices(chunks):
        import json

        import pyarrow as pa

        model = piece_model(model_path)
        for chunk in chunks:
            out = []
            for low, high, shift, text in zip(*(chunk.column(c).to_pylist() for c in ("low", "high", "shift", "text"))):
                # A text's own start and end count only where they are the document's.
                found = transfer(model, text, low - shift, high - shift)
                out.append(json.dumps([[[a + shift, b + shift], [[c + shift, d + shift] for c, d in ys]] for (a, b), ys in found.items()]))
            columns = [chunk.column("doc_id"), chunk.column("copy"), chunk.column("chunk"), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy", "chunk", "matrix"])

    gathered = (
        spread.mapInArrow(matrices, "doc_id long, copy long, chunk int, matrix string")
        .groupBy("doc_id", "copy")
        .agg(F.sort_array(F.collect_list(F.struct("chunk", "matrix"))).alias("parts"))
    )

    def scan(chunks):
        import json

        import pyarrow as pa

        for chunk in chunks:
            for name, copy, parts in zip(*(chunk.column(i).to_pylist() for i in range(3))):
                read = [{tuple(x): [tuple(y) for y in ys] for x, ys in json.loads(p["matrix"])} for p in parts]
                states = [list(s) for s in border_states(read)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * n, pa.int64()),
                        pa.array([copy] * n, pa.int64()),
                        pa.array(range(n), pa.int32()),
                        pa.array(states[:-1], pa.list_(pa.int32())),
                        pa.array(states[1:], pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "copy", "chunk", "entry", "exit"],
                )

    states = gathered.mapInArrow(scan, STATES)

    def trace(chunks):
        import pyarrow as pa

        model = piece_model(model_path)
        for chunk in chunks:
            fields = [chunk.column(c).to_pylist() for c in ("low", "high", "shift", "text", "entry", "exit")]
            blobs = [
                backtrace(model, text, low - shift, high - shift, *((s[0] - shift, s[1] - shift) for s in (a, b)))
                for low, high, shift, text, a, b in zip(*fields)
            ]
            columns = [chunk.column("doc_id"), chunk.column("copy"), chunk.column("chunk"), list_array(blobs)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy", "chunk", "ids"])

    traced = (
        spread.join(states.select(F.col("doc_id").alias("_d"), F.col("copy").alias("_c"), F.col("chunk").alias("_k"), "entry", "exit"),
                    F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("copy") == F.col("_c")) & (F.col("chunk") == F.col("_k")))
        .select("doc_id", "copy", "chunk", "low", "high", "shift", "text", "entry", "exit")
        .mapInArrow(trace, "doc_id long, copy long, chunk int, ids array<int>")
        .groupBy("doc_id", "copy")
        .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "ids"))), lambda p: p["ids"])).alias("ids"))
    )
    again = giants.select(F.col("doc_id").alias("_d"), F.col("copy").alias("_c"))
    large = again.join(traced, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("copy") == F.col("_c"))).select("doc_id", "ids")
    return small.unionAll(large)


def decode_bytes(model: PieceModel, ids) -> bytes:
    """The UTF-8 text of ids: pieces and bytes joined, without the blank in front."""
    out = b"".join(map(model.spelled.__getitem__, ids))
    return out[1:] if out[:1] == b" " else out


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each list of ids; broken UTF-8 becomes U+FFFD, null ids empty text."""

    def decode(chunks):
        import pyarrow as pa

        model = piece_model(model_path)
        for chunk in chunks:
            step = max(1, int(chunk.num_rows * (1 << 20) / max(1, chunk.nbytes)))
            for i in range(0, chunk.num_rows, step):
                part = chunk.slice(i, step)
                texts = [decode_bytes(model, ids or ()).decode("utf-8", "replace") for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    prepare(encoded.sparkSession)
    return encoded.select(F.col(id_col).cast("long"), ids_col).mapInArrow(decode, "doc_id long, text string")


def round_trips(encoded: DataFrame, model_path: str) -> DataFrame:
    """Of encode_documents(): doc_id, n_tokens, ids_crc32 and the SHA-256 of the text that the ids decode to."""

    def digest(chunks):
        import hashlib
        import zlib

        import numpy as np
        import pyarrow as pa

        model = piece_model(model_path)
        for chunk in chunks:
            step = max(1, int(chunk.num_rows * (4 << 20) / max(1, chunk.nbytes)))
            for i in range(0, chunk.num_rows, step):
                part = chunk.slice(i, step)
                ids = part.column(1)
                ends, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
                lists = [np.ascontiguousarray(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                shas = [hashlib.sha256(decode_bytes(model, x.tolist())).hexdigest() for x in lists]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in lists], pa.int64()), pa.array([zlib.crc32(x) for x in lists], pa.int64()),
                     pa.array(shas, pa.string())],
                    names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256"],
                )

    prepare(encoded.sparkSession)
    return encoded.mapInArrow(digest, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string")
