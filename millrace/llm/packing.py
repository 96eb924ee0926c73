"""Packing of token streams into training sequences by order-preserving dynamic programming."""

from __future__ import annotations

import zlib
from collections import deque

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .memo_tokens import MEMO_PIECES, piece_memo, text_batches

PIECES = "doc_id long, start long, doc_tokens long, sequence_id long, offset long, ids array<int>"
DIGESTS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def window_cuts(points, penalties, size: int) -> list[int]:
    """The cheapest cuts of a token stream into windows of at most `size`, as positions, the end included.

    points: ascending positions where a cut is allowed, the stream's end last, no gap over `size`.
    A window costs its padding up to `size`, and each cut its penalty. With f(j) = penalty(j) + size -
    p(j) + min over windows that fit of f(i) + p(i), the minimum slides with j: a monotone queue keeps
    its candidates, so all cuts take linear time. Of equal costs the longest window wins.
    """
    back = [0] * len(points)
    queue = deque([(0, 0, -1)])  # (f(i) + p(i), p(i), i), values ascending
    for j, (p, penalty) in enumerate(zip(points, penalties)):
        low = p - size
        while queue[0][1] < low:
            queue.popleft()
        best, _, i = queue[0]
        back[j] = i
        value = best + penalty + size  # f(j) + p(j)
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, p, j))
    cuts, j = [], len(points) - 1
    while j >= 0:
        cuts.append(int(points[j]))
        j = back[j]
    return cuts[::-1]


def powers_of_two(n: int, size: int) -> list[int]:
    """n as lengths that need no padding: multiples of size, then falling powers of two."""
    lengths = [size] * (n // size)
    n %= size
    bit = size
    while n:
        if n & bit:
            lengths.append(bit)
            n ^= bit
        bit >>= 1
    return lengths


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    kind: str = "words",
    end_id: int = 1,
    size: int = 2048,
    sentence_ends: tuple[str, ...] = (".</w>", "!</w>", "?</w>", "!!</w>"),
    sentence_penalty: int = 96,
    hard_penalty: int = 288,
    grid: int = 32,
    block_tokens: int = 1 << 20,
    memo_pieces: int = MEMO_PIECES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of documents in sequences of at most `size` ids; the columns of PIECES.

    Each task takes its split in ascending id order and needs no shuffle. It packs blocks of about
    block_tokens ids. Cuts fall at document ends (free), sentence ends (sentence_penalty) or, within
    sentences of more than `grid` ids, every so many ids (hard_penalty), so that padding plus penalties is
    least. The last window of a block is cut into powers of two, which need no padding. Each id lies in
    exactly one piece, pieces fill a sequence from offset 0 without gaps, and sequence_id is the task's
    number times 2^32 plus a running number.

    Each Python worker remembers the ids of 1 to 2 times memo_pieces words; fewer cost time, not results.

    Null text counts as empty (the end id alone). Null ids come first; equal ids and repeated rows are
    documents each. Documents of any length pass: one longer than a block is a block of its own. Other
    columns are ignored. No rows: no rows.
    """

    def pack(chunks):
        import numpy as np
        import pyarrow as pa

        memo, end = piece_memo(tokenizer_path, kind, memo_pieces), int(end_id).to_bytes(4, "little")
        ends = [i for i in (memo.tokenizer.token_to_id(s) for s in sentence_ends) if i is not None]
        is_end = np.zeros(max([end_id, *ends, memo.tokenizer.get_vocab_size()]) + 1, dtype=bool)
        is_end[ends] = True
        sequence = TaskContext.get().partitionId() << 32

        def flush(block):
            nonlocal sequence
            ids = np.frombuffer(b"".join(b for _, b in block), dtype="<i4")
            edges = np.cumsum([len(b) // 4 for _, b in block])
            sentences = np.flatnonzero(is_end[ids]) + 1
            points = np.union1d(edges, sentences)
            gaps = np.diff(points, prepend=0)
            if (gaps > grid).any():
                extra = [np.arange(p - g + grid, p, grid) for p, g in zip(points[gaps > grid], gaps[gaps > grid])]
                points = np.union1d(points, np.concatenate(extra))
            cost = np.full(len(points), hard_penalty, dtype=np.int64)
            cost[np.searchsorted(points, sentences)] = sentence_penalty
            cost[np.searchsorted(points, edges)] = 0
            cuts = window_cuts(points.tolist(), cost.tolist(), size)
            last = cuts[-2] if len(cuts) > 1 else 0
            cuts = cuts[:-1] + (last + np.cumsum(powers_of_two(cuts[-1] - last, size))).tolist()
            # Pieces lie between neighbouring document ends and cuts.
            bounds = np.union1d(edges, cuts)
            begins = np.concatenate([[0], bounds[:-1]])
            of_doc = np.searchsorted(edges, begins, side="right")
            of_cut = np.searchsorted(cuts, begins, side="right")
            doc_from = np.concatenate([[0], edges[:-1]])[of_doc]
            cut_from = np.concatenate([[0], cuts[:-1]]).astype(np.int64)[of_cut]
            names = [i for i, _ in block]
            offsets = np.concatenate([[0], bounds]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[d] for d in of_doc], pa.int64()),
                    pa.array(begins - doc_from, pa.int64()),
                    pa.array(np.diff(edges, prepend=0)[of_doc], pa.int64()),
                    pa.array(sequence + of_cut, pa.int64()),
                    pa.array(begins - cut_from, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                ],
                names=["doc_id", "start", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            sequence += len(cuts)

        block, held = [], 0
        for part in text_batches(chunks):
            for (name, _), ids in zip(part, memo.encode([t for _, t in part])):
                if block and held + len(ids) // 4 + 1 > block_tokens:
                    yield from flush(block)
                    block, held = [], 0
                block.append((name, ids + end))
                held += len(ids) // 4 + 1
        if block:
            yield from flush(block)

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.sortWithinPartitions("doc_id").mapInArrow(pack, PIECES)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the length and crc32 of their ids (little-endian, 32 bits) in place of the ids."""

    def digest(chunks):
        import numpy as np
        import pyarrow as pa

        for chunk in chunks:
            ids = chunk.column("ids")
            ends = ids.offsets.to_numpy()
            values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            columns = [
                chunk.column("doc_id"),
                chunk.column("start"),
                pa.array((ends[1:] - ends[:-1]).astype("int64")),
                pa.array(crc, pa.int64()),
                *(chunk.column(c) for c in ("doc_tokens", "sequence_id", "offset")),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    prepare(pieces.sparkSession)
    return pieces.mapInArrow(digest, DIGESTS)
