"""Exact token ids of whole texts through the tokenizers library, with a memo of pieces.

A text is cut only where the tokenizer itself always cuts, so the ids of the pieces, joined, are those
of the whole text; tests compare both. Each Python worker keeps one bounded memo per tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array
from unicodedata import is_normalized

_BLANKS = re.compile(rb"[ \t\n\r]+")
# Before a blank or line feed that a visible ASCII sign or a letter's first byte follows (not C2, E1 to E3, which begin
# white space too). A line feed is written " \0" here, so that one literal blank starts every place.
_BEFORE_WORD = re.compile(rb" (?=\0?[!-~\xc3-\xe0\xe4-\xf4])")
# How byte-level models spell bytes: those of visible Latin-1 signs stand for themselves, the rest follow from U+0100 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
MEMO_PIECES = 800_000  # a generation; some 170 bytes a piece in each Python worker
_open: dict[str, "PieceMemo"] = {}


class Memo(dict):
    """Ids by piece; what is asked for and missing is looked up in the other generation or made."""

    def __missing__(self, piece: bytes) -> bytes:
        known = self.sign(piece)
        if known is None:
            known = self.other.get(piece)
            if known is None:
                known = self.make(piece)
            self[piece] = known
        return known


class PieceMemo:
    """Little-endian int32 ids of UTF-8 texts. kind: "space" keeps white space with the word after it; "words" drops it.

    Pieces are remembered in two generations of about `most` each; pieces met again move to the young one.
    """

    def __init__(self, path: str, kind: str, most: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.most = Tokenizer.from_file(path), kind, most
        self.model = self.tokenizer.model
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] + [b"\0", b"\1"]
        self.tails = {sign: self.encode_whole(sign) for sign in (b".", b",", b"!", b"?", b";", b":")}
        self.young, self.old = Memo(), Memo()
        for memo, other in ((self.young, self.old), (self.old, self.young)):
            memo.other, memo.sign = other, self._before_sign
            memo.make = self._blank_piece if kind == "space" else self._word_piece

    def encode_whole(self, text: bytes) -> bytes:
        return array("i", self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids).tobytes()

    def _before_sign(self, piece: bytes) -> bytes | None:
        """Ids of letters and one sign, which a letter never joins; such pairs aren't kept."""
        tail = self.tails.get(piece[-1:])
        if tail is None:
            return None
        word = piece[:-1]
        if word.isalpha() or not word.isascii() and (text := word.decode()).isalpha() and text.lower().isalpha():
            return self.young[word] + tail
        return None

    def _letters(self, lead: str, word: str) -> bytes:
        """Ids of letters, which the tokenizer never splits, by its model alone."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTE_SIGNS)
        return array("i", [t.id for t in self.model.tokenize(lead + word)]).tobytes()

    def _blank_piece(self, piece: bytes) -> bytes:
        word = piece.decode()
        if word.isalpha():
            return self._letters("\u0120", word)  # which stands for a blank
        if piece[:1] == b"\1":  # the first piece of a text; all others began with a blank or line feed
            spelled = piece[1:]
        elif piece[:1] == b"\0":
            spelled = b"\n" + piece[1:]
        else:
            spelled = b" " + piece
        return self.encode_whole(spelled.replace(b" \0", b"\n"))

    def _word_piece(self, piece: bytes) -> bytes:
        word = piece.decode()
        low = word.lower()
        if low.isalpha() and (low.isascii() or "\u03a3" not in word and is_normalized("NFC", word)):  # U+03A3 lowers by context
            return self._letters("", low)
        return self.encode_whole(piece)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.young) >= self.most:
            self.young, self.old = self.old, self.young
            self.young.clear()
        out, lookup, special = [], self.young.__getitem__, self.special
        for text in texts:
            if any(s in text for s in special):
                out.append(self.encode_whole(text))
            elif self.kind == "space":
                out.append(b"".join(map(lookup, _BEFORE_WORD.split(b"\1" + text.replace(b"\n", b" \0")))))
            else:
                out.append(b"".join(map(lookup, _BLANKS.split(text))))
        return out


def piece_memo(path: str, kind: str, most: int) -> PieceMemo:
    if path not in _open or _open[path].most != most:
        _open[path] = PieceMemo(path, kind, most)
    return _open[path]


def text_batches(chunks, most: int = 1 << 20):
    """Lists of (id, UTF-8 text) of about `most` bytes out of Arrow batches with these two columns."""
    import pyarrow as pa

    for chunk in chunks:
        step = max(1, int(chunk.num_rows * most / max(1, chunk.nbytes)))
        for i in range(0, chunk.num_rows, step):
            part = chunk.slice(i, step)
            yield list(zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()))
