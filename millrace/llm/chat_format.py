"""Chat formatting: layouts known by the fingerprint of their fields, one template, a loss mask, and the way back."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, quoted

# Layouts of records: which field paths they have, and how turns come out of them. `[]` is an array's element.
# "turn" layouts hold one turn a row; "list" layouts one array of turns, perhaps a system text beside it, and texts
# whole or in an array of parts; "fields" layouts one field a turn, where parts joined by + form one turn and absent or
# empty parts are left out.
LAYOUTS = [
    {"kind": "turn", "turn": "turn", "role": "role", "text": "text"},
    {"kind": "list", "path": "messages", "role": "role", "text": "content"},
    {"kind": "list", "path": "messages", "role": "role", "text": "content", "system": "system"},
    {"kind": "list", "path": "messages", "role": "role", "text": "content", "part": "text"},
    {"kind": "list", "path": "messages", "role": "role", "text": "content", "part": "text", "system": "system"},
    {"kind": "list", "path": "conversations", "role": "from", "text": "value"},
    {"kind": "list", "path": "conversations", "role": "from", "text": "value", "system": "system"},
    {"kind": "fields", "turns": [("user", "prompt"), ("assistant", "completion")]},
    {"kind": "fields", "turns": [("user", "prompt"), ("assistant", "response")]},
    {"kind": "fields", "turns": [("user", "question"), ("assistant", "answer")]},
    {"kind": "fields", "turns": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    {"kind": "fields", "turns": [("user", "instruction"), ("assistant", "output")]},
    {"kind": "fields", "turns": [("user", "instruction"), ("assistant", "response")]},
    {"kind": "fields", "turns": [("user", "instruction+input"), ("assistant", "output")]},
    {"kind": "fields", "turns": [("system", "system"), ("user", "instruction+input"), ("assistant", "output")]},
]
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def layout_paths(layout: dict) -> frozenset[str]:
    if layout["kind"] == "turn":
        return frozenset(layout[k] for k in ("turn", "role", "text"))
    if layout["kind"] == "list":
        text = f"{layout['path']}[].{layout['text']}" + (f"[].{layout['part']}" if "part" in layout else "")
        return frozenset([f"{layout['path']}[].{layout['role']}", text, *([layout["system"]] if "system" in layout else [])])
    return frozenset(part for _, parts in layout["turns"] for part in parts.split("+"))


VOCABULARY = frozenset().union(*map(layout_paths, LAYOUTS))


def fingerprint(paths, known=VOCABULARY) -> str:
    """A hash of those field paths that are known; other fields don't enter."""
    return hashlib.blake2b("\n".join(sorted(known.intersection(paths))).encode(), digest_size=8).hexdigest()


# Layouts by kind, most paths first, with the paths that each looks at and their fingerprint.
RANKED = sorted(
    ((layout_paths(x), fingerprint(layout_paths(x)), x) for x in LAYOUTS),
    key=lambda x: (["turn", "list", "fields"].index(x[2]["kind"]), -len(x[0])),
)
_known: dict[str, dict | None] = {}


def layout_of(paths) -> dict | None:
    """The layout that a schema's fingerprint selects: the first in rank whose own paths are all there.

    Fields of other layouts beside them don't matter: seen through a layout's paths the schema has that
    layout's fingerprint. A whole schema's fingerprint is looked up once.
    """
    paths = frozenset(paths)
    whole = fingerprint(paths)
    if whole not in _known:
        _known[whole] = next((x for own, mark, x in RANKED if fingerprint(paths, own) == mark), None)
    return _known[whole]


def schema_paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    if isinstance(kind, T.StructType):
        for field in kind.fields:
            yield from schema_paths(field.dataType, f"{at}.{field.name}" if at else field.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, f"{at}[]")
    else:
        yield at


def value_paths(value, at: str = "") -> Iterator[str]:
    if isinstance(value, dict):
        for name, inner in value.items():
            yield from value_paths(inner, f"{at}.{name}" if at else name)
    elif isinstance(value, list):
        for inner in value:
            yield from value_paths(inner, f"{at}[]")
    else:
        yield at


TURNS = "conv_id long, turn long, role string, text string"


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Turns (conv_id, turn, role, text) of a table whose layout its schema's fingerprint selects.

    Null texts count as empty in layouts with roles, and an empty or null system text beside a list makes no
    turn; in layouts of fields, empty and null fields make no turn. Other columns don't matter, whatever
    their names: of several layouts that fit, one of turns goes before lists and lists before fields, and
    the one with more fields first. Rows with a null list or without turns give none. Null ids stay.
    Repeated rows are turns each. No rows: no rows. An unknown layout is a ValueError.
    """
    layout = layout_of(schema_paths(df.schema))
    if layout is None:
        raise ValueError(f"no layout has these fields: {sorted(VOCABULARY.intersection(schema_paths(df.schema)))}")
    if layout["kind"] == "turn":
        names = [id_col, *(layout[k] for k in ("turn", "role", "text"))]
        rows = df.select(*(quoted(n).alias(a) for n, a in zip(names, ("conv_id", "turn", "role", "text"))))
    elif layout["kind"] == "list":

        def message(m: Column) -> Column:
            text = m[layout["text"]]
            if "part" in layout:
                text = F.array_join(F.transform(text, lambda part: part[layout["part"]]), "\n")
            return F.struct(_plain_role(m[layout["role"]]).cast("string").alias("role"), text.cast("string").alias("text"))

        turns = F.transform(quoted(layout["path"]), message)
        if "system" in layout:
            first = F.array(F.struct(F.lit("system").alias("role"), quoted(layout["system"]).cast("string").alias("text")))
            turns = F.concat(F.filter(first, lambda t: t["text"] != ""), turns)
        rows = df.select(quoted(id_col).alias("conv_id"), F.posexplode(turns).alias("turn", "_m")).select("conv_id", "turn", "_m.role", "_m.text")
    else:
        turns = [
            F.struct(F.lit(role).alias("role"), F.array_join(F.array_compact(F.array(*map(_filled, parts.split("+")))), "\n").alias("text"))
            for role, parts in layout["turns"]
        ]
        filled = F.filter(F.array(*turns), lambda t: t["text"] != "")
        rows = df.select(quoted(id_col).alias("conv_id"), F.posexplode(filled).alias("turn", "_m")).select(
            "conv_id", "turn", "_m.role", "_m.text"
        )
    return rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _filled(name: str) -> Column:
    return F.when(quoted(name) != "", quoted(name))


def _plain_role(role: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.coalesce(named[F.lower(role)], F.lower(role))


def record_turns(record) -> list[tuple[str, str]] | None:
    """(role, text) of one parsed JSON record by its own fingerprint; None where no layout fits."""
    layout = layout_of(value_paths(record)) if isinstance(record, dict) else None
    if layout is None or layout["kind"] == "turn":
        return None
    if layout["kind"] == "list":

        def text_of(value) -> str:
            if isinstance(value, list):  # parts, of which those without text (images and the like) are left out
                return "\n".join(p if isinstance(p, str) else str(p.get(layout.get("part", "text")) or "") for p in value if isinstance(p, (str, dict)))
            return str(value or "")

        found = [("system", record.get(layout["system"]))] if record.get(layout.get("system")) else []
        found += [(m.get(layout["role"]), text_of(m.get(layout["text"]))) for m in record[layout["path"]] if isinstance(m, dict)]
        return [(ROLE_NAMES.get(r, r), t) for r, t in ((str(r or "").lower(), str(t or "")) for r, t in found)]
    joined = [(role, "\n".join(str(record[p]) for p in parts.split("+") if record.get(p))) for role, parts in layout["turns"]]
    return [(r, t) for r, t in joined if t]


def json_turns(df: DataFrame, json_col: str, id_col: str = "conv_id") -> DataFrame:
    """Turns, and layout (its fingerprint), of JSON records that may each have another layout.

    A record of no known layout or without turns, a broken or a null one gives one row with null turn, role
    and text. Other columns are ignored; null ids and repeated rows stay. No rows: no rows.
    """

    def read(chunks):
        import pyarrow as pa

        for chunk in chunks:
            rows = []
            for conv, raw in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist()):
                try:
                    record = json.loads(raw or "null")
                except ValueError:
                    record = None
                chosen = layout_of(value_paths(record)) if isinstance(record, dict) else None
                mark = fingerprint(layout_paths(chosen)) if chosen else None
                turns = record_turns(record)
                rows += [(conv, i, r, t, mark) for i, (r, t) in enumerate(turns)] if turns else [(conv, None, None, None, mark)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["conv_id", "turn", "role", "text", "layout"]
            )

    prepare(df.sparkSession)
    return df.select(quoted(id_col).cast("long"), quoted(json_col)).mapInArrow(read, f"{TURNS}, layout string")


# The template. Control strings start with < or [; inside texts a backslash after that sign breaks them, and one more
# goes where backslashes stand there already, so that the way back takes one away.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[TEXT]")
_RESTS = "|".join(sorted((re.escape(c[1:]) for c in CONTROL), key=len, reverse=True))
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_RESTS})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_RESTS})")
_FRAMES = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def spell_turn(role: str, text: str) -> tuple[str, str, str]:
    """What stands before, within and after the frame of a turn."""
    before, after = _FRAMES.get(role, (f"[ROLE]{escape(role)}[TEXT]", "[/ROLE]"))
    return before, escape(text), after


_OPEN = re.compile(r"\[INST\]|<s>|<<SYS>>|\[ROLE\]")
_CLOSE = {"[INST]": ("user", "[/INST]"), "<s>": ("assistant", "</s>"), "<<SYS>>": ("system", "<</SYS>>"), "[ROLE]": (None, "[/ROLE]")}


def read_turns(formatted: str) -> Iterator[tuple[str, int, int]]:
    """(role, start, end) of each turn's escaped text in a formatted piece of whole turns."""
    at = 0
    while at < len(formatted):
        found = _OPEN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn starts at {at}")
        role, close = _CLOSE[found[0]]
        start = found.end()
        if role is None:
            middle = formatted.index("[TEXT]", start)
            role, start = unescape(formatted[start:middle]), middle + 6
        end = formatted.index(close, start)
        yield role, start, end
        at = end + len(close)


FORMATTED = "conv_id long, piece long, formatted string, loss array<struct<start:long,end:long>>"


def format_chats(turns: DataFrame, piece_chars: int = 1 << 22) -> DataFrame:
    """Formatted conversations: conv_id, piece, formatted, loss.

    A conversation is its turns in order (equal numbers by role, then text; null numbers first), each in the
    frame of its role. Tasks take ranges of turns in that order, so a conversation with a third of all rows,
    or of equal rows, is formatted by many. A conversation is one piece unless a range ends in it or it is
    longer than piece_chars: then pieces of whole turns, in order of their number, which has gaps. loss has
    the spans of assistant texts, as code points of the piece, without frames. Null conv_id is one
    conversation. Repeated rows are turns each. Other columns are ignored. No rows: no rows.
    """

    def spell(chunks):
        import pyarrow as pa

        first = TaskContext.get().partitionId() << 32  # pieces of a later range have higher numbers
        conv, parts, spans, chars, piece, any_ = None, [], [], 0, first, False
        out: list[tuple] = []

        def batch():
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.string(), spans_type)
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=["conv_id", "piece", "formatted", "loss"]
            )
            out.clear()
            return made

        held = 0
        for chunk in chunks:
            for c, role, text in zip(chunk.column(0).to_pylist(), chunk.column(1), chunk.column(2)):
                if any_ and (c != conv or chars >= piece_chars):
                    out.append((conv, piece, "".join(parts), spans))
                    held += chars
                    piece = piece + 1 if c == conv else first
                    parts, spans, chars = [], [], 0
                    if held >= piece_chars:
                        yield batch()
                        held = 0
                conv, any_ = c, True
                before, inner, after = spell_turn(role.as_py(), text.as_py())
                parts += (before, inner, after)
                start = chars + len(before)
                chars = start + len(inner) + len(after)
                if role.as_py() == "assistant":
                    spans.append({"start": start, "end": start + len(inner)})
        if any_:
            out.append((conv, piece, "".join(parts), spans))
            yield batch()

    prepare(turns.sparkSession)
    order = ["conv_id", "turn", "role", "text", "_n"]
    ordered = turns.select(*order[:-1]).withColumn("_n", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("conv_id", "role", "text").mapInArrow(spell, FORMATTED)


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def chat_digests(formatted: DataFrame, digest: Callable = hashlib.sha256) -> DataFrame:
    """Of format_chats(): counts and digests of what is read back, one row per conversation.

    Formatted pieces meet by conversation and stream in order, as a digest of all turns is one sequence; a
    task holds one Arrow batch of pieces.
    """

    def read(chunks):
        import pyarrow as pa

        conv, state, rows, any_ = None, None, [], False

        def close():
            turns, words, count, loss, chars, loss_chars = state
            rows.append((conv, count, words.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def batch():
            kinds = [pa.string() if "string" in f else pa.int64() for f in DIGESTS.split(", ")]
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in DIGESTS.split(", ")]
            )
            rows.clear()
            return made

        for chunk in chunks:
            for c, text, loss in zip(*(chunk.column(i) for i in (0, 2, 3))):
                c, text = c.as_py(), text.as_py()
                if not any_ or c != conv:
                    if state:
                        close()
                    conv, state, any_ = c, [None, digest(), 0, digest(), 0, 0], True
                for role, start, end in read_turns(text):
                    state[1].update(f"{role}\n{unescape(text[start:end])}\n".encode())
                    state[2] += 1
                for span in loss.as_py():
                    plain = unescape(text[span["start"] : span["end"]])
                    state[3].update(plain.encode())
                    state[5] += len(plain)
                state[4] += len(text)
            if len(rows) >= 1000:
                yield batch()
        if state:
            close()
        if rows:
            yield batch()

    prepare(formatted.sparkSession)
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return ordered.select("conv_id", "piece", "formatted", "loss").mapInArrow(read, DIGESTS)
