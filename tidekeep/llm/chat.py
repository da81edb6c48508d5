"""Chat formatting by token-level assembly.

Each text is encoded on its own; the marks of the template are reserved ids beyond the
vocabulary, spliced between the encoded segments, so no text can produce one. In the rendered
string the marks are control strings; where one occurs in a text it is broken by a backslash after
its first character, and every backslash of the text is doubled, which can be undone.

    <s> <<SYS>>text<</SYS>> [INST]text[/INST] text</s> [ROLE]name[TEXT]text[/ROLE]

without the blanks: system, user, assistant, any other role. The loss mask is the prefix sum of +1
at the first and -1 after the last token of each assistant text, so marks carry no loss.

Encoding needs no shuffle. The rows of a conversation meet once, sorted by turn, and stream
through the assembler, which emits pieces of at most ``PIECE_IDS`` ids or one turn, so a
conversation of any number of turns needs the memory of one piece.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Decoder, encoder
from .frames import batch, binary_column, map_batches

CONTROL = ["<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]",
           "[/ROLE]"]
FIRST_RESERVED = 50_300
BEGIN, END, SYSTEM, SYSTEM_END, USER, USER_END, ROLE, TEXT, ROLE_END = range(
    FIRST_RESERVED, FIRST_RESERVED + len(CONTROL))
OPENS = {"system": SYSTEM, "user": USER}
CLOSES = {"system": SYSTEM_END, "user": USER_END, "assistant": END}
PIECE_IDS = 1 << 16

_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_BROKEN = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _BROKEN.sub(r"\1", text)


def encode_turns(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, turn, role, tie, name_ids, ids): each escaped text as 32-bit ids, and the role
    name as ids where the template has no mark for it."""
    slim = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.xxhash64("text").alias("tie"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches):
        coder = encoder(tokenizer, specials=False)

        def ids_of(values):
            rows: list[list[int]] = [[] for _ in values]
            for k, chunk in coder.streams(map(escape, values)):
                rows[k] += chunk
            return binary_column([np.array(r, np.int32).tobytes() for r in rows])

        for b in batches:
            roles = b.column("role").to_pylist()
            names = [r if r not in CLOSES else "" for r in roles]
            yield batch(["conv_id", "turn", "role", "tie", "name_ids", "ids"], [
                b.column("conv_id"), b.column("turn"), b.column("role"), b.column("tie"),
                ids_of(names), ids_of(b.column("text").to_pylist())])

    return map_batches(slim, run, "conv_id long, turn long, role string, tie long, "
                                  "name_ids binary, ids binary")


def assemble(turns: DataFrame) -> DataFrame:
    """(conv_id, piece, ids, mask): formatted conversations as token pieces, in order.

    Pieces of a conversation follow each other in one partition; ``mask`` has one byte per id.
    """
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie")

    def run(batches):
        name, piece, started = None, 0, False
        held: list[np.ndarray] = []
        delta: list[tuple[int, int]] = []
        size = 0

        def out():
            ids = np.concatenate(held)
            steps = np.zeros(len(ids) + 1, np.int64)
            for a, z in delta:
                steps[a] += 1
                steps[z] -= 1
            mask = np.cumsum(steps[:-1]).astype(np.uint8)
            return (name, piece, ids.astype("<i4").tobytes(), mask.tobytes())

        for b in batches:
            rows = []
            for conv, role, label, raw in zip(
                    b.column("conv_id").to_pylist(), b.column("role").to_pylist(),
                    b.column("name_ids").to_pylist(), b.column("ids").to_pylist()):
                if not started or conv != name:
                    if started:
                        rows.append(out())
                    name, piece, started = conv, 0, True
                    held, delta, size = [np.array([BEGIN], np.int32)], [], 1
                elif size > PIECE_IDS:
                    rows.append(out())
                    piece, held, delta, size = piece + 1, [], [], 0
                content = np.frombuffer(raw, np.int32)
                if role in CLOSES:
                    before = [OPENS[role]] if role in OPENS else []
                    close = CLOSES[role]
                else:
                    before = [ROLE, *np.frombuffer(label, np.int32).tolist(), TEXT]
                    close = ROLE_END
                if role == "assistant":
                    delta.append((size, size + len(content)))
                held += [np.array(before, np.int32), content, np.array([close], np.int32)]
                size += len(before) + len(content) + 1
            yield _pieces(rows)
        if started:
            yield _pieces([out()])

    return map_batches(ordered, run, "conv_id long, piece long, ids binary, mask binary")


def _pieces(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return batch(["conv_id", "piece", "ids", "mask"],
                 [pa.array(list(c), k) for c, k in zip(columns, kinds)])


class Reader:
    """Takes a formatted conversation apart again, from its ids and mask alone."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self.role, self.name = "assistant", ""

    def _text(self, ids: list[int]) -> str:
        machine = Decoder(self.bytes_of)
        return machine.push(ids) + machine.flush()

    def piece(self, ids: np.ndarray, mask: np.ndarray) -> None:
        marks = np.flatnonzero(ids >= FIRST_RESERVED).tolist()
        start = 0
        for at in marks:
            mark = int(ids[at])
            raw = self._text(ids[start:at].tolist())
            text = unescape(raw)
            self.chars += len(raw) + len(CONTROL[mark - FIRST_RESERVED])
            if mark in (SYSTEM, USER, ROLE):
                self.role = {SYSTEM: "system", USER: "user", ROLE: None}[mark]
            elif mark == TEXT:
                self.role = text
            elif mark != BEGIN:
                self.turns += 1
                self.turn_hash.update(f"{self.role}\n{text}\n".encode())
                self.role = "assistant"
            start = at + 1
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0]))))
        for a, z in zip(edges[::2].tolist(), edges[1::2].tolist()):
            text = unescape(self._text(ids[a:z].tolist()))
            self.loss_chars += len(text)
            self.loss_hash.update(text.encode())

    def row(self, name):
        return (name, self.turns, self.turn_hash.hexdigest(), self.loss_chars,
                self.loss_hash.hexdigest(), self.chars)


_DIGESTS = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(),
            "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}


def read_back(pieces: DataFrame, tokenizer: str) -> DataFrame:
    """One row of counts and digests per conversation, from the assembled pieces."""

    def rows(batches) -> Iterator[tuple]:
        coder = encoder(tokenizer, specials=False)
        reader, name = None, None
        for b in batches:
            for conv, piece, ids, mask in zip(*(c.to_pylist() for c in b.columns)):
                if piece == 0:
                    if reader:
                        yield reader.row(name)
                    reader, name = Reader(coder.bytes_of), conv
                reader.piece(np.frombuffer(ids, "<i4"), np.frombuffer(mask, np.uint8)
                             .astype(np.int8))
        if reader:
            yield reader.row(name)

    def run(batches):
        held = []
        for row in rows(batches):
            held.append(row)
            if len(held) == 5000:
                yield _digests(held)
                held = []
        yield _digests(held)

    return map_batches(pieces, run, "conv_id long, n_turns long, turns_sha256 string, "
                                    "loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(_DIGESTS)
    return batch(list(_DIGESTS), [pa.array(list(c), k)
                                  for c, k in zip(columns, _DIGESTS.values())])


def format_conversations(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Token pieces of every conversation (conv_id, turn, role, text).

    Turns come by turn, then role, then a hash of the text; repeated rows are turns of their own.
    A null text or role is empty, null turns come first, rows with a null conv_id are one
    conversation. A text that is empty leaves its marks. Other columns are not read, an empty
    table gives no rows.
    """
    return assemble(encode_turns(conversations, tokenizer))
