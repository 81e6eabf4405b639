"""Chat formatting by columnar byte assembly.

Turns arrive sorted by conversation. Texts are escaped as Arrow columns; numpy computes the length of
every segment (header, role, line end, text, trailer), cumulative offsets and the index of every byte,
and copies all of them into one buffer that becomes the Arrow column of formatted conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices


@dataclass(frozen=True)
class Template:
    """begin + role + "\\n" + text + end per turn. A backslash in a text is doubled and one is put
    behind the first character of every control string, so no control string is left inside."""

    begin: str = "<s>"
    end: str = "</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learned: tuple[str, ...] = ("assistant",)


LLAMA = Template()


def escape(texts: pa.Array, template: Template) -> pa.Array:
    texts = pc.replace_substring(texts, "\\", "\\\\")
    for control in sorted(template.controls, key=len, reverse=True):
        texts = pc.replace_substring(texts, control, control[0] + "\\" + control[1:])
    return texts


def escape_role(roles: pa.Array, template: Template) -> pa.Array:
    return pc.replace_substring(escape(roles, template), "\n", "\\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data or b"", np.uint8), at


def assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array, template: Template,
             block: int = 4 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted turns -> (bytes, start of every turn and the end, [start, end) of every text)."""
    begin, line, end = (np.frombuffer(x.encode(), np.uint8) for x in (template.begin, "\n", template.end))
    role_data, role_at = _bytes(escape_role(roles, template))
    text_data, text_at = _bytes(escape(texts, template))
    n = len(conv)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(begin), 1, len(end)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    offsets = np.zeros(5 * n + 1, np.int64)
    np.cumsum(lengths.ravel(), out=offsets[1:])
    out = np.empty(int(offsets[-1]), np.uint8)
    starts = offsets[:-1].reshape(n, 5)
    for column, piece in ((0, begin), (2, line), (4, end)):
        out[starts[:, column, None] + np.arange(len(piece))] = piece
    for column, data, at in ((1, role_data, role_at), (3, text_data, text_at)):
        first = 0
        while first < n:  # scatter indices of about `block` bytes at a time
            last = max(first + 1, int(np.searchsorted(at, at[first] + block, "right")) - 1)
            size = lengths[first:last, column]
            source = np.arange(at[first], at[last])
            out[source + np.repeat(starts[first:last, column] - at[first:last], size)] = data[at[first]:at[last]]
            first = last
    return out, np.append(starts[:, 0], offsets[-1]), np.stack([starts[:, 3], starts[:, 4]], 1)


def _formatted(batch: pa.Table, template: Template) -> Iterator[pa.RecordBatch]:
    """Whole conversations, sorted by conversation and turn -> one row per conversation."""
    conv_column = batch.column("conv").combine_chunks()
    known = pc.fill_null(conv_column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    roles, texts = batch.column("role").combine_chunks(), batch.column("text").combine_chunks()
    out, turn_at, text_at = assemble(known, roles, texts, template)
    new = np.flatnonzero(np.append(True, known[1:] != known[:-1]))
    offsets = np.append(turn_at[new], turn_at[-1]).astype(np.int64)
    whole = pa.LargeStringArray.from_buffers(len(new), pa.py_buffer(offsets), pa.py_buffer(out))
    learned = pc.is_in(roles, pa.array(template.learned)).to_numpy(zero_copy_only=False)
    which = np.searchsorted(new, np.arange(len(known)), "right") - 1
    spans = (text_at - offsets[which][:, None])[learned]
    of = np.concatenate([[0], np.cumsum(np.bincount(which[learned], minlength=len(new)))]).astype(np.int32)
    yield pa.RecordBatch.from_arrays([
        conv_column.take(pa.array(new)), whole.cast(pa.string()),
        pa.ListArray.from_arrays(pa.array(of), pa.array(spans[:, 0])),
        pa.ListArray.from_arrays(pa.array(of), pa.array(spans[:, 1])),
    ], names=["conv_id", "formatted", "loss_start", "loss_end"])


SCHEMA = "conv_id {kind}, formatted string, loss_start array<long>, loss_end array<long>"


def chat_format(turns: DataFrame, template: Template = LLAMA, buffer: int = 32 << 20) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, formatted text, byte spans under the loss mask.

    Turns are ordered by turn (null first), ties by role and text; repeated rows stay repeated turns;
    null texts and roles are empty; turns without a conv_id form one conversation; a conv_id may be of any type that has
    an order; an empty table gives no rows; other columns are ignored. A task holds about `buffer` bytes and one conversation at a time.
    """
    rows = turns.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # the order of conversations inside a task does not matter, only that a conversation is together
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < buffer:
                continue
            table = pa.Table.from_batches(held)
            convs = table.column("conv")
            same = pc.fill_null(pc.equal(convs, convs[-1]), False) if convs[-1].is_valid else convs.is_null()
            cut = pc.index(same, True).as_py()  # the last conversation may go on
            if cut:
                yield from _formatted(table.slice(0, cut), template)
                table = table.slice(cut)
            held = table.combine_chunks().to_batches()
            size = table.nbytes
        if held:
            yield from _formatted(pa.Table.from_batches(held), template)

    return rows.mapInArrow(run, SCHEMA.format(kind=turns.schema["conv_id"].dataType.simpleString()))


def parse(formatted: str, template: Template = LLAMA) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation, unescaped."""
    turns = []
    for turn in formatted.split(template.end)[:-1]:
        head, body = re.match(r"((?:[^\\\n]|\\.)*)\n(.*)\Z", turn[len(template.begin):], re.DOTALL).groups()
        turns.append((unescape(head), unescape(body)))
    return turns


def loss_text(formatted: str, starts: list[int], ends: list[int]) -> str:
    """The text under the loss mask, unescaped span by span."""
    data = formatted.encode()
    return "".join(unescape(data[a:b].decode()) for a, b in zip(starts, ends, strict=True))


def read_back(formatted: DataFrame, template: Template = LLAMA) -> DataFrame:
    """Digests read from formatted conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for r in batch.to_pylist():
                turns = parse(r["formatted"], template)
                loss = loss_text(r["formatted"], r["loss_start"], r["loss_end"])
                rows.append((len(turns), _sha("".join(f"{role}\n{text}\n" for role, text in turns)), len(loss), _sha(loss),
                             len(r["formatted"])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c)) for c in zip(*rows, strict=True))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
