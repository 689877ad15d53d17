"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once, with offsets. The sorted spans of the assistant's turns are then
intersected with the token spans by binary search, so the mask says which characters of which token count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.packing import default_tokenizer

#: Control strings; all begin with the sign that is escaped inside texts and roles.
OPEN, MIDDLE, CLOSE = "<turn ", ">\n", "</turn>\n"
TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>\n((?:[^\\<]|\\.)*)</turn>\n", re.S)
LEARNED_ROLE = "assistant"


def escaped(text: str, signs: str = r"[\\<]") -> str:
    return re.sub(signs, r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns and the spans of the assistant's escaped texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escaped(role, r'[\\<>]')}{MIDDLE}", escaped(text)
        if role == LEARNED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    return [(unescaped(m[1]), unescaped(m[2])) for m in TURN.finditer(formatted)]


def intersect(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens that meet a span, and the characters they share with it; both lists are sorted."""
    tokens, lows, highs = [], [], []
    for low, high in spans:
        first, last = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
        if low < high:
            tokens.append(np.arange(first, last))
            lows.append(np.maximum(starts[first:last], low))
            highs.append(np.minimum(ends[first:last], high))
    none = [np.empty(0, np.int64)]
    return np.concatenate(tokens or none), np.concatenate(lows or none), np.concatenate(highs or none)


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The unescaped texts under a mask; tokens that share a character or touch belong to one text."""
    texts, low, high = [], None, None
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        if low is None or start > high:
            if low is not None:
                texts.append(unescaped(formatted[low:high]))
            low, high = start, end
        high = max(high, end)
    return texts + ([unescaped(formatted[low:high])] if low is not None else [])


def format_conversations(turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): conv_id, formatted, ids, starts, ends, loss_tokens, loss_starts, loss_ends.

    Turns are in order of turn, then role, then text, nulls first; null roles and texts count as empty. Rows that repeat
    are repeated turns, rows with null conv_id one conversation. Only the role "assistant" is learned, an empty text of it
    has an empty mask. Other columns are ignored; an empty table gives no rows. A row of the result is a conversation, so
    one task holds a whole one at a time.
    """
    path = tokenizer or default_tokenizer()
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer, processors

        coder = Tokenizer.from_file(path)
        coder.encode_special_tokens = True
        coder.post_processor = processors.ByteLevel(trim_offsets=False)
        for whole in batches:
            for batch in (whole.slice(at, 64) for at in range(0, whole.num_rows, 64)):
                made: list[list] = [[], [], [], [], [], [], []]
                for row in batch.column(1):
                    formatted, spans = render([(t["role"] or "", t["text"] or "") for t in row.as_py()])
                    coded = coder.encode(formatted, add_special_tokens=False)
                    offsets = np.array(coded.offsets, np.int64).reshape(-1, 2)
                    for column, value in zip(made, (formatted, coded.ids, offsets[:, 0], offsets[:, 1], *intersect(spans, offsets[:, 0], offsets[:, 1])), strict=True):
                        column.append(value)
                arrays = [pa.array(c, k) for c, k in zip(made, [pa.string()] + [pa.list_(pa.int32())] * 6, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["conv_id", "formatted", "ids", "starts", "ends", "loss_tokens", "loss_starts", "loss_ends"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    lists = ", ".join(f"{c} array<int>" for c in ("ids", "starts", "ends", "loss_tokens", "loss_starts", "loss_ends"))
    return gathered.select("conv_id", "turns").mapInArrow(form, f"conv_id {kind}, formatted string, {lists}")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns, and the text under the mask."""
    import hashlib

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, text, low, high in zip(*(batch.column(k) for k in range(4)), strict=True):
                formatted = text.as_py()
                turns = parse(formatted)
                learned = "".join(masked_text(formatted, np.array(low.as_py(), np.int64), np.array(high.as_py(), np.int64)))
                whole = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest()
                rows.append((conv_id.as_py(), len(turns), whole, len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
