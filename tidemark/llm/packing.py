"""Best-two-fit packing of tokenised documents into fixed-length training sequences.

Placement depends only on how many pieces have each length, so it is planned on that histogram (at most
``capacity`` numbers, whatever the corpus holds) and then carried out by the tasks, each for its own pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import written

END_ID = 2
#: Pieces that one task places at a time.
GROUP_ROWS = 20_000
# The pattern by which byte-level vocabularies of this kind cut a text before they merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merging takes time in the square of an uncut run, so that texts with a longer one go the slower, linear way.
LONG_RUN = 20_000
UNCUT = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")


def _byte_signs() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    spare = iter(range(256, 512))
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(next(spare)) for b in range(256)]


def default_tokenizer() -> str:
    """Path of the 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, by a byte-level vocabulary of tokenizers.

    The file's vocabulary is merged by tiktoken, which gives the ids of tokenizers in a quarter of its time; texts with very
    long runs go to tokenizers itself. ``special_as_text`` takes the strings of special tokens in a text for ordinary text;
    else they become their tokens, as they do by default.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        byte_of = {sign: b for b, sign in enumerate(_byte_signs())}
        ranks = {bytes(map(byte_of.__getitem__, word)): number for word, number in spec["model"]["vocab"].items() if word not in special}
        self.path, self.special_as_text, self.slow = path, special_as_text, None
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.allowed = frozenset() if special_as_text else frozenset(special)

    def _linear(self, text: str) -> bytes:
        from tokenizers import Tokenizer

        if self.slow is None:
            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = self.special_as_text
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if len(text) >= LONG_RUN and UNCUT.search(text):
            return self._linear(text)
        return self.fast.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=()).astype("<u4", copy=False).tobytes()


def pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and ``salt``, a number that differs within a task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, salt = Encoder(tokenizer), np.array([END_ID], "<u4").tobytes(), 0
        for batch in batches:
            rows: list[tuple] = []
            doc_ids = batch.column(0).to_pylist()
            for doc_id, text in zip(doc_ids, batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = n % capacity or capacity if start == 0 else capacity
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), salt))
                    start, piece, salt = start + length, piece + 1, salt + 1
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, salt long")


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (sequences, [(length, pieces of it)]) for counts[length] pieces.

    Each sequence is filled greedily, longest piece first. Where room is left, the smallest piece gives way to the two
    unpacked pieces whose sum comes nearest to the expanded gap, if together they exceed it. As long as the counts allow,
    the same choices recur, so a pattern is applied as often as the counts allow before the next one is sought.
    """
    left, plan = counts.astype(np.int64).copy(), []
    while left.any():
        used: dict[int, int] = {}
        room = capacity
        while room and len(fits := np.flatnonzero(left[: room + 1])):
            for size in fits[::-1]:
                size = int(size)
                if size <= room and (take := min(int(left[size]) - used.get(size, 0), room // size)) > 0:
                    used[size] = used.get(size, 0) + take
                    room -= take * size
                    break
            else:
                break
        peak = dict(used)
        smallest = min(used)
        if room and (pair := _pair(left, used, smallest, room + smallest)):
            used[smallest] -= 1
            for size in pair:
                used[size] = used.get(size, 0) + 1
                peak[size] = max(peak.get(size, 0), used[size] + (size == smallest))
        times = min(int(left[size]) // n for size, n in peak.items() if n)
        pattern = sorted(((size, n) for size, n in used.items() if n), reverse=True)
        for size, n in pattern:
            left[size] -= times * n
        plan.append((times, pattern))
    return plan


def _pair(left: np.ndarray, used: dict[int, int], smallest: int, gap: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the greatest sum in (smallest, gap], if any."""
    free = {int(s): int(left[s]) - used.get(int(s), 0) for s in np.flatnonzero(left[: gap + 1])}
    sizes = [s for s, n in free.items() if n > 0]
    low, high, best, found = 0, len(sizes) - 1, smallest, None
    while low <= high:
        total = sizes[low] + sizes[high]
        if total > gap:
            high -= 1
            continue
        if total > best and (low < high or free[sizes[low]] > 1):
            best, found = total, (sizes[high], sizes[low])
        low += 1
    return found


def _slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """By length: rows (first slot, pieces per sequence, first sequence, first offset) in order of the first slot."""
    found: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for times, pattern in plan:
        offset = 0
        for size, n in pattern:
            found.setdefault(size, []).append((taken.get(size, 0), n, sequence, offset))
            taken[size] = taken.get(size, 0) + times * n
            offset += n * size
        sequence += times
    return {size: np.array(rows, np.int64) for size, rows in found.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024) -> DataFrame:
    """Packs all documents (columns doc_id, text; others are ignored) into sequences of at most ``capacity`` tokens.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id and offset. Null and empty texts are the end
    token alone. A document over the capacity is cut into pieces of the capacity, of which the first may be shorter.
    Repeated rows are packed each time; a null doc_id stays null. An empty table gives no rows.
    """
    cut = written(pieces(docs, tokenizer or default_tokenizer(), capacity), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():
        histogram[length] = n
    slots = _slots(best_two_fit(histogram, capacity))
    groups = max(1, -(-int(histogram.sum()) // GROUP_ROWS))
    grouped = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(groups)).cast("int"))
    ahead = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = grouped.groupBy("length", "bucket").count().select("bucket", "length", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))

    def place(rows: pd.DataFrame, ahead: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("length", kind="stable").reset_index(drop=True)
        length = rows["length"].to_numpy()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        begins = dict(zip(ahead["length"], ahead["ahead"], strict=True))
        sizes, first, n = np.unique(length, return_index=True, return_counts=True)
        for size, at, many in zip(sizes, first, n, strict=True):
            slot = begins[size] + np.arange(many)
            table = slots[int(size)]
            row = table[np.searchsorted(table[:, 0], slot, "right") - 1]
            local = slot - row[:, 0]
            sequence[at : at + many] = row[:, 2] + local // row[:, 1]
            offset[at : at + many] = row[:, 3] + local % row[:, 1] * size
        return rows.assign(sequence_id=sequence, offset=offset)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        grouped.groupBy("bucket")
        .cogroup(before.groupBy("bucket"))
        .applyInPandas(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )
