"""Packing: ids, pieces and places against plain encoding; the plan against one sequence at a time."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.packing import Encoder, best_two_fit, default_tokenizer, pack

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("piece", T.StringType())])


def one_at_a_time(sizes, capacity):
    """Best-two-fit without counting: greedy filling, then the smallest piece gives way to the best two."""
    left, bins = sorted(sizes, reverse=True), []
    while left:
        filled = []
        while fits := [s for s in left if s <= capacity - sum(filled)]:
            filled.append(fits[0])
            left.remove(fits[0])
        gap, smallest = capacity - sum(filled) + min(filled), min(filled)
        if capacity > sum(filled):
            pairs = [(a + b, a) for k, a in enumerate(left) for b in left[k + 1 :] if smallest < a + b <= gap]
            if pairs:
                total, a = max(pairs)
                filled.remove(smallest)
                left.remove(a)
                left.remove(total - a)
                filled += [a, total - a]
                left = sorted([*left, smallest], reverse=True)
        bins.append(filled)
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_plan(seed):
    pick = random.Random(seed)
    sizes = [pick.choice([pick.randint(1, 40), pick.randint(1, 12), 7]) for _ in range(150)]
    plan = best_two_fit(np.bincount(sizes, minlength=41), 40)
    used = collections.Counter()
    for times, pattern in plan:
        assert sum(s * n for s, n in pattern) <= 40 and times > 0
        used.update({s: n * times for s, n in pattern})
    assert used == collections.Counter(sizes)
    assert abs(sum(times for times, _ in plan) - len(one_at_a_time(sizes, 40))) <= 1


def plain_ids(tokenizer, text):
    return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("special_as_text", [False, True])
def test_encoder_equals_a_fresh_tokenizer(special_as_text, monkeypatch):
    monkeypatch.setattr(packing, "UNCUT", re.compile(r"\S{30}|\s{30}"))
    monkeypatch.setattr(packing, "LONG_RUN", 30)
    tokenizer = Tokenizer.from_file(default_tokenizer())
    tokenizer.encode_special_tokens = special_as_text
    encode, pick = Encoder(default_tokenizer(), special_as_text), random.Random(2)
    signs = [" ", "  ", "\n", "\t", "a", "Zq", "é", "1", "!!", "don't", "'s", "　", "的", "<|endoftext|>", "\x1c", "\x85", "\r\n", "##", "ß.", "٣", "😀", "é", "abcdefghijk" * 4]
    for _ in range(4000):
        text = "".join(pick.choice(signs) for _ in range(pick.randint(0, 12)))
        assert encode(text) == plain_ids(tokenizer, text), text
    assert (plain_ids(tokenizer, "<|endoftext|>") == (50256).to_bytes(4, "little")) != special_as_text


def test_pack(spark):
    rows = [(k, "word " * (k * 13 % 700), "x") for k in range(200)] + [(500, None, "x"), (501, "", None), (None, "x y", "x"), (502, "long text, " * 9000, "x"), (3, "word " * 39, "x"), (3, "word " * 39, "x"), (503, "a <|endoftext|>b<|endoftext|>", "x")]
    found = pack(spark.createDataFrame(rows, SCHEMA)).collect()
    tokenizer, wanted = Tokenizer.from_file(default_tokenizer()), collections.Counter()
    for doc_id, text, _ in rows:
        ids = plain_ids(tokenizer, text or "") + (2).to_bytes(4, "little")
        n, start, piece = len(ids) // 4, 0, 0
        while start < n:
            length = min(n, 1024) if n <= 1024 else (n % 1024 or 1024) if start == 0 else 1024
            wanted[doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])] += 1
            start, piece = start + length, piece + 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted
    places = collections.defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in found)
    assert len(places) <= 1.02 * total / 1024 + 1
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0
