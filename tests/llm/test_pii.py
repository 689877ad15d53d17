"""Pseudonyms: permutations by brute force, formats, links between documents, and the way back."""

import re

import pytest
from pyspark.sql import types as T

from tidemark.llm.pii import Feistel, Pseudonyms, luhn_digit, pseudonymise

VALUES = ["4785380592391139", "4785-3805-9239-1139", "152.143.123.131", "und.34@mail7.example.com", "UND.34@MAIL7.EXAMPLE.COM", "+1 (017) 555-7713", "123-45-6789", "2024-02-29", "29.02.2024", "02/29/2024", "29/02/2024", "1066-10-14", "GB29NWBK60161331926819", "GB29 NWBK 6016 1331 9268 19", "555 123 4567", "+49 30 1234 5678"]
KEPT = ["4785380592391138", "352.143.123.131", "2023-02-29", "GB28NWBK60161331926819", "version 4.0.1", "666-45-6789", "word 12", "1.2.3.4.5", "a@b", "", "0000000000000000"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("pii_spans", T.StringType())])


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutations(n):
    f = Feistel(b"k")
    made = [f.permute(x, n, "x") for x in range(n)]
    assert sorted(made) == list(range(n)) and [f.permute(y, n, "x", back=True) for y in made] == list(range(n))
    assert n < 90 or made != [Feistel(b"other").permute(x, n, "x") for x in range(n)]


def test_formats():
    forth, back = Pseudonyms(b"k"), Pseudonyms(b"k", back=True)
    for value in VALUES:
        made, spans = forth.replace(f"See {value}, or {value}!! end")
        got = re.fullmatch(r"See (.*), or (.*)!! end", made)
        assert got and got[1] == got[2] != value and len(spans) == 2, value
        assert re.sub("[0-9]+", "9", got[1]).count("9") == re.sub("[0-9]+", "9", value).count("9")
        assert back.replace(made)[0] == f"See {value}, or {value}!! end", value
    for value in KEPT:
        assert forth.replace(f"See {value}, end") == (f"See {value}, end", []), value
    made = re.sub("[^0-9]", "", forth.replace(VALUES[0])[0])
    assert len(made) == 16 and luhn_digit(made[:-1]) == int(made[-1])
    assert forth.replace(VALUES[1])[0].replace("-", "") == made
    assert forth.replace(VALUES[4])[0].lower() == forth.replace(VALUES[3])[0]
    secret = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### x'
    made, spans = forth.replace(secret)
    assert re.fullmatch(r'token = "[0-9a-f]{40}"### x', made) and made != secret and spans == [("secret", 9, 40)] and back.replace(made)[0] == secret


def test_a_value_can_be_its_own_pseudonym():
    """Small formats show it: over many keys a permutation of n values has one fixed point on average."""
    own = sum(Feistel(bytes([key])).permute(x, 10, "x") == x for key in range(200) for x in range(10))
    assert 120 < own < 280


def test_phones_with_and_without_country_code_are_not_linked():
    names = Pseudonyms(b"k")
    long, short = (re.sub("[^0-9]", "", names.replace(v)[0]) for v in ("+1 555 123 4567", "555 123 4567"))
    assert not long.endswith(short)


def test_documents(spark):
    rows = [(k, f"{v} and {w}", "x") for k, v in enumerate(VALUES) for w in VALUES[k : k + 1]]
    rows += [(100, None, "x"), (101, "", "x"), (None, VALUES[0], None), (102, "clean text, nothing here", "x"), (103, "é" * 200_000 + " " + VALUES[2], "x"), (104, VALUES[2] * 1, "x"), (104, VALUES[2], "x")]
    found = pseudonymise(spark.createDataFrame(rows, SCHEMA), b"k").collect()
    names = Pseudonyms(b"k")
    wanted = [(i, t if t is None else names.replace(t)[0]) for i, t, _ in rows]
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted(wanted, key=str)
    assert all(v not in (r.text or "") for r in found for v in VALUES[:5])
    again = pseudonymise(spark.createDataFrame(found, "doc_id long, text string, pii_spans array<struct<kind: string, start: int, length: int>>"), b"k", back=True).collect()
    assert sorted(((r.doc_id, r.text) for r in again), key=str) == sorted(((i, t) for i, t, _ in rows), key=str)
    assert pseudonymise(spark.createDataFrame([], SCHEMA), b"k").count() == 0
