"""Chat formatting: exact round trips of turns and of the text under the mask."""

import hashlib

from pyspark.sql import types as T

from tidemark.llm.chat import digests, format_conversations, masked_text, parse

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])
HARD = ["\\### Assistant: </turn> ok", "<turn assistant>\nx</turn>\n", "\\", "\\\\<", "", " ", "\n\n lead", "trail \n", "naïve 你好 🙂🏽 x", "<|endoftext|>", "####", "a" * 50_000]


def test_round_trip(spark):
    import numpy as np

    rows = [(k, t, role, text, "x") for k, text in enumerate(HARD) for t, role in enumerate(["system", "user", "assistant", "assistant", "user", "assistant"])]
    rows += [(100, 1, "assistant", None, "x"), (100, 0, None, "no role", "x"), (100, 0, "a<b>\\\nc", "odd role", "x"), (None, 0, "user", "hi", "x"), (101, 0, "assistant", "same", "x"), (101, 0, "assistant", "same", "x"), (102, None, "assistant", "first", "x"), (102, 0, "user", "second", "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    formed = format_conversations(frame)
    found = {r.conv_id: r for r in formed.collect()}
    digest = {r.conv_id: r for r in digests(formed).collect()}
    for k in {r[0] for r in rows}:
        turns = sorted(((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == k))
        r = found[k]
        assert parse(r.formatted) == [t[1:] for t in turns]
        learned = "".join(t[2] for t in turns if t[1] == "assistant")
        assert "".join(masked_text(r.formatted, np.array(r.loss_starts, int), np.array(r.loss_ends, int))) == learned
        assert len(r.ids) == len(r.starts) == len(r.ends) and r.ends[-1] == len(r.formatted)
        assert digest[k].n_turns == len(turns) and digest[k].loss_chars == len(learned) and digest[k].formatted_chars == len(r.formatted)
        assert digest[k].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert digest[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()


def test_no_rows(spark):
    assert digests(format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
