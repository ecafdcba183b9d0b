import random

from cairnlore.llm import chat
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>\n", "<|", "<\\|", "<\\\\|end|>", "a<", "|b", "é🙂", "", "\n\n", "﻿bom", "<<||>>", "$1 \\1"]


def read(out):
    return out.select("conv_id", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()


def test_turns_read_back_and_mask(spark):
    rng = random.Random(6)
    rows = []
    for c in range(40):
        for t in range(rng.choice([1, 2, 5, 200])):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "<|end|>", ""]), "".join(rng.choices(ODD, k=rng.randint(0, 4)))))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in read(chat.format_conversations(df, segment=16))}
    for c in range(40):
        own = sorted((t, r, x) for k, t, r, x in rows if k == c)
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in own]
        assert got[c].loss == [x for _, r, x in own if r == "assistant"]
        blocks = 1 + sum(a[1] != b[1] for a, b in zip(own, own[1:]))
        assert got[c].formatted.count(chat.TURN) == blocks and got[c].formatted.count(chat.PART) == len(own) - blocks
        raw = [chat_escape(x) for x in got[c].loss]
        assert [got[c].formatted[s.start : s.start + s.length] for s in got[c].loss_spans] == raw


def chat_escape(x):
    import re

    return re.sub(r"<(\\*)\|", r"<\1\\|", x)


def test_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, "first"), (None, 3, "assistant", None), (None, 1, "user", "q"), (2, 0, "assistant", "x" * 300_000)]
    got = {r.conv_id: r for r in read(chat.format_conversations(spark.createDataFrame(rows, SCHEMA)))}
    assert [(t.role, t.text) for t in got[1].turns] == [("", "first"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert [(t.role, t.text) for t in got[None].turns] == [("user", "q"), ("assistant", "")] and got[None].loss == [""]
    assert got[2].loss == ["x" * 300_000]
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    out = chat.format_conversations(spark.createDataFrame([(1, 0, "user", "a")], SCHEMA))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
