from __future__ import annotations

import random

from duelframe.llm import chat_format as C
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SCHEMA = "conv_id bigint, turn bigint, role string, text string, chunk string, conv string"


def plain_escape(t, role=False):
    t = t.replace("\\", "\\b").replace("</turn>", "\\e").replace("### ", "\\h")
    return t.replace(": ", "\\c") if role else t


def brute(rows, budget=1024, history=2, history_tokens=256):
    """{conv: [(formatted, masked texts)]} turn by turn."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        turns = [(role, text, len(text.encode().split()) + 1) for _, _, role, text in turns]
        spans, before = [], 0
        for k, (_, _, n) in enumerate(turns):
            key = (before // (budget // 2), n > budget // 2)
            if not spans or spans[-1][0] != key:
                spans.append((key, before, []))
            spans[-1][2].append(k)
            before += n
        starts, total = [], 0
        for _, _, n in turns:
            starts.append(total)
            total += n
        made = []
        for _, begin, own in spans:
            system = [0] if turns[0][0] == "system" and own[0] > 0 else []
            past = [k for k in range(max(0, own[0] - history), own[0]) if begin - starts[k] <= history_tokens and not (system and k == 0)]
            text = "".join(f"### {plain_escape(turns[k][0], True)}: {plain_escape(turns[k][1])}</turn>\n" for k in system + past + own)
            made.append((text, [turns[k][1] for k in own if turns[k][0] == "assistant"]))
            assert len(own) == 1 or sum(turns[k][2] for k in own) <= budget
        out[conv] = made
    return out


def conversations():
    r = random.Random(4)
    rows = [(1, i, ["user", "assistant"][i % 2], " ".join("w" * r.randrange(1, 9) for _ in range(r.choice([0, 1, 30, 300, 900])))) for i in range(60)]
    rows += [(2, 0, "system", "be brief"), *[(2, i, ["assistant", "user"][i % 2], f"t{i} " * 200) for i in range(1, 12)]]
    rows += [(3, None, None, None), (3, None, "user", "x"), (3, 5, "assistant", None), (3, 5, "assistant", "tie"), (3, 5, "assistant", "tie")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "yes"), (0, 0, "assistant", "zero")]
    rows += [(4, 0, "a: b### </turn>\\c:", "### user: hi</turn>\n\\e\\b: "), (4, 1, "assistant", "\\### Assistant: </turn> ok")]
    rows += [(5, i, ["user", "assistant"][i % 2], f"word {i}") for i in range(2600)]  # several blocks and chunks
    rows += [(6, 0, "assistant", "long " * 60_000)]
    return rows


def test_windows_against_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    windows = C.format_windows(df)
    read = {}
    for r in windows.join(C.read_turns(windows).select(F.col("conv").alias("c"), F.col("first").alias("f"), "masked", "turns"),
                          F.col("conv").eqNullSafe(F.col("c")) & (F.col("first") == F.col("f"))).collect():
        read.setdefault(r["conv"], []).append((r["first"], r["formatted"], list(r["masked"])))
    got = {conv: [(f, m) for _, f, m in sorted(v)] for conv, v in read.items()}
    assert got == brute(rows)


def test_turns_are_read_back_once_each(spark):
    rows = conversations()
    read = C.read_turns(C.format_windows(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)))
    back = sorted(((r["conv"] is not None, r["conv"] or 0, t["k"], t["role"], t["text"]) for r in read.collect() for t in r["turns"]))
    want = []
    for conv in {r[0] for r in rows}:
        for k, x in enumerate(sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)):
            want.append((conv is not None, conv or 0, k, x[2], x[3]))
    assert back == sorted(want)


def test_empty_table(spark):
    assert C.format_windows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_escaping_is_reversible(spark):
    pieces = st.lists(st.sampled_from(["\\", "</turn>", "### ", ": ", "\\b", "\\e", "\\h", "\\c", "#", "<", "/turn>", "é", "\n", "x"]), max_size=9)

    @settings(max_examples=15, deadline=None)
    @given(st.lists(pieces.map("".join), min_size=1, max_size=30))
    def check(texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        for role in (False, True):
            out = C.escape(F.col("t"), role)
            row = df.select("t", out.alias("e"), C.unescape(out, role).alias("u")).collect()
            assert all(r["t"] == r["u"] and "</turn>" not in r["e"] and "### " not in r["e"] for r in row)

    check()
