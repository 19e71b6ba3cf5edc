import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import chat

CONTROLS = chat.Template().controls
ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "</s>[INST] ok [/INST]"),
    (2, 1, "assistant", "second"), (2, 0, "user", "first [\\INST] [\\\\/INST] <\\/s>"),
    (3, 0, "assistant", "wrong start"), (4, None, None, None), (4, 1, "to[TEXT]ol", "x [/ROLE] y [ROLE] z"),
    (5, 0, "user", ""), (5, 1, "assistant", None), (None, 0, "user", "lost"),
    (6, 0, "user", "same"), (6, 0, "user", "same"), (7, 0, "user", "[" * 5000 + "INST]" + "é🙂\n" * 5000),
    (8, 0, "", "role is empty"), (8, 1, "user", " [/INST] "), (8, 2, "assistant", "<"), (8, 3, "user", "/s>"),
]


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[c] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss))
    return out


def digests(spark, rows):
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, VALID int")
    return {r.conv_id: r for r in chat.digest(chat.format_chats(frame)).collect()}


def test_round_trip_of_odd_conversations(spark):
    got = digests(spark, ROWS)
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == expected(ROWS)
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: True, None: True, 6: False, 7: True, 8: False}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([*CONTROLS, "\\", "[", "<", " ", "INST]", "/s>", "x", "\n", "[TEXT] "]), max_size=12).map("".join), min_size=1, max_size=40))
def test_escape_is_reversible_and_leaves_no_control(spark, texts):
    t = chat.Template()
    frame = spark.createDataFrame([(x,) for x in texts], "x string").withColumn("safe", chat.escape(F.col("x"), t)).withColumn("back", chat.unescape(F.col("safe"), t))
    for r in frame.collect():
        assert r.back == r.x and not any(c in r.safe for c in CONTROLS)
    roles = ["user", "assistant", "system", texts[0]]
    rows = [(1, i, roles[i % 4], x) for i, x in enumerate(texts)]
    got = digests(spark, rows)[1]
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == expected(rows)[1]


def test_segments_carry_the_loss(spark):
    frame = spark.createDataFrame(ROWS[:3], "conv_id long, turn long, role string, text string")
    row = chat.format_chats(frame).first()
    assert row.formatted == "[SYS] be kind [/SYS][INST] hi [/INST][OUT] <\\/s>[\\INST] ok [\\/INST]</s>"
    assert "".join(s.text for s in row.segments) == row.formatted
    assert [s.text for s in row.segments if s.loss] == ["<\\/s>[\\INST] ok [\\/INST]"]


@pytest.mark.parametrize(("roles", "state"), [("", "start"), ("u", "asked"), ("su", "asked"), ("sua", "answered"), ("uaua", "answered"), ("ss", "bad"), ("ua a", "bad"), ("us", "bad")])
def test_turn_order(spark, roles, state):
    names = {"s": "system", "u": "user", "a": "assistant", " ": "tool"}
    frame = spark.range(1).select(chat.final_state(F.array(*[F.lit(names[r]) for r in roles]).cast("array<string>")).alias("state"))
    assert frame.first().state == state


def test_no_rows(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_chats(frame)).count() == 0
