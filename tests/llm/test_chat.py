"""Formatting, escaping and reading back."""

import random

from pyspark.sql import functions as F

from hashloom.llm import chat

ROWS = "conv_id long, turn long, role string, text string, n_blocks long"


def formatted(spark, rows):
    made = chat.format_chats(spark.createDataFrame(rows, ROWS))
    return made.select("conv_id", "n_blocks", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), "segments")


def test_adjacent_turns_of_a_role_merge(spark):
    r = formatted(spark, [(1, 1, "user", "b", 0), (1, 0, "user", "a", 0), (1, 2, "assistant", "c", 0)]).first()
    assert r.formatted == "### user: a<+>b</turn>\n### assistant: c</turn>\n"
    assert (r.n_blocks, r.loss, "".join(s.text for s in r.segments)) == (2, "c", r.formatted)


def test_any_text_is_read_back(spark):
    rng = random.Random(1)
    pieces = ["\\", "\\b", "\\l", "<", "<+>", "</turn>\n", "### ", ": ", "#", ":", "assistant", "\n", "é", "🙂", "$1", ""]
    word = lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))
    chats = {c: [(rng.choice(["user", "assistant", word()]), word()) for _ in range(rng.randint(1, 6))] for c in range(150)}
    rows = [(c, t, *x, 0) for c, turns in chats.items() for t, x in enumerate(turns)]
    for r in formatted(spark, rows).collect():
        assert [(t.role, t.text) for t in r.turns] == chats[r.conv_id]
        assert r.loss == "".join(t for role, t in chats[r.conv_id] if role == "assistant")


def test_odd_rows(spark):
    rows = [(1, None, None, "x", 0), (1, 0, "user", None, 0), (1, 0, "user", None, 0), (None, 5, "assistant", "z", 0), (2, 0, "assistant", "w" * 200_000, 0)]
    got = {r.conv_id: r for r in formatted(spark, rows).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("", "x"), ("user", ""), ("user", "")]
    assert got[None].loss == "z" and got[2].loss == "w" * 200_000
    assert formatted(spark, []).count() == 0


def test_no_python_in_the_plan(spark):
    plan = formatted(spark, [(1, 0, "user", "a", 0)])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
