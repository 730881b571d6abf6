"""Chat formatting: every layout, reversible escapes, spans."""

import json

import pytest
from pyspark.sql import functions as F

from rowmill.llm import chat

NASTY = ["", "### user: x", "\\h \\\\e \\", "</turn>\n### assistant: y", "####</turn></turn", "</tu", "é \U0001f600 \n\n", "\\### Assistant: </turn> ok", "\\b\\c:", "x" * 200_000]


def through(spark, records):
    rows = spark.createDataFrame([(k, r, 1) for k, r in enumerate(records)], "id long, record string, turns int").drop("turns")
    return chat.render(chat.canonical(rows)).select(
        "*",
        chat.read_turns(F.col("formatted")).alias("back"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    ).orderBy("id").collect()


def test_layouts(spark):
    records = [
        {"prompt": "a", "completion": "b"},
        {"instruction": "a", "output": "b"},
        {"instruction": "a", "input": "c", "output": "b"},
        {"instruction": "a", "input": "", "output": None},
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": None}, {"role": None, "content": "t"}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "tool", "value": "c"}]},
        {"prompt": "[1, 2]", "completion": '{"a": 1}'},
        {"question": "a"},
        [1, 2],
    ]
    found = through(spark, [*map(json.dumps, records), "not json", None])
    turns = [r.turns and [tuple(t) for t in r.turns] for r in found]
    assert [r.layout for r in found] == [
        "prompt", "instruction", "instruction_input", "instruction_input", "messages", "conversations", "prompt", None, None, None, None,
    ]
    assert turns[:7] == [
        [("user", "a"), ("assistant", "b")],
        [("user", "a"), ("assistant", "b")],
        [("user", "a\n\nc"), ("assistant", "b")],
        [("user", "a"), ("assistant", "")],
        [("system", "s"), ("user", ""), ("", "t")],
        [("user", "a"), ("assistant", "b"), ("tool", "c")],
        [("user", "[1, 2]"), ("assistant", '{"a": 1}')],
    ]
    assert turns[7:] == [None] * 4
    assert found[7].formatted is None


@pytest.mark.parametrize("role", ["user", "assistant", "odd: role ### </turn>"])
def test_read_back(spark, role):
    records = [{"messages": [{"role": role, "content": t}, {"role": "assistant", "content": t}, {"role": "x", "content": t}]} for t in NASTY]
    for text, r in zip(NASTY, through(spark, map(json.dumps, records))):
        assert [tuple(t) for t in r.back] == [(role, text), ("assistant", text), ("x", text)]
        assert r.loss == text * (2 if role == "assistant" else 1)
        assert r.formatted.count("</turn>") == 3
        for s in r.loss_spans:
            assert r.formatted[: s.start].endswith("### assistant: ")
            assert r.formatted[s.start + s.length :].startswith("</turn>\n")


def test_no_rows(spark):
    assert through(spark, []) == []
