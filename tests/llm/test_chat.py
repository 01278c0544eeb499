from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docengine.llm import chat

LAYOUTS = {
    "messages": {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "extra": 1},
    "from and value": {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
    "instruction with input": {"instruction": "hi", "input": "", "output": "yo"},
    "instruction": {"instruction": "hi", "output": "yo"},
    "prompt and response": {"prompt": "hi", "response": "yo"},
    "prompt and completion": {"prompt": "hi", "completion": "yo"},
    "question and answer": {"question": "hi", "answer": "yo"},
}


def test_layouts(spark):
    records = [(i, json.dumps(r)) for i, r in enumerate(LAYOUTS.values())] + [(90, "no json"), (91, None), (92, "{}"), (93, json.dumps({"prompt": None, "response": "yo"})), (94, json.dumps(LAYOUTS["messages"] | LAYOUTS["prompt and response"]))]
    out = {r["conv"]: r for r in chat.json_turns(spark.createDataFrame(records, "conv_id long, record string")).collect()}
    for i, name in enumerate(LAYOUTS):
        assert out[i]["layout"] == name, name
        assert [tuple(t) for t in out[i]["turns"]] == [("user", "hi"), ("assistant", "yo")], name
    assert all(out[i]["layout"] is None and out[i]["turns"] == [] for i in (90, 91, 92, 93))
    assert out[94]["layout"] == "messages"


def test_table_layouts(spark):
    one = spark.createDataFrame([(7, [("user", "hi"), ("assistant", "yo")])], "conv_id long, messages array<struct<role:string,content:string>>")
    assert [tuple(r) for r in chat.turns_of(one, fields=["messages[].role", "messages[].content"]).orderBy("at").collect()] == [(7, 0, "user", "hi"), (7, 1, "assistant", "yo")]
    with pytest.raises(ValueError):
        chat.turns_of(one.select("conv_id"))
    assert chat.select_mapping(["turn", "text", "role", "conv_id"]).per_row


def brute(turns):
    out = {}
    key = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=key)
        out[conv] = [(t[2] or "", t[3] or "") for t in own]
    return out


TURNS = [
    (1, 0, "user", "a <|im_end|> b"), (1, 1, "assistant", "<\\|x <\\\\| <|"), (1, None, None, None), (2, 5, "as\nsis%0A%tant", "\n\n"), (2, 5, "assistant", ""), (2, 5, "assistant", ""),
    (None, 0, "assistant", "<|im_end|>\n<|im_start|>user\nno"), (3, 0, "<|im_end|>\n", "x" * 50000),
]


def test_round_trip_and_mask(spark):
    df = spark.createDataFrame(TURNS, "conv long, at long, role string, text string")
    out = chat.format_chat(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    want = brute(TURNS)
    assert len(out) == len(want)
    for r in out:
        turns = want[r["conv"]]
        assert [tuple(t) for t in r["back"]] == turns and r["n_turns"] == len(turns)
        assert r["loss_mask"] == [role == "assistant" for role, _ in turns]
        texts = [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]]
        assert [t.count("<|") for t in texts] == [0] * len(texts)
        assert len(texts) == sum(r["loss_mask"])


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chat(chat.turns_of(df)).count() == 0
    more = spark.createDataFrame([(1, 2, "user", "x", "y", 3)], "conv_id long, turn long, role string, text string, formatted string, head int")
    assert chat.format_chat(chat.turns_of(more)).first()["n_turns"] == 1


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="<|\\%0A\nim_end>ä", max_size=12), min_size=1, max_size=40))
def test_escapes(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r")).collect()
    assert all("<|" not in r["e"] and r["u"] == r["t"] == r["r"] for r in out)
