"""Templates turn by turn, and tool calls there and back in every dialect."""

import json

import pytest
from pyspark.sql import functions as F

from brindle.functions import chat as C

CALLS = [[("look_up", '{"q": "a b", "n": 3}')], [("look_up", '{"q": "é\\"x", "deep": {"k": [1, null]}}'), ("add", '{"x": 1.5, "y": true}')], [("none", "{}")]]


@pytest.mark.parametrize("dialect", C.DIALECTS)
def test_calls_there_and_back(spark, dialect):
    df = spark.createDataFrame([(c,) for c in CALLS] + [(None,), ([],), ([("bad", "no json")],)], f"calls {C.CALLS}")
    got = df.select("calls", C.written_calls(F.col("calls"), dialect).alias("text")).select("*", C.read_calls(F.col("text"), dialect).alias("back")).collect()
    for r in got[:3]:
        if dialect == "glm4" and len(r.calls) > 1:
            assert r.text is None
        else:
            assert [(c.name, c.arguments) for c in r.back] == [(c.name, c.arguments) for c in r.calls], r.text
    assert [r.text for r in got[3:5]] == [None, None] and got[3].back is None
    assert dialect in ("default", "glm4") or got[5].text is None
    plain = spark.createDataFrame([("just words",), ("{",), ("<tool_call>\nnot json\n</tool_call>" if dialect == "qwen" else "",)], "t string").select(C.read_calls(F.col("t"), dialect).alias("c"))
    assert [r.c for r in plain.collect()] == [[], [], []]


def test_templates(spark):
    turns = [("user", "hi"), ("function", "call"), ("observation", "result"), ("assistant", None)]
    df = spark.createDataFrame([(turns, "be kind"), (turns[:1], None), ([], "x"), (turns[:1], "")], "turns array<struct<role:string,content:string>>, system string")
    text = lambda name: [list(r[0]) for r in df.select(C.rendered(F.col("turns"), C.TEMPLATES[name], F.col("system"))).collect()]
    a, b, c, d = text("mistral")
    assert a == ["<s>be kind\n\n[INST] hi[/INST]", "[TOOL_CALLS] call</s>", '[TOOL_RESULTS] {"content": result}[/TOOL_RESULTS]', " </s>"] and b == d == ["<s>[INST] hi[/INST]"] and c == []
    a, b, _, d = text("qwen")
    assert a[0] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n" and b[0].startswith("<|im_start|>system\nYou are Qwen") and b == d
    assert text("llama3")[1] == ["<s><|start_header_id|>user<|end_header_id|>\n\nhi<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"]
    assert text("default")[1] == ["Human: hi</s>\nAssistant:"]
    with pytest.raises(Exception, match="no slot for the role"):
        spark.createDataFrame([([("judge", "x")],)], "t array<struct<role:string,content:string>>").select(C.rendered(F.col("t"), C.TEMPLATES["chatml"])).collect()


TOOL = {"name": "find", "description": "Finds \"rows\" 行", "parameters": {"type": "object", "properties": {"q": {"type": "string", "description": "what"}, "kind": {"type": "string", "enum": ["a", "b"]}, "ids": {"type": "array", "description": "which", "items": {"type": "integer"}}}, "required": ["q"]}}


def described(spark, dialect, *texts):
    return [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(C.described_tools(F.col("t"), dialect, "01 Jan 2025")).collect()]


@pytest.mark.parametrize("dialect", C.DIALECTS)
def test_tools_described(spark, dialect):
    held, other = {"type": "function", "function": TOOL}, {"name": "stop"}
    said = described(spark, dialect, json.dumps([TOOL]), json.dumps([held]), json.dumps([TOOL, other]), "[]", None, "{", "3", "[1]", '[{"description": "x"}]', json.dumps([{"type": "function", "function": "find"}]))
    one, same, two = said[:3]
    assert said[3:8] == ["", None, None, None, None] and said[9] is None and (said[8] is None)
    assert "find" in one and "stop" in two and "@" not in one and len(two) > len(one)
    assert (one == same) != (dialect == "seed_oss")  # seed_oss lists tools as they are given
    if dialect == "default":
        assert "> Tool Name: find\nTool Description: Finds \"rows\" 行\nTool Args:\n  - q (string, required): what\n  - kind (string): , should be one of [a, b]\n  - ids (array): which, where each item should be integer\n\nUse the" in one
        assert "(one of [find, stop])" in two and "> Tool Name: stop\nTool Description: \nTool Args:\n\n" in two
    if dialect == "mistral":
        assert one == "[AVAILABLE_TOOLS] " + json.dumps([held], ensure_ascii=False) + "[/AVAILABLE_TOOLS]"
    if dialect in ("qwen", "glm4_moe"):
        assert f"<tools>\n{json.dumps(held, ensure_ascii=False)}\n</tools>" in one
    if dialect == "llama3":
        assert "Today Date: 01 Jan 2025\n" in one and one.endswith(json.dumps(held, indent=4, ensure_ascii=False) + "\n\n")
    if dialect == "glm4":
        assert f"\n\n## find\n\n{json.dumps(TOOL, indent=4, ensure_ascii=False)}\n" in one
    if dialect == "seed_oss":
        assert json.dumps([TOOL], ensure_ascii=False) in one


def test_tools_that_look_like_marks(spark):
    tool = json.dumps([{"name": "x", "description": "@tools @names @date"}])
    for dialect in C.DIALECTS:
        assert described(spark, dialect, tool)[0].count("@tools @names @date") == 1


def test_tools_follow_the_system(spark):
    df = spark.createDataFrame([([("user", "hi")], "Be kind.", json.dumps([TOOL])), ([("user", "hi")], "Be kind.", "[]")], "turns array<struct<role:string,content:string>>, system string, tools string")
    text = [r[0][0] for r in df.withColumn("said", F.concat("system", C.described_tools(F.col("tools"), "qwen"))).select(C.rendered(F.col("turns"), C.TEMPLATES["qwen"], F.col("said"))).collect()]
    assert text[0].startswith("<|im_start|>system\nBe kind.\n\n# Tools\n\nYou may") and text[1].startswith("<|im_start|>system\nBe kind.<|im_end|>")
