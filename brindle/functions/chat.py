"""Chat templates with slots for each role, and tool calls in the dialects of several model families."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Slots, with {} for the content: system, user, assistant, observation (what a tool gave) and function (a tool call; null: as an assistant's turn). prefix stands first of all; the
    system turn, or default_system, comes before the first turn, not as a turn of its own."""

    user: str
    assistant: str
    system: str = "{}"
    observation: str | None = None
    function: str | None = None
    prefix: str = ""
    default_system: str = ""
    dialect: str = "default"


#: The formats of chat templates; </s> and <s> stand for a tokenizer's end and begin.
TEMPLATES = {
    "default": Template("Human: {}</s>\nAssistant:", "{}</s>\n", "System: {}</s>\n"),
    "alpaca": Template("### Instruction:\n{}\n\n### Response:\n", "{}</s>\n\n", default_system="Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n"),
    "chatml": Template("<|im_start|>user\n{}<|im_end|>\n<|im_start|>assistant\n", "{}<|im_end|>\n", "<|im_start|>system\n{}<|im_end|>\n", "<|im_start|>tool\n{}<|im_end|>\n<|im_start|>assistant\n"),
    "qwen": Template(
        "<|im_start|>user\n{}<|im_end|>\n<|im_start|>assistant\n", "{}<|im_end|>\n", "<|im_start|>system\n{}<|im_end|>\n", "<|im_start|>user\n<tool_response>\n{}\n</tool_response><|im_end|>\n<|im_start|>assistant\n",
        default_system="You are Qwen, created by Alibaba Cloud. You are a helpful assistant.", dialect="qwen",
    ),
    "llama3": Template(
        "<|start_header_id|>user<|end_header_id|>\n\n{}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", "{}<|eot_id|>", "<|start_header_id|>system<|end_header_id|>\n\n{}<|eot_id|>",
        "<|start_header_id|>ipython<|end_header_id|>\n\n{}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", prefix="<s>", dialect="llama3",
    ),
    "mistral": Template("[INST] {}[/INST]", " {}</s>", "{}\n\n", '[TOOL_RESULTS] {"content": {}}[/TOOL_RESULTS]', "[TOOL_CALLS] {}</s>", prefix="<s>", dialect="mistral"),
}


def filled(slot: str, content: Column) -> Column:
    head, _, tail = slot.rpartition("{}")
    return F.concat(F.lit(head), content, F.lit(tail))


def rendered(turns: Column, template: Template, system: Column | None = None) -> Column:
    """An array with a text for each turn of turns (array of role and content), the first with the prefix and the system's slot in front. Roles are user, assistant, observation and function; another
    one is an error. A null content is empty; system null or empty: the template's own, and without one no slot; no turns: an empty array."""
    whole = F.lit(template.default_system) if system is None else F.coalesce(F.nullif(system, F.lit("")), F.lit(template.default_system))
    front = F.concat(F.lit(template.prefix), F.when(whole == "", "").otherwise(filled(template.system, whole)))
    slots = {"user": template.user, "assistant": template.assistant, "observation": template.observation or template.user, "function": template.function or template.assistant}

    def one(turn: Column, i: Column) -> Column:
        out = F.raise_error(F.concat(F.lit("no slot for the role "), turn["role"])).cast("string")
        for role, slot in slots.items():
            out = F.when(turn["role"] == role, filled(slot, F.coalesce(turn["content"], F.lit("")))).otherwise(out)
        return F.when(i == 0, F.concat(front, out)).otherwise(out)

    return F.transform(turns, one)


Call = tuple[str, str]


def compact(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def plain(value) -> str:
    return value if isinstance(value, str) else compact(value)


def parsed(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def one_call(calls: list[Call]) -> str:
    if len(calls) > 1:
        raise ValueError("this dialect has one call a turn")
    return f"{calls[0][0]}\n{calls[0][1]}"


def listed(key: str, single: bool) -> Callable[[list[Call]], str]:
    def write(calls: list[Call]) -> str:
        out = [{"name": n, key: json.loads(a)} for n, a in calls]
        return compact(out[0] if single and len(out) == 1 else out)

    return write


def of_list(key: str) -> Callable[[str], list[Call]]:
    def read(text: str) -> list[Call]:
        found = json.loads(text.strip())
        return [(x["name"], compact(x[key])) for x in (found if isinstance(found, list) else [found])]

    return read


def matched(pattern: str, read: Callable[[re.Match], Call]) -> Callable[[str], list[Call]]:
    found = re.compile(pattern, re.S)
    return lambda text: [read(m) for m in found.finditer(text)]


def in_tags(m: re.Match) -> Call:
    x = json.loads(m[1].strip())
    return x["name"], compact(x["arguments"])


def by_pairs(pattern: str) -> Callable[[re.Match], Call]:
    return lambda m: (m[1].strip(), compact({k.strip(): parsed(v.strip()) for k, v in re.findall(pattern, m[2], re.S)}))


#: How calls are written in each dialect, and read back; fixed values are the marks around them.
DIALECTS: dict[str, tuple[Callable[[list[Call]], str], Callable[[str], list[Call]]]] = {
    "default": (lambda calls: "\n".join(f"Action: {n}\nAction Input: {a}" for n, a in calls), matched(r"Action:\s*([a-zA-Z0-9_]+)\s*Action Input:\s*(.+?)(?=\s*Action:|\s*$)", lambda m: (m[1].strip(), compact(json.loads(m[2].strip().strip('"`')))))),
    "glm4": (one_call, lambda text: [(text.partition("\n")[0], compact(json.loads(text.partition("\n")[2].strip())))] if "\n" in text else []),
    "llama3": (listed("parameters", True), of_list("parameters")),
    "mistral": (listed("arguments", False), of_list("arguments")),
    "qwen": (lambda calls: "\n".join(f"<tool_call>\n{compact({'name': n, 'arguments': json.loads(a)})}\n</tool_call>" for n, a in calls), matched(r"<tool_call>(.+?)</tool_call>(?=\s*<tool_call>|\s*$)", in_tags)),
    "glm4_moe": (
        lambda calls: "\n".join(f"\n<tool_call>{n}" + "".join(f"\n<arg_key>{k}</arg_key>\n<arg_value>{plain(v)}</arg_value>" for k, v in json.loads(a).items()) + "\n</tool_call>" for n, a in calls),
        matched(r"<tool_call>([^<]*)(.*?)</tool_call>", by_pairs(r"<arg_key>(.*?)</arg_key>\s*<arg_value>(.*?)</arg_value>")),
    ),
    "seed_oss": (
        lambda calls: "\n".join(f"\n<seed:tool_call>\n<function={n}>" + "".join(f"\n<parameter={k}>{plain(v)}</parameter>" for k, v in json.loads(a).items()) + "\n</function>\n</seed:tool_call>" for n, a in calls),
        matched(r"<seed:tool_call>\s*<function=\s*([^\s<>]+)>?\s*(.*?)\s*</function>\s*</seed:tool_call>", by_pairs(r"<parameter=(.*?)>(.*?)</parameter>")),
    ),
}

CALLS = "array<struct<name:string,arguments:string>>"


def written_calls(calls: Column, dialect: str) -> Column:
    """A text of tool calls (array of name and arguments, a JSON object as text) in a dialect. Null for null or no calls, for arguments that are no JSON, and for more calls than the dialect has."""
    write = DIALECTS[dialect][0]

    def run(rows: pd.Series) -> pd.Series:
        def one(calls):
            try:
                return write([(c["name"], c["arguments"]) for c in calls]) if calls is not None and len(calls) else None
            except (ValueError, TypeError):
                return None

        return rows.map(one)

    return F.pandas_udf(run, "string")(calls)


def read_calls(text: Column, dialect: str) -> Column:
    """The tool calls of a text in a dialect, arguments as JSON: the inverse of written_calls(). Empty where it holds none, or one that can't be read; null for null."""
    read = DIALECTS[dialect][1]

    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return None if text is None else [{"name": n, "arguments": a} for n, a in read(text)]
            except (ValueError, KeyError, TypeError):
                return []

        return texts.map(one)

    return F.pandas_udf(run, CALLS)(text)


# ---- tools in a system turn ----------------------------------------------------------------------

#: What a system turn says around its list of tools, by dialect; @tools, @names and @date stand for what is filled in.
TOOLS_SAID = {
    "default": 'You have access to the following tools:\n@toolsUse the following format if using a tool:\n```\nAction: tool name (one of [@names])\nAction Input: the input to the tool, in a JSON format representing the kwargs (e.g. ```{"input": "hello world", "num_beams": 5}```)\n```\n',
    "glm4": "你是一个名为 ChatGLM 的人工智能助手。你是基于智谱 AI 公司训练的语言模型 GLM-4 模型开发的，你的任务是针对用户的问题和要求提供适当的答复和支持。\n\n# 可用工具@tools",
    "llama3": 'Cutting Knowledge Date: December 2023\nToday Date: @date\n\nYou have access to the following functions. To call a function, please respond with JSON for a function call. Respond in the format {"name": function name, "parameters": dictionary of argument name and its value}. Do not use variables.\n\n@tools',
    "mistral": "[AVAILABLE_TOOLS] @tools[/AVAILABLE_TOOLS]",
    "qwen": '\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>@tools\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>',
    "glm4_moe": "\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>@tools\n</tools>\n\nFor each function call, output the function name and arguments within the following XML format:\n<tool_call>{function-name}\n<arg_key>{arg-key-1}</arg_key>\n<arg_value>{arg-value-1}</arg_value>\n<arg_key>{arg-key-2}</arg_key>\n<arg_value>{arg-value-2}</arg_value>\n...\n</tool_call>\n",
    "seed_oss": "system\nYou are Doubao, a helpful AI assistant. You may call one or more functions to assist with the user query.Tool List:\nYou are authorized to use the following tools (described in JSON Schema format). Before performing any task, you must decide how to call them based on the descriptions and parameters of these tools.@tools\n工具调用请遵循如下格式:\n<seed:tool_call>\n<function=example_function_name>\n<parameter=example_parameter_1>value_1</parameter>\n<parameter=example_parameter_2>This is the value for the second parameter\nthat can span\nmultiple lines</parameter>\n</function>\n</seed:tool_call>\n",
}


def bare(tool: dict) -> dict:
    """A tool without the object around it that says that it is a function."""
    return tool["function"] if tool.get("type") == "function" else tool


def wrapped(tool: dict) -> dict:
    return {"type": "function", "function": bare(tool)} if tool.get("type") != "function" else tool


def spelled(tool: dict) -> str:
    """A tool's name, description and arguments in words."""
    form = tool.get("parameters") or {}
    needed, lines = form.get("required") or [], []
    for name, kind in (form.get("properties") or {}).items():
        notes = [kind.get("description", "")]
        if kind.get("enum"):
            notes.append(f", should be one of [{', '.join(map(str, kind['enum']))}]")
        if kind.get("items"):
            notes.append(f", where each item should be {kind['items'].get('type', '')}")
        lines.append(f"  - {name} ({kind.get('type', '')}{', required' if name in needed else ''}): {''.join(notes)}\n")
    return f"> Tool Name: {tool['name']}\nTool Description: {tool.get('description', '')}\nTool Args:\n{''.join(lines)}\n"


def spaced(value) -> str:
    return json.dumps(value, indent=4, ensure_ascii=False)


def by_line(tools: list[dict]) -> str:
    return "".join("\n" + compact(wrapped(x)) for x in tools)


#: How each dialect lists tools within what it says around them.
LISTED: dict[str, Callable[[list[dict]], str]] = {
    "default": lambda tools: "".join(spelled(bare(x)) for x in tools),
    "glm4": lambda tools: "".join(f"\n\n## {bare(x)['name']}\n\n{spaced(bare(x))}\n在调用上述函数时，请使用 Json 格式表示调用的参数。" for x in tools),
    "llama3": lambda tools: "".join(spaced(wrapped(x)) + "\n\n" for x in tools),
    "mistral": lambda tools: compact([wrapped(x) for x in tools]),
    "qwen": by_line,
    "glm4_moe": by_line,
    "seed_oss": lambda tools: "\n" + compact(tools),
}


def described_tools(tools: Column, dialect: str, date: str = "") -> Column:
    """What a system turn says of tools, a JSON array as text of objects with name, description and parameters (a JSON schema),
    each bare or within an object of type "function". It follows the system's own words: first a column said = concat(system, this),
    as a turn's own functions can't call Python, then rendered(turns, template, said).
    An empty array gives the empty text; null, what is no JSON array of objects, and a tool without a name give null. date: the day
    that the llama3 dialect names, so that a query's rows don't change with the day it runs on."""
    said, listing = TOOLS_SAID[dialect].replace("@date", date), LISTED[dialect]

    def run(rows: pd.Series) -> pd.Series:
        def one(text):
            try:
                found = None if text is None else json.loads(text)
                if not isinstance(found, list):
                    return None
                names = ", ".join(bare(x)["name"] for x in found)
                head, _, tail = said.partition("@tools")
                return head + listing(found) + tail.replace("@names", names) if found else ""
            except (ValueError, KeyError, TypeError, AttributeError):
                return None

        return rows.map(one)

    return F.pandas_udf(run, "string")(tools)
