"""From rows to aligned conversations and to token arrays: alignment, truncation, labels, masks, splits. All are column expressions
within a row, or one aggregation; nothing here shuffles but what groups turns."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import infer_lengths, strip

IGNORE = -100
TURN = "array<struct<role:string,content:string>>"


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def alpaca(prompt: Column, query: Column, response: Column, history: Column, tag: Column | None = None, chosen: Column | None = None, rejected: Column | None = None) -> dict[str, Column]:
    """_prompt and _response turns. history: array of (question, answer), turned into user and assistant turns; prompt and query are
    one user turn, its non-empty parts joined by a line end. tag (boolean): the response stands before an empty turn if true, after it if
    false. chosen and rejected: both, in this order. A null response alone: no response."""
    past = F.flatten(F.transform(F.coalesce(history, F.array().cast("array<struct<q:string,a:string>>")), lambda h: F.array(_turn("user", h["q"]), _turn("assistant", h["a"]))))
    filled = F.filter(F.array(prompt, query), lambda x: F.coalesce(x, F.lit("")) != "")
    turns = F.concat(past.cast(TURN), F.array(_turn("user", F.array_join(filled, "\n"))).cast(TURN))
    told, none = F.array(_turn("assistant", response)).cast(TURN), F.array(_turn("assistant", F.lit(""))).cast(TURN)
    if tag is not None:
        out = F.when(tag, F.concat(told, none)).otherwise(F.concat(none, told))
    elif chosen is not None:
        out = F.array(_turn("assistant", chosen), _turn("assistant", rejected)).cast(TURN)
    else:
        out = F.when(response.isNull(), F.array().cast(TURN)).otherwise(told)
    return {"_prompt": turns, "_response": out}


def sharegpt(turns: Column, ranking: bool = False) -> dict[str, Column]:
    """turns: array of (role, content) in order. A leading system turn becomes _system; then user or observation turns must
    alternate with assistant or function turns, in even number (with ranking: odd). Otherwise the example is broken: both parts are empty."""
    first = F.get(turns, F.lit(0))["role"] == "system"
    rest = F.when(F.coalesce(first, F.lit(False)), F.slice(turns, 2, F.greatest(F.size(turns) - 1, F.lit(0)))).otherwise(turns)
    right = F.transform(rest, lambda x, i: F.when(i % 2 == 0, x["role"].isin("user", "observation")).otherwise(x["role"].isin("assistant", "function")))
    fine = F.forall(right, lambda x: F.coalesce(x, F.lit(False))) & (F.size(rest) > 0) & (F.size(rest) % 2 == (1 if ranking else 0))
    none = F.slice(turns, 1, 0)
    body = rest if ranking else F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0)))
    last = none if ranking else F.slice(rest, F.greatest(F.size(rest), F.lit(1)), 1)
    return {"_system": F.when(F.coalesce(first, F.lit(False)), F.get(turns, F.lit(0))["content"]).otherwise(""), "_prompt": F.when(fine, body).otherwise(none), "_response": F.when(fine, last).otherwise(none)}


def valid_example(prompt: Column, response: Column, least: int = 1) -> Column:
    """An odd number of prompt turns, and one response (least = 1) or `least` and more."""
    n = F.size(response)
    return (F.size(prompt) % 2 == 1) & (n == 1 if least == 1 else n >= least)


def truncate_pad(ids: Column, width: int, pad: int, side: str, left_pad: bool = True) -> Column:
    """ids of exactly width: longer ones lose the left, the right or the middle, or are an error; shorter ones are padded."""
    half = width // 2
    cut = {
        "left": lambda: F.slice(ids, F.size(ids) - width + 1, width),
        "right": lambda: F.slice(ids, 1, width),
        "middle": lambda: F.concat(F.slice(ids, 1, half), F.slice(ids, F.size(ids) - (width - half) + 1, width - half)),
        "error": lambda: F.raise_error(F.lit(f"a sequence is longer than {width}")).cast("array<int>"),
    }[side]()
    more = F.array_repeat(F.lit(pad), F.greatest(F.lit(width) - F.size(ids), F.lit(0)))
    return F.when(F.size(ids) > width, cut).otherwise(F.concat(more, ids) if left_pad else F.concat(ids, more))


def supervised(source: Column, target: Column, cut: int, train_on_prompt: bool = False) -> dict[str, Column]:
    """input_ids, labels (the source ignored), attention_mask and position_ids of a pair of id arrays, each cut to its share of `cut`."""
    s, t = infer_lengths(F.size(source), F.size(target), F.lit(cut))
    a, b = F.slice(source, 1, s.cast("int")), F.slice(target, 1, t.cast("int"))
    ids = F.concat(a, b)
    labels = ids if train_on_prompt else F.concat(F.array_repeat(F.lit(IGNORE), F.size(a)), b)
    return {"input_ids": ids, "labels": labels, "attention_mask": F.array_repeat(F.lit(1), F.size(ids)), "position_ids": F.transform(ids, lambda x, i: i)}


def pairwise(prompt: Column, chosen: Column, rejected: Column, cut: int) -> dict[str, Column]:
    """Ids and labels of both answers; the prompt's share is that beside the longer answer."""
    s, t = infer_lengths(F.size(prompt), F.greatest(F.size(chosen), F.size(rejected)), F.lit(cut))
    p = F.slice(prompt, 1, s.cast("int"))
    out = {}
    for name, c in (("chosen", chosen), ("rejected", rejected)):
        answer = F.slice(c, 1, t.cast("int"))
        out |= {f"{name}_input_ids": F.concat(p, answer), f"{name}_labels": F.concat(F.array_repeat(F.lit(IGNORE), F.size(p)), answer)}
    return out


def feedback(prompt: Column, answer: Column, kl_prompt: Column, kl_answer: Column, good: Column, cut: int) -> dict[str, Column]:
    """Ids and labels of an answer, those of a mismatched pair (another row's answer) by which divergence is estimated, and whether the answer is a good one."""
    out = {}
    for name, p, a in (("", prompt, answer), ("kl_", kl_prompt, kl_answer)):
        one = supervised(p, a, cut)
        out |= {f"{name}{k}": one[k] for k in ("input_ids", "labels", "attention_mask")}
    return out | {"kto_tags": good}


def unsupervised(prompt: Column, answer: Column, cut: int) -> dict[str, Column]:
    """Ids of a prompt to answer, and as labels the answer alone: each cut to its share."""
    s, t = infer_lengths(F.size(prompt), F.size(answer), F.lit(cut))
    ids = F.slice(prompt, 1, s.cast("int"))
    return {"input_ids": ids, "labels": F.slice(answer, 1, t.cast("int")), "attention_mask": F.array_repeat(F.lit(1), F.size(ids))}


def block_mask(mask: Column) -> Column:
    """A packed row's attention as rows of 1 and 0: an id sees itself and those before it in its own segment; padding (0) sees and is seen by nothing."""
    return F.transform(mask, lambda x, i: F.transform(mask, lambda y, j: ((x == y) & (x > 0) & (j <= i)).cast("int")))


def turn_mask(turns: Column) -> Column:
    """1 for each id of an assistant's turn, 0 for the others; turns: array of (role, ids)."""
    return F.flatten(F.transform(turns, lambda t: F.array_repeat((t["role"] == "assistant").cast("int"), F.size(t["ids"]))))


def segment_lengths(mask: Column) -> Column:
    """Lengths of a packed row's segments, numbered 1, 2, ..; 0 is padding."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.coalesce(F.array_max(mask), F.lit(0)), F.lit(1))), lambda k: F.size(F.filter(mask, lambda x: x == k)))


def cumulative(lengths: Column) -> Column:
    """0 and the running sums."""
    start = F.array(F.lit(0))
    return F.aggregate(lengths, start, lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))


def discounted_masked(rewards: Column, mask: Column, gamma: float) -> Column:
    """Returns from the end by gamma, begun anew wherever the mask is 0."""
    zero = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("run"))

    def step(acc, x):
        now = x["r"] + gamma * acc["run"]
        return F.struct(F.concat(F.array(now), acc["out"]).alias("out"), (now * x["m"]).alias("run"))

    return F.aggregate(F.reverse(F.zip_with(rewards, mask, lambda r, m: F.struct(r.cast("double").alias("r"), m.cast("double").alias("m")))), zero, step, lambda a: a["out"])


def gae_masked(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages; masked tokens keep what comes after them."""
    zero = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("adv"), F.lit(0.0).alias("next"))

    def step(acc, x):
        adv = x["r"] + gamma * acc["next"] - x["v"] + gamma * lam * acc["adv"]
        adv, nxt = x["m"] * adv + (1 - x["m"]) * acc["adv"], x["m"] * x["v"] + (1 - x["m"]) * acc["next"]
        return F.struct(F.concat(F.array(adv), acc["out"]).alias("out"), adv.alias("adv"), nxt.alias("next"))

    rows = F.zip_with(F.arrays_zip(rewards.alias("r"), values.alias("v")), mask, lambda p, m: F.struct(p["r"].cast("double").alias("r"), p["v"].cast("double").alias("v"), m.cast("double").alias("m")))
    return F.aggregate(F.reverse(rows), zero, step, lambda a: a["out"])


def media_parts(text: Column) -> Column:
    """A text as typed parts: what stands between <image> and <video> tags, and the tags."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(<image>|<video>|(?:(?!<image>|<video>).)+)"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text").alias("type"), F.when(~p.isin("<image>", "<video>"), p).alias("text")))


def slot(template: Column, values: dict[str, Column]) -> Column:
    """A template with the first {{name}} of each name replaced."""
    for name, value in values.items():
        mark = "{{" + name + "}}"
        at = F.instr(template, mark)
        template = F.when(at > 0, F.concat(F.substring(template, F.lit(1), at - 1), value, F.substring(template, at + len(mark), F.length(template)))).otherwise(template)
    return template


def passages(docs: Column) -> Column:
    """`Doc i(Title: title) text` lines of an array of (title, text)."""
    return F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), d["title"], F.lit(") "), d["text"])), "\n")


def tool_calls(text: Column) -> dict[str, Column]:
    """Names and arguments of `<tool_call>` JSON objects, calls that are no JSON with a name left out, and the text without them."""
    raw = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    calls = F.filter(F.transform(raw, lambda c: F.struct(F.get_json_object(c, "$.name").alias("name"), F.get_json_object(c, "$.arguments").alias("arguments"))), lambda c: c["name"].isNotNull())
    return {"calls": calls, "content": strip(F.regexp_replace(text, r"(?s)<tool_call>.*?</tool_call>", ""))}


def folded(df: DataFrame, order: str, size: int, value: str) -> DataFrame:
    """Rows of consecutive `order` numbers folded into arrays of `size`."""
    one = df.groupBy(F.floor(F.col(order) / size).cast("long").alias("fold"))
    return one.agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("values"))


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text by the tokenizer file at `path`, without added special tokens; a null text has none. Whole texts are counted, in Arrow batches; the
    tokenizer is loaded once a worker."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _tokenizer(path)
        for texts in batches:
            parts = [texts.iloc[i : i + 64].fillna("").tolist() for i in range(0, len(texts), 64)]
            yield pd.Series([len(e.ids) for p in parts for e in tokenizer.encode_batch(p, add_special_tokens=False)], dtype="int64")

    return F.pandas_udf(count, "long")(text.cast("string"))


def short_prompts(df: DataFrame, prompt: str, most: int, path: str) -> DataFrame:
    """Rows whose prompt has at most `most` tokens of the tokenizer file at `path`."""
    return df.where(token_count(F.col(prompt), path) <= most)
