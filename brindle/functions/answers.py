"""Prompts, answers and their scores as column expressions; only the grading of nested braces goes through Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import exact_match, extract_answer, numeric, qa_normal, split_solution, strip


def answer_or_label(text: Column) -> Column:
    """extract_answer(), else what follows the first `Answer:` up to `<` or the line's end."""
    found = extract_answer(text)
    return F.when(found != "", found).otherwise(strip(F.regexp_extract(text, r"Answer:([^<\n]*)", 1)))


def loose_number(text: Column) -> Column:
    """numeric(), else the last number of the text."""
    found = F.regexp_extract_all(F.regexp_replace(text, r"(?<=\d),(?=\d{3})", ""), F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1))
    return F.coalesce(numeric(text), F.try_element_at(found, F.lit(-1)).try_cast("double"))


def whole_number(text: Column) -> Column:
    """`true` and `false` as 1 and 0, a number without a fraction as a whole one; else null."""
    value = text.try_cast("double")
    return F.when(F.lower(text) == "true", 1).when(F.lower(text) == "false", 0).when(value == F.floor(value), value).cast("long")


def plain_number(value: Column) -> Column:
    """A value within 1e-9 of a whole number as that, as text."""
    return F.when(F.abs(value - F.round(value)) < 1e-9, F.round(value).cast("long").cast("string")).otherwise(value.cast("string"))


def gsm8k_flexible(text: Column) -> Column:
    """The last number of the last 300 characters that is not only a dot or empty; null if none."""
    found = F.regexp_extract_all(F.right(text, F.lit(300)), F.lit(r"(\-?[0-9\.\,]+)"), F.lit(1))
    return F.try_element_at(F.filter(found, lambda x: ~x.isin("", ".")), F.lit(-1))


#: What graders replace, in the order applied.
REPLACED = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), (r"\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
#: What graders leave out, in the order applied.
LEFT_OUT = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples",
    "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", r"\mathrm{th}", r"^\circ", r"^{\circ}", r"\;", r",\!", "{,}", '"', "\\dots",
]


def minerva_normal(text: Column) -> Column:
    """The side after the last `=`, without REPLACED and LEFT_OUT, dollars, text, bold, line and box wrappers and thousands commas; short roots and fractions with braces."""
    t = F.element_at(F.split(text, "="), -1)
    for old, new in [*REPLACED, *((x, "") for x in LEFT_OUT)]:
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.regexp_replace(t, r".*?\$(.*?)\$.*", r"\$$1\$")
    for wrapper in ("text", "textbf", "overline"):
        t = F.regexp_replace(t, rf"\\{wrapper}\{{(.*?)\}}", "$1")
    t = F.regexp_replace(t, r"\\boxed\{(.*)\}", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"frac([^{])(.)", r"frac{$1}{$2}"), r"sqrt([^{])", r"sqrt{$1}")
    t = F.trim(F.replace(t, F.lit("$"), F.lit("")))
    return F.when(t.rlike(r"^[\d,]*\d[\d,]*$"), F.replace(t, F.lit(","), F.lit(""))).otherwise(t)


def minerva_score(text: Column, gold: Column) -> Column:
    """1 if what follows the last `Answer:` of the last 300 characters equals gold after normalising, else -1."""
    found = F.regexp_extract_all(F.right(text, F.lit(300)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
    return F.when(minerva_normal(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("[INVALID]"))) == minerva_normal(gold), 1.0).otherwise(-1.0)


def last_box(text: str | None) -> str | None:
    """The inside of the last \\boxed{..}, braces matched."""
    at = (text or "").rfind("\\boxed{")
    depth, out = 0, []
    for c in (text or "")[at + 6 :] if at >= 0 else "":
        depth += (c == "{") - (c == "}")
        out.append(c)
        if not depth:
            return "".join(out)[1:-1]
    return None


def boxed(text: Column) -> Column:
    def run(t: pd.Series) -> pd.Series:
        return t.map(last_box)

    run.__annotations__ = {"t": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(text)


def strict_box_score(text: Column, gold: Column, last: int = 100) -> Column:
    """1 if the last box within the text's last so many characters holds gold as it is written, else -1."""
    return F.when(F.coalesce(boxed(F.right(text, F.lit(last))) == gold, F.lit(False)), 1.0).otherwise(-1.0)


def latex_normal(text: Column) -> Column:
    """Without blanks, sizes, dollars, degrees, per cent and text units; one-digit \\frac and \\sqrt with braces; a/b as \\frac; 0 before a dot."""
    t = F.regexp_replace(text, r"\n|\\!|\\left|\\right|\\\$|\$|\^\{\\circ\}|\^\\circ|\\%|%", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\\\\", r"\\"), r"\\[td]frac", r"\\frac")
    t = F.regexp_replace(t, r"\\text\{ [^}]*\}$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(^|\{)\.", "$10."), r"\\sqrt(\w)", r"\\sqrt{$1}")
    t = F.regexp_replace(F.regexp_replace(t, r"\s", ""), r"\\frac(\w)(\w)", r"\\frac{$1}{$2}")
    t = F.when(F.size(F.split(t, "=")) == 2, F.when(F.length(F.split(t, "=")[0]) <= 2, F.split(t, "=")[1]).otherwise(t)).otherwise(t)
    t = F.when(t == "0.5", r"\frac{1}{2}").otherwise(t)
    return F.regexp_replace(t, r"^(-?\d+)/(\d+)$", r"\\frac{$1}{$2}")


def math_score(text: Column, gold: Column) -> Column:
    """1 if the last box holds what equals gold after latex_normal(), else 0."""
    return F.coalesce(latex_normal(boxed(text)) == latex_normal(gold), F.lit(False)).cast("double")


def qa_score(text: Column, golds: Column, inside: bool = False, good: float = 1.0) -> Column:
    """good if the last <answer> normalises to one of golds (inside: holds one), a quarter of it after more than ten tags; else 0."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))
    last = qa_normal(F.try_element_at(found, F.lit(-1)))
    same = F.exists(golds, lambda g: F.contains(last, qa_normal(g)) if inside else last == qa_normal(g))
    tags = F.regexp_count(text, F.lit("<answer>"))
    return F.when(F.coalesce(same, F.lit(False)), F.when(tags > 10, good / 4).otherwise(good)).otherwise(0.0)


def thought_score(text: Column, gold: Column) -> Column:
    """0.9 for the right answer in a box and 0.1 for a `<think>..</think>` before it."""
    form = text.rlike(r"(?s)^.*<think>.*</think>.*\\boxed\{.*\}.*$").cast("double")
    return 0.9 * F.coalesce(boxed(text) == gold, F.lit(False)).cast("double") + 0.1 * form


def code_block(text: Column) -> Column:
    """What the last fenced python block holds; the last fenced block of any kind where none is python's; else the text."""
    last = lambda kind: F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?s)```{kind}\n(.*?)```"), F.lit(1)), F.lit(-1))
    return F.coalesce(last("python"), last(r"\w*"), text)


def pass_rate(results: Column, first: int | None = None) -> Column:
    """The share of passed tests, of the first so many if asked for."""
    some = F.slice(results, 1, first) if first else results
    return F.coalesce(F.try_divide(F.size(F.filter(some, lambda x: x)), F.size(some)), F.lit(0.0))


def score_by_source(source: Column, text: Column, gold: Column) -> Column:
    """The score of each data source's rule; an unknown source is an error."""
    rules = {"gsm8k": exact_match(gold, F.coalesce(gsm8k_flexible(text), F.lit(""))).cast("double"), "qa": qa_score(text, F.array(gold)), "dapo": minerva_score(text, gold)}
    out = F.raise_error(F.concat(F.lit("no rule for "), source)).cast("double")
    for name, rule in rules.items():
        out = F.when(source == name, rule).otherwise(out)
    return out


def symbolic_variables(text: Column) -> Column:
    """The distinct V1, V2, .. of a text, sorted: equal sets are equal arrays."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(V\d+)\b"), F.lit(1))))


def compose_prompt(problem: Column, question: Column, solution: Column, answer: Column) -> tuple[Column, Column]:
    """`<question> p q </question> <solution>`, and the gold answer: the solution's, else the answer without trailing dots."""
    pq = F.concat_ws(" ", F.nullif(strip(F.coalesce(problem, F.lit(""))), F.lit("")), F.nullif(strip(F.coalesce(question, F.lit(""))), F.lit("")))
    _, found = split_solution(solution)
    return F.concat(F.lit("<question> "), pq, F.lit(" </question> <solution>")), F.when(found != "", found).otherwise(F.regexp_replace(strip(F.coalesce(answer, F.lit(""))), r"\.+$", ""))


def prompt_of(sequence: Column) -> Column:
    """What stands before the first <solution>, and that tag."""
    return F.concat(F.substring_index(sequence, "<solution>", 1), F.lit("<solution>"))


def problem_of(sequence: Column) -> Column:
    return strip(F.regexp_extract(sequence, r"(?s)<question>(.*?)</question>", 1))


def pick_text(*preferred: Column) -> Column:
    """The first of the columns that is not blank."""
    return F.coalesce(*[F.when(strip(c) != "", c) for c in preferred])


def path_parts(path: Column) -> dict[str, Column]:
    """context, difficulty and op of `../context/difficulty/opN..`."""
    parts = F.split(path, "/")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    return {"context": at(-3), "difficulty": at(-2), "op": F.regexp_extract(at(-1), r"(\d+)", 1).try_cast("int")}


#: What leads to an answer, in the order tried, and what ends it (None: the first letter that is no digit).
SCANNED = [
    ("answer: ", "."),
    ("solution: ", "."),
    ("oxed{", "}"),
    ("**answer:** ", "."),
    ("**answer: ", "**"),
    ("final answer: answer: ", "."),
    ("\nanswer: ", "."),
    (r"\text{answer: } ", None),
    ("is ", "."),
    ("answer: ", "\n"),
]
#: Those of them whose last place counts; of the others the first does.
LAST = {"oxed{", "is "}


def scanned_answer(text: Column) -> Column:
    """The whole number that follows the first of SCANNED to be followed by one, in lower case; null if there is none."""
    low = F.lower(text)
    tries = []
    for lead, end in SCANNED:
        at = F.locate(lead, low)
        rest = F.substring_index(low, lead, -1) if lead in LAST else F.substring(low, at + len(lead), F.length(low))
        value = F.regexp_extract(rest, r"^\d*", 0) if end is None else F.substring_index(rest, end, 1)
        tries.append(F.when((at > 0) & value.rlike(r"^\s*[+-]?\d+\s*$"), strip(value).try_cast("long")))
    return F.coalesce(*tries)


def prompt_key(value: Column) -> Column:
    """A JSON object or list with sorted keys and without spaces, so that equal ones are equal texts; other texts as they are."""
    parsed = F.to_json(F.try_parse_json(value))
    return F.when(value.rlike(r"^\s*[{\[]") & parsed.isNotNull(), parsed).otherwise(value)
