"""Column functions over problem texts, answers and generations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Trims all white space (trim() takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def split_solution(solution: Column) -> tuple[Column, Column]:
    """(body, answer) around the last `Answer:`; the answer is its first line without trailing dots."""
    s = F.coalesce(solution, F.lit(""))
    has = s.contains("Answer:")
    tail = F.substring_index(s, "Answer:", -1)
    body = F.when(has, strip(F.substring(s, F.lit(1), F.length(s) - F.length(tail) - 7))).otherwise(strip(s))
    answer = F.when(has, F.regexp_replace(strip(F.split(strip(tail), "\n")[0]), r"\.+$", "")).otherwise("")
    return body, answer


def compose_text(problem: Column, question: Column, solution: Column) -> Column:
    """`<question> p q </question> <solution> b </solution> <answer> a </answer>` without empty parts."""
    body, answer = split_solution(solution)
    pq = F.trim(F.concat_ws(" ", F.nullif(strip(F.coalesce(problem, F.lit(""))), F.lit("")), F.nullif(strip(F.coalesce(question, F.lit(""))), F.lit(""))))
    part = lambda tag, c: F.when(c != "", F.concat(F.lit(f"<{tag}> "), c, F.lit(f" </{tag}>")))
    return F.concat_ws(" ", part("question", pq), part("solution", body), part("answer", answer))


def extract_answer(text: Column) -> Column:
    """The first closed answer tag, else what follows the last open one up to `<` or the line's end."""
    closed = F.regexp_extract(text, r"(?is)<answer>(.*?)</answer>", 1)
    opened = F.regexp_extract(text, r"(?is).*<answer>([^<\n]*)", 1)
    return strip(F.when(text.rlike(r"(?is)<answer>.*?</answer>"), closed).otherwise(opened))


def numeric(text: Column) -> Column:
    """A fraction, or a number with thousands commas, as a double; null otherwise."""
    t = F.regexp_replace(strip(text), r"\.+$", "")
    plain = F.regexp_replace(t, ",", "")
    fraction = t.rlike(r"^-?\d+\s*/\s*\d+$")
    num, den = F.regexp_extract(t, r"^(-?\d+)", 1).try_cast("double"), F.regexp_extract(t, r"(\d+)$", 1).try_cast("double")
    return F.when(fraction, F.try_divide(num, den)).when(plain.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))


def exact_match(gold: Column, pred: Column) -> Column:
    """Both numeric: relative tolerance 1e-8; else equal texts without trailing dots."""
    a, b = numeric(gold), numeric(pred)
    close = F.abs(a - b) <= 1e-8 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    text = lambda c: F.regexp_replace(strip(c), r"\.+$", "")
    return F.when(a.isNotNull() & b.isNotNull(), close).otherwise(text(gold) == text(pred)).cast("int")


def gsm8k_answer(text: Column) -> Column:
    """The last `#### number` of the last 300 characters, without commas and dollars; null if none."""
    found = F.regexp_extract_all(F.right(text, F.lit(300)), F.lit(r"#### (-?[0-9.,]+)"), F.lit(1))
    return F.regexp_replace(F.try_element_at(found, F.lit(-1)), r"[,$]", "")


def qa_normal(text: Column) -> Column:
    """Lower case without punctuation and articles, single spaces."""
    t = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    words = F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin("a", "an", "the")), " ")


def size_of(text: Column) -> Column:
    """`0.5B`, `3K`, `7` as a number."""
    t = F.upper(F.trim(text))
    unit = F.when(t.endswith("K"), 1e3).when(t.endswith("M"), 1e6).when(t.endswith("B"), 1e9).otherwise(1.0)
    return F.round(F.regexp_replace(t, "[KMB]$", "").try_cast("double") * unit).cast("long")


def infer_lengths(source: Column, target: Column, cut: Column) -> tuple[Column, Column]:
    """Lengths of source and target that fit the cut: a short side stays whole, else in proportion."""
    most = F.when(target * 2 < cut, cut).when(source * 2 < cut, cut - source).otherwise(F.floor(cut * (target / (source + target))))
    new_target = F.least(most, target)
    return F.least(F.greatest(cut - new_target, F.lit(0)), source), new_target


def categorize(op: Column, threshold: float | None) -> Column:
    """`ood` above the threshold; without either of the two `id`."""
    return F.when(op > threshold, "ood").otherwise("id") if threshold is not None else F.lit("id")


def result_line(line: Column) -> dict[str, Column]:
    """Fields of `length: L, op: N, acc: A[, template: T, mode: M, num_examples: K]` (N: for op: too)."""
    part = lambda name: F.nullif(F.regexp_extract(line, rf"(?:^|, *)(?:{name}): *([^,]*)", 1), F.lit(""))
    kinds = {"length": ("length", "int"), "n": ("op|N", "int"), "accuracy": ("acc", "double"), "template": ("template", "string"), "mode": ("mode", "string"), "num_examples": ("num_examples", "int")}
    return {k: strip(part(name)).try_cast(kind) for k, (name, kind) in kinds.items()}


def render_chat(turns: Column, slots: dict[str, str]) -> Column:
    """Turns (array of role and content) as one text: a role's slot with the content in place of `{}`.
    Turns of a role without a slot are left out."""
    def one(turn):
        out = F.lit(None).cast("string")
        for role, slot in slots.items():
            head, tail = slot.split("{}")
            out = F.when(turn["role"] == role, F.concat(F.lit(head), turn["content"], F.lit(tail))).otherwise(out)
        return out

    return F.array_join(F.transform(turns, one), "")


def few_shot(question: Column, choices: dict[str, Column], answer: Column | None = None) -> Column:
    """A multiple-choice question as text: the question, a line a choice, `Answer:` and, of an example, its answer."""
    lines = [question, *[F.concat(F.lit(f"{k}. "), c) for k, c in choices.items()], F.concat(F.lit("Answer: "), answer) if answer is not None else F.lit("Answer:")]
    return F.concat_ws("\n", *lines)


def corpus_line(problem: Column, question: Column, solution: Column) -> Column:
    """A line for a tokenizer's corpus: `[BOS] <question> p q </question> <solution> b </solution> <answer> a </answer> [EOS]`. The first two pairs of tags
    stand even around nothing, the answer's only around an answer. Other than in compose_text(), the answer loses dots and white space
    at its end together, and the body white space at its end alone."""
    whole = lambda c: strip(F.coalesce(c, F.lit("")))
    s, none = whole(solution), F.lit("")
    has, tail = s.contains("Answer:"), F.substring_index(s, "Answer:", -1)
    body = F.when(has, F.regexp_replace(F.substring(s, F.lit(1), F.length(s) - F.length(tail) - 7), r"\s+$", "")).otherwise(s)
    answer = F.when(has, F.regexp_replace(strip(F.split(strip(tail), "\n")[0]), r"[\s.]*$", ""))
    pq = strip(F.concat(whole(problem), F.lit(" "), whole(question)))
    part = lambda tag, c: [F.lit(f"<{tag}>"), F.nullif(c, none), F.lit(f"</{tag}>")]
    last = F.when(answer != "", F.concat(F.lit("<answer> "), answer, F.lit(" </answer>")))
    return F.concat_ws(" ", F.lit("[BOS]"), *part("question", pq), *part("solution", body), last, F.lit("[EOS]"))


def complete(*fields: Column) -> Column:
    """Whether none of the fields is null or blank: the strict form of compose_text() takes only such rows."""
    out = F.lit(True)
    for f in fields:
        out = out & (strip(F.coalesce(f, F.lit(""))) != "")
    return out
