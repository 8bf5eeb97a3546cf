"""Equality of mathematical answers: text rules, then tuples and intervals part by part, then identity of expressions.

An expression is read by recursive descent (numbers, letters, roots, fractions, powers, brackets, LaTeX or plain) into a function of its
letters. Two are equal if they agree at fixed points of the complex plane, which settles rational functions, roots and the elementary
functions up to chance: no algebra system is needed and no answer takes long. The work is one small function a row, in Arrow batches."""

from __future__ import annotations

import cmath
import math
import random
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .answers import last_box

#: Units that an answer may carry.
UNITS = ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter"]
#: Words for large numbers.
LARGE = {"million": "*10^6", "billion": "*10^9", "trillion": "*10^12"}
#: What an answer follows, and what it stands before, each in the order applied.
BEFORE = ["answer:", "answer is", "answers are"]
AFTER = ["is answer", "is the answer", "are answers", "are the answers"]
LAST = ["be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n"]
#: Of numbers, relative; and of expressions at a point.
LOOSE, CLOSE = 1e-4, 1e-9

FUNCTIONS = {"sqrt": cmath.sqrt, "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "log": cmath.log, "ln": cmath.log, "exp": cmath.exp}
TOKEN = re.compile(r"\s*(\d+(?:\.\d+)?|\.\d+|\\?[a-z]+|\*\*|[-+*/^(){}|\[\]!_])", re.I)
SIGNS = {"√": "sqrt", "π": "pi", "·": "*", "×": "*", "÷": "/", "−": "-", "\\cdot": "*", "\\times": "*", "\\div": "/", "\\left": "", "\\right": "", "\\!": "", "\\,": "", "\\;": "", "\\ ": " ", "\\dfrac": "\\frac", "\\tfrac": "\\frac", "**": "^"}


class Unread(ValueError):
    """A text that is no expression."""


class Reader:
    """A text's tokens and, from them, functions of an environment (letter -> number)."""

    def __init__(self, text: str):
        for k, v in SIGNS.items():
            text = text.replace(k, v)
        text = re.sub(r"(\d) +(\d+ */ *\d)", r"\1+\2", text)  # a mixed number
        text = re.sub(r"(\d)\s*(\\frac\{?\d)", r"\1+\2", text)
        text = re.sub(r"\\frac\s*(\d)\s*(\d)", r"\\frac{\1}{\2}", text)
        self.tokens, self.at, self.letters = [], 0, set()
        where = 0
        while where < len(text.rstrip()):
            m = TOKEN.match(text, where)
            if not m:
                raise Unread(text)
            word = m[1].lower()
            named = word.lstrip("\\") in FUNCTIONS or word in ("pi", "\\pi", "\\frac")
            # letters side by side are factors
            self.tokens += [word.lstrip("\\") if word != "\\frac" else word] if named or not word[-1].isalpha() else self._apart(word)
            where = m.end()
        self.tokens.append("")

    def _apart(self, word: str) -> list[str]:
        if word.startswith("\\"):
            raise Unread(word)
        out, at = [], 0
        while at < len(word):
            name = next((f for f in (*FUNCTIONS, "pi") if word.startswith(f, at)), word[at])
            out.append(name)
            at += len(name)
        return out

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def want(self, closing: str) -> None:
        if self.take() != closing:
            raise Unread(f"{closing} is missing")

    def whole(self) -> Callable[[dict], complex]:
        out = self.total()
        if self.tokens[self.at]:
            raise Unread(self.tokens[self.at])
        return out

    def total(self):
        out = self.product()
        while self.tokens[self.at] in ("+", "-"):
            sign, left, right = (1 if self.take() == "+" else -1), out, self.product()
            out = lambda e, a=left, b=right, s=sign: a(e) + s * b(e)
        return out

    def product(self):
        out = self.signed()
        while self.tokens[self.at] not in ("", "+", "-", ")", "}", "]", "|"):
            divide = False
            if self.tokens[self.at] in ("*", "/"):
                divide = self.take() == "/"
            left, right = out, self.signed()
            out = (lambda e, a=left, b=right: a(e) / b(e)) if divide else (lambda e, a=left, b=right: a(e) * b(e))
        return out

    def signed(self):
        if self.tokens[self.at] in ("+", "-"):
            sign, inner = (1 if self.take() == "+" else -1), self.signed()
            return lambda e: sign * inner(e)
        return self.power()

    def power(self):
        base = self.atom()
        if self.tokens[self.at] == "^":
            self.take()
            up = self.signed()
            return lambda e: base(e) ** up(e)
        return base

    def group(self):
        """An argument: a group in braces, or one token."""
        if self.tokens[self.at] == "{":
            self.take()
            out = self.total()
            self.want("}")
            return out
        return self.atom()

    def atom(self):
        t = self.take()
        if t in ("(", "{"):
            out = self.total()
            self.want(")" if t == "(" else "}")
            return out
        if t == "|":
            out = self.total()
            self.want("|")
            return lambda e: complex(abs(out(e)))
        if t == "\\frac":
            a, b = self.group(), self.group()
            return lambda e: a(e) / b(e)
        if t == "sqrt" and self.tokens[self.at] == "[":
            self.take()
            n = self.total()
            self.want("]")
            v = self.group()
            return lambda e: v(e) ** (1 / n(e))
        if t in FUNCTIONS:
            f, v = FUNCTIONS[t], self.group()
            return lambda e: f(v(e))
        if t == "pi":
            return lambda e: e.get("pi", math.pi)
        if t and t[0] in ".0123456789":
            v = float(t)
            return lambda e: v
        if len(t) == 1 and t.isalpha():
            self.letters.add(t)
            return lambda e: e[t]
        raise Unread(t)


def points(letters: set[str]) -> list[dict[str, complex]]:
    """Fixed points: the same for the same letters."""
    rng = random.Random(7)
    return [{c: complex(rng.uniform(0.5, 2.5), rng.uniform(-1, 1)) for c in sorted(letters)} for _ in range(6 if letters else 1)]


def identical(a: str, b: str, close: float, pi: float = math.pi, most: int = 26) -> bool:
    """Whether two expressions are equal wherever both have a value (and one point at least gives them one); with letters beyond `most`, never."""
    try:
        x, y = Reader(a), Reader(b)
        f, g = x.whole(), y.whole()
    except (Unread, RecursionError, IndexError):
        return False
    letters, met = x.letters | y.letters, 0
    if len(letters) > most:
        return False
    for at in points(letters):
        try:
            u, v = f(at | {"pi": pi}), g(at | {"pi": pi})
        except (ZeroDivisionError, OverflowError, ValueError):
            continue
        met += 1
        if not abs(u - v) <= close * max(1.0 if letters else abs(v), abs(v)):
            return abs(u) == abs(v) == 0
    return met > 0


def commas(text: str) -> str:
    """Without thousands commas."""
    while (shorter := re.sub(r"(\d),(\d\d\d)(?!\d)", r"\1\2", text)) != text:
        text = shorter
    return text


def normal(text: str) -> str:
    """An answer without wrapper, signs of money and per cent, units, degrees, spaces in signs and letter case."""
    m = re.fullmatch(r"\\text\{(.+?)\}", text)
    text = (m[1] if m else text).replace("\\%", "").replace("\\$", "").replace("$", "").replace("%", "").replace(" or ", " , ").replace(" and ", " , ")
    for word, power in LARGE.items():
        text = text.replace(word, power)
    for unit in UNITS:
        text = re.sub(rf"{unit}(es)?(s)? *(\^[0-9]+)?", "", text)
    text = re.sub(r"\^ *(\\circ|\{\\circ\})", "", text).strip()
    text = text[1:-1] if len(text) > 1 and text[0] == "{" and text[-1] == "}" else text
    text = re.sub("- +", "-", re.sub(r",\\! *", "", text)).lower().strip()
    return str(int(float(commas(text)))) if whole(text) else text


def number(text: str) -> float | None:
    try:
        return float(commas(text.strip().rstrip("%")).replace(" ", "")) / (100 if text.strip().endswith("%") else 1)
    except ValueError:
        return None


def whole(text: str) -> bool:
    v = number(text) if not text.strip().endswith("%") else None
    return v is not None and math.isfinite(v) and abs(v - round(v)) <= 1e-7


def parts(text: str) -> tuple[str, list[str], str]:
    """Opening, elements and closing of a tuple, interval or list; a text that is none is its own one element."""
    text = commas(text)
    if len(text) > 2 and text[0] in "([" and text[-1] in ")]" and not set("()[]") & set(text[1:-1]):
        return text[0], [x.strip() for x in text[1:-1].split(",")], text[-1]
    return "", [text], ""


FRACTION = re.compile(r"-?\d+\s*/\s*0*[1-9]\d*|-?\\frac\{\d+\}\{\d+\}")


def same(given: str | None, gold: str | None) -> bool:
    """Strictly: equal texts after normal(), or equal element by element in equal brackets. A fraction must be the gold one as it is written, a whole number is
    equal to a whole number only, and an expression of over two letters only to its own text."""
    if given is None or gold is None:
        return False
    a, b = normal(given), normal(gold)
    if a.replace(" ", "") == b.replace(" ", ""):
        return True
    if not a:
        return False
    (o, xs, c), (p, ys, d) = parts(a), parts(b)
    if len(xs) != len(ys) or (len(ys) > 1 and (o, c) != (p, d)):
        return False
    for x, y in zip(xs, ys, strict=True):
        if FRACTION.fullmatch(x) and FRACTION.fullmatch(y):
            if x.replace(" ", "") != y.replace(" ", ""):
                return False
        elif whole(x) != whole(y) or not (x == y or identical(x, y, CLOSE, most=2)):
            return False
    return True


def alike(given: str | None, gold: str | None, pi: float = math.pi, percent: bool = True) -> bool:
    """Loosely: numbers within LOOSE of the gold one (or a hundredth or a hundred times it), lists by elements whatever their brackets unless both are given
    and differ, matrices as lists, other expressions by identity."""
    if given is None or gold is None:
        return False
    a, b = given.strip(), gold.strip()
    if a.lower() == b.lower() or a.replace(" ", "") == b.replace(" ", ""):
        return True
    x, y = number(a), number(b)
    if x is not None and y is not None:
        return any(math.isclose(v, x, rel_tol=LOOSE) for v in ([y / 100, y, y * 100] if percent else [y]))
    a, b = listed(a), listed(b)
    (o, xs, c), (p, ys, d) = parts(a), parts(b)
    if len(xs) == len(ys) > 1 and (not o or not p or (o, c) == (p, d)):
        return all(alike(x, y, pi, percent) for x, y in zip(xs, ys, strict=True))
    if len(xs) != len(ys) or o != p and o and p:
        return False
    if "," in xs[0] and "," in ys[0]:
        us, vs = top_level(xs[0]), top_level(ys[0])
        return len(us) == len(vs) > 1 and all(alike(u, v, pi, percent) for u, v in zip(us, vs, strict=True))
    return identical(normal(xs[0]), normal(ys[0]), LOOSE, pi)


def listed(text: str) -> str:
    """A matrix or `Point(..)` as a list in brackets."""
    m = re.fullmatch(r"\\begin\{[pb]?matrix\}(.*)\\end\{[pb]?matrix\}", text, re.S)
    if m:
        return "[" + ",".join(x.strip() for row in re.split(r"\\\\", m[1]) for x in row.split("&")) + "]"
    m = re.fullmatch(r"Point(?:2D|3D)?\((.*)\)", text)
    if m:
        return f"({m[1]})"
    m = re.fullmatch(r"Matrix\((.*)\)", text)
    return "[" + re.sub(r"[\[\]]", "", m[1]) + "]" if m else text


def top_level(text: str) -> list[str]:
    """Split at commas outside of brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def equal(given: str | None, gold: str | None) -> bool:
    """same(), or alike() with pi, and with 3.14 for it where either names it."""
    return same(given, gold) or alike(given, gold) or ("pi" in f"{given}{gold}".replace("π", "pi") and alike(given, gold, 3.14))


def _udf(f: Callable[[str | None, str | None], bool]):
    def run(given: pd.Series, gold: pd.Series) -> pd.Series:
        return pd.Series([f(a, b) for a, b in zip(given, gold, strict=True)], dtype=bool)

    return F.pandas_udf(run, "boolean")


def math_equal(given: Column, gold: Column, strict: bool = False) -> Column:
    """Whether an answer equals the gold one: equal(), or same() if strict. A null on either side is unequal."""
    return _udf(same if strict else equal)(given, gold)


def given_answer(text: str | None) -> str | None:
    """What a response gives as its answer: after the last of BEFORE, before the last of AFTER, in its last box, up to its last full stop, after the last of LAST."""
    if text is None:
        return None

    def after(text: str, marks: list[str]) -> str:
        for m in marks:
            head, found, tail = text.lower().rpartition(m)
            text = text[len(head) + len(m) :].strip() if found else text
        return text

    text = after(text, BEFORE)
    for m in AFTER:
        head, found, _ = text.lower().rpartition(m)
        text = text[: len(head)].strip() if found else text
    text = (last_box(text) or "").strip() or text
    return after(text.rpartition(". ")[0].strip() or text, LAST)


def final_answer(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(given_answer, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def math_grade(text: Column, gold: Column) -> dict[str, Column]:
    """correct, formatted (correct at once by the strict rule, or with `Step 2:` and a box) and answer of a response."""
    answer = final_answer(text)
    strict, form = math_equal(answer, gold, strict=True), F.contains(text, F.lit("Step 2:")) & F.contains(text, F.lit("\\box"))
    return {"correct": math_equal(answer, gold), "formatted": strict | form, "answer": answer}
