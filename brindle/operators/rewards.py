"""Rewards by name: functions of an answer and its gold answer, and managers that choose and combine them row by row."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import answers as N
from brindle.functions.equality import math_equal
from brindle.functions.text import exact_match
from brindle.operators.advantage import overlong_penalty

Reward = Callable[[Column, Column], Column]
REWARDS: dict[str, Reward] = {}
MANAGERS: dict[str, Callable[..., DataFrame]] = {}


def reward(name: str) -> Callable[[Reward], Reward]:
    """Registers a reward; a name that is taken by another is an error."""

    def put(f: Reward) -> Reward:
        if REWARDS.get(name, f) is not f:
            raise ValueError(f"there is a reward {name}")
        REWARDS[name] = f
        return f

    return put


def manager(name: str):
    def put(f):
        if MANAGERS.get(name, f) is not f:
            raise ValueError(f"there is a manager {name}")
        MANAGERS[name] = f
        return f

    return put


reward("gsm8k")(lambda text, gold: exact_match(gold, F.coalesce(N.gsm8k_flexible(text), F.lit(""))).cast("double"))
reward("qa")(lambda text, gold: N.qa_score(text, F.array(gold)))
reward("dapo")(N.minerva_score)
reward("math")(N.math_score)
reward("box")(N.strict_box_score)
reward("equal")(lambda text, gold: math_equal(text, gold).cast("double"))


def custom(path: str, name: str) -> Reward:
    """The function `name` of a Python file: (text, gold) columns -> a column. A file or function that is not there is an error."""
    spec = importlib.util.spec_from_file_location("custom_reward", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name}")
    return getattr(module, name)


def by_source(source: Column, text: Column, gold: Column, rules: dict[str, str | Reward]) -> Column:
    """Each row's reward by the rule of its source (a registered name or a function); a source without a rule is an error, as is a null one. Null texts and golds are empty."""
    text, gold = F.coalesce(text, F.lit("")), F.coalesce(gold, F.lit(""))
    out = F.raise_error(F.concat(F.lit("no rule for "), F.coalesce(source, F.lit("null")))).cast("double")
    for name, rule in rules.items():
        out = F.when(source == name, (REWARDS[rule] if isinstance(rule, str) else rule)(text, gold).cast("double")).otherwise(out)
    return out


@manager("naive")
def naive(rows: DataFrame, rules: dict[str, str | Reward], source: str = "source", text: str = "text", gold: str = "gold") -> DataFrame:
    """rows with reward."""
    return rows.withColumn("reward", by_source(F.col(source), F.col(text), F.col(gold), rules))


@manager("overlong")
def overlong(rows: DataFrame, rules: dict[str, str | Reward], most: int, buffer: int, factor: float = 1.0, length: str = "length", **columns: str) -> DataFrame:
    """rows with score, penalty (0, falling to -factor over the last `buffer` of `most` tokens) and reward, their sum."""
    x = naive(rows, rules, **columns).withColumnRenamed("reward", "score")
    x = x.withColumn("penalty", overlong_penalty(F.col(length), most, buffer, factor))
    return x.withColumn("reward", F.col("score") + F.col("penalty"))


@manager("blend")
def blend(rows: DataFrame, rules: dict[str, str | Reward], process: str, share: float = 0.2, **columns: str) -> DataFrame:
    """rows with score and reward: share of the process reward in a column, the rest the score; 0 where the score is not above 0."""
    x = naive(rows, rules, **columns).withColumnRenamed("reward", "score")
    return x.withColumn("reward", F.when(F.col("score") > 0, share * F.col(process) + (1 - share) * F.col("score")).otherwise(0.0))


def rewarded(rows: DataFrame, how: str, rules: dict[str, str | Reward], **options) -> DataFrame:
    """rows with reward by the manager named."""
    if how not in MANAGERS:
        raise KeyError(how)
    return MANAGERS[how](rows, rules, **options)
