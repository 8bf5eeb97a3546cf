"""Rewards by source, from files, and by managers."""

import pytest
from pyspark.sql import functions as F

from brindle.operators import rewards as W


def test_rules_by_source(spark, tmp_path):
    file = tmp_path / "own.py"
    file.write_text("from pyspark.sql import functions as F\n\ndef half(text, gold):\n    return F.when(text == gold, 0.5).otherwise(0)\n")
    own = W.custom(str(file), "half")
    rows = spark.createDataFrame([("a", "x", "x", 5), ("a", "y", "x", 12), ("b", "\\boxed{1}", "1", 12), ("a", None, None, 20), ("c", "1/2", "0.5", 10)], "source string, text string, gold string, length int")
    rules = {"a": own, "b": "box", "c": "equal"}
    assert [r.reward for r in W.rewarded(rows, "naive", rules).collect()] == [0.5, 0.0, 1.0, 0.5, 1.0]
    got = [(r.score, r.penalty, r.reward) for r in W.rewarded(rows, "overlong", rules, most=15, buffer=5).collect()]
    assert got == [(0.5, 0.0, 0.5), (0.0, -0.4, -0.4), (1.0, -0.4, 0.6), (0.5, -2.0, -1.5), (1.0, 0.0, 1.0)]
    x = rows.withColumn("p", F.lit(0.0))
    assert [round(r.reward, 6) for r in W.rewarded(x, "blend", rules, process="p").collect()] == [0.4, 0.0, 0.8, 0.4, 0.8]
    for bad in (("d", "x", "x", 1), (None, "x", "x", 1)):
        with pytest.raises(Exception, match="no rule for"):
            W.rewarded(spark.createDataFrame([bad], rows.schema), "naive", rules).collect()
    assert W.rewarded(rows.limit(0), "naive", rules).count() == 0


def test_what_is_not_there(spark, tmp_path):
    file = tmp_path / "own.py"
    file.write_text("x = 1\n")
    with pytest.raises(AttributeError):
        W.custom(str(file), "half")
    with pytest.raises(FileNotFoundError):
        W.custom(str(tmp_path / "none.py"), "half")
    with pytest.raises(KeyError):
        W.rewarded(spark.range(1), "other", {})
    with pytest.raises(ValueError):
        W.reward("qa")(lambda text, gold: text)
