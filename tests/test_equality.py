"""Equal and unequal answers, strictly and loosely."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import answers as A
from brindle.functions import equality as Q

#: given, gold, strict, loose
PAIRS = [
    ("3", "3", True, True), ("3.0", "3", True, True), ("1,000", "1000", True, True), ("$5", "5", True, True), ("50\\%", "50", True, True), ("0.5", "50", False, True), ("12 cm", "12", True, True), ("90^\\circ", "90", True, True), ("3 miles", "3", True, True),
    ("\\text{Monday}", "monday", True, True), ("Tuesday", "Monday", False, False), ("5 million", "5000000", False, True), ("1/2", "2/4", False, True), ("1/2", "1/2", True, True), ("\\frac{1}{2}", "\\dfrac12", True, True), ("0.5", "1/2", True, True), ("7 3/4", "31/4", True, True),
    ("2\\frac{1}{2}", "2.5", True, True), ("x+1", "1+x", True, True), ("(x+1)^2", "x^2+2x+1", True, True), ("(x+1)(x-1)", "x**2 - 1", True, True), ("x^2+1", "x^2-1", False, False), ("\\sqrt{8}", "2\\sqrt{2}", True, True), ("\\sqrt[3]{27}", "3", False, True), ("sqrt(2)/2", "1/\\sqrt{2}", True, True),
    ("2\\pi", "6.2831853", False, True), ("2π", "6.28", False, True), ("\\frac{x^2-1}{x-1}", "x+1", True, True), ("1/x", "x", False, False), ("(1,2)", "(1, 2)", True, True), ("(1,2)", "(2,1)", False, False), ("[1,2)", "(1,2)", False, False), ("(1, x+1)", "(1, 1+x)", True, True), ("1,2,3", "1, 2, 3", True, True),
    ("1 and 2", "1 , 2", True, True), ("(1,2,3)", "(1,2)", False, False), ("\\begin{pmatrix}1\\\\2\\end{pmatrix}", "[1,2]", False, True), ("Point(1, 2)", "(1,2)", False, True), ("", "3", False, False), ("a b c + 1", "1 + c b a", False, True), ("3.00001", "3", False, True), ("3.1", "3", False, False), ("-3", "3", False, False), ("- 3", "-3", True, True),
    ("|x-1|", "|1-x|", True, True), ("e^(2x)", "(e^x)^2", True, True), ("\\sin^2", "1", False, False), ("((((", "3", False, False), ("1/0", "1/0 + 1", False, False), ("x", None, False, False), (None, "3", False, False), ("0", "0.0", True, True), ("x - x", "0", False, True), ("2^10", "1024", False, True), ("(-\\infty, 2)", "(-\\infty,2)", True, True),
]


@pytest.mark.parametrize(("given", "gold", "strict", "loose"), PAIRS)
def test_pairs(given, gold, strict, loose):
    assert (Q.same(given, gold), Q.equal(given, gold)) == (strict, loose)


def test_answers_of_responses(spark):
    texts = [("So the answer is 12.", "12"), ("Step 1: a. Step 2: so \\boxed{\\frac{3}{4}}", "0.75"), ("x = 5", "5"), ("We get 7 is the answer", "7"), ("Answer: x+y. Done.", "y+x"), ("nothing", "3"), (None, "3"), ("the answer is 3", None)]
    x = spark.createDataFrame(texts, "text string, gold string")
    g = Q.math_grade(F.col("text"), F.col("gold"))
    got = [(r.correct, r.formatted) for r in x.select(*[c.alias(k) for k, c in g.items()]).collect()]
    assert [c for c, _ in got] == [True, True, True, True, True, False, False, False] and got[1][1]
    s = [r[0] for r in x.select(A.strict_box_score(F.col("text"), F.col("gold"))).collect()]
    assert s == [-1.0] * 8
    y = spark.createDataFrame([("\\boxed{5}", "5"), ("\\boxed{5}" + "." * 100, "5"), ("\\boxed{5.0}", "5"), (None, None)], "text string, gold string")
    assert [r[0] for r in y.select(A.strict_box_score(F.col("text"), F.col("gold"))).collect()] == [1.0, -1.0, -1.0, -1.0]
