"""What joins send around."""

from pyspark.sql import functions as F

from brindle.operators import generate as N
from tests.test_generated import seeds


def test_filled_problems_are_not_broadcast(spark):
    # a few rows would be sent to the driver whole, as would many whose texts are estimated at a few bytes
    out = N.in_context(N.forward(seeds(spark, 20, 2)), 300, lambda c: F.size(F.split(c, " ")))
    assert out.count() == 20 and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
