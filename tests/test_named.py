"""Expressions by name."""

import math

import pytest
from pyspark.sql import functions as F

from riskweave.functions.named import DISTANCES, LOSSES, REWARDS, VIOLATIONS, Named
from riskweave.operators import claims as C
from riskweave.operators import neighbors as N


def test_names_are_known_and_added_once():
    kind = Named("loss", one=lambda n, false: n)
    kind.add("two", lambda n, false: false)
    assert kind.names() == ["one", "two"] and kind(len) is len
    with pytest.raises(ValueError, match="there is a loss of this name"):
        kind.add("one", lambda n, false: n)
    with pytest.raises(ValueError, match="no such loss: three .known: one, two"):
        kind("three")


def test_named_values(spark):
    row = spark.sql("select array(1, 2, 3) a, array(1, 4, 0) b, 4 n, 1 f, 0 z, 3.0D s, 1.0D t, double('nan') bad, -1.0D minus, cast(null as double) nothing")
    at = lambda c: row.select(c).first()[0]
    assert [at(DISTANCES(x)("a", "b")) for x in ("hamming", "euclidean", "manhattan")] == pytest.approx([2 / 3, math.sqrt(13), 5])
    assert [at(LOSSES(x)(F.col("n"), F.col(y))) for x in ("rate", "any") for y in ("f", "z")] == [0.25, 0, 1, 0]
    assert at(REWARDS("margin")(F.col("s"), F.col("t"))) == 2 and at(REWARDS("margin")(F.col("t"), F.col("s"))) == 0 and at(REWARDS("distance")(F.col("t"), F.col("s"))) == 2
    assert [at(VIOLATIONS("infeasible")(c)) for c in ("s", "bad", "minus", "nothing")] == [False, True, False, True]
    assert [at(VIOLATIONS("positive")(c)) for c in ("s", "bad", "minus", "nothing")] == [True, True, False, True]


def test_operators_take_names_and_expressions(spark):
    claims = spark.createDataFrame([(1, 0.9, False), (1, 0.8, True), (1, 0.1, True)], "response int, score double, supported boolean")
    squared = lambda n, false: false * false / (n * n)
    got = {kind if isinstance(kind, str) else "squared": {r.tau: r.loss for r in C.threshold_losses(claims, [0.0, 0.5, 0.95], kind).collect()} for kind in ("rate", "any", squared)}
    assert got["rate"] == pytest.approx({0.0: 1 / 3, 0.5: 0.5, 0.95: 0.0}) and got["any"] == {0.0: 1, 0.5: 1, 0.95: 0}
    assert got["squared"] == pytest.approx({0.0: 1 / 9, 0.5: 0.25, 0.95: 0.0})
    with pytest.raises(ValueError, match="no such loss"):
        C.threshold_losses(claims, [0.5], "other")
    with pytest.raises(ValueError, match="no such distance"):
        N.farthest_first(spark.createDataFrame([(1, [1], 0.0)], "id bigint, particle array<int>, score double"), 1, "other")
