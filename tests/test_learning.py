"""Declared spaces and their seeded points."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import learning as ML


def test_points_are_within_their_space(spark):
    space = {"a": ("int", 3, 5), "b": ("float", -1.0, 1.0), "c": ("log", 1e-8, 10.0), "d": ("choice", ["x", "y", "z"])}
    points = ML.drawn(space, 2000, seed=1)
    assert {p["a"] for p in points} == {3, 4, 5} and {p["d"] for p in points} == {"x", "y", "z"}
    assert all(-1 <= p["b"] <= 1 and 1e-8 <= p["c"] <= 10 for p in points)
    assert abs(sum(p["b"] for p in points) / 2000) < 0.05
    assert 0.4 < sum(math.log10(p["c"]) < -3.5 for p in points) / 2000 < 0.6  # half of the draws below the middle of the logarithm
    assert ML.drawn(space, 50, seed=1) == points[:50] != ML.drawn(space, 50, seed=2)
    for name, space in ML.SPACES.items():
        assert all(ML.MAKERS[name](**p) is not None for p in ML.drawn(space, 5))
    with pytest.raises(ValueError):
        ML.drawn({"a": ("normal", 0, 1)}, 1)


def test_grid():
    assert ML.grid({"a": [1, 2], "b": ["x"]}) == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]


def test_rows_of_a_fit_are_made_before_its_tasks(spark, monkeypatch):
    """A task that makes all partitions of a shuffle holds their sorts and tables until its end."""
    seen = {}

    class Trees:
        def fit(self, rows):
            seen["plan"], seen["tasks"], seen["rows"] = rows._jdf.queryExecution().executedPlan().toString(), rows.rdd.getNumPartitions(), rows.count()

    monkeypatch.setattr(ML, "_pipeline", lambda cols, estimator: Trees())
    rows = spark.range(1000).selectExpr("id % 5 AS symbol", "CAST(id AS DOUBLE) AS x")
    ML._fit(["x"], None, rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))))
    assert seen["tasks"] == 1 and seen["rows"] == 1000
    assert "Exchange" not in seen["plan"] and "Window" not in seen["plan"]
