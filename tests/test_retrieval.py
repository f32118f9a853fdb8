"""Block-wise nearest vectors against brute force, and the plan they have."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import retrieval as RT


def brute(x, q, k, metric):
    out = []
    for j, p in enumerate(q):
        if metric == "l2":
            d = ((x - p) ** 2).sum(axis=1)
        else:
            d = 1 - (x @ p) / (np.linalg.norm(x, axis=1) * np.linalg.norm(p))
        for rank, i in enumerate(np.lexsort((np.arange(len(x)), np.round(d, 9)))[:k], 1):
            out.append((j, int(i), round(float(d[i]), 6), rank))
    return sorted(out)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("small", [False, True])
def test_nearest_by_blocks(spark, monkeypatch, metric, small):
    if small:  # many blocks: some are broadcast, the others go through the grid
        for name, value in (("BLOCK", 4), ("SENT", 2), ("CELLS", 3)):
            monkeypatch.setattr(RT, name, value)
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(700, 12)), rng.normal(size=(37, 12))
    x[300:340] = x[7]  # copies: the smaller ids win
    if metric == "l2":
        x[400:] += 1000.0  # far from the origin, where a product loses digits
    q[5], q[6] = x[7], x[500] + 1e-4
    vectors = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)] + [(9999, None, 1)], "vec_id long, embedding array<double>, g int").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, query array<double>").repartition(3)
    got = [(r["query_id"], r["vec_id"], round(r["distance"], 6), r["rank"]) for r in RT.nearest(vectors, queries, 25, metric).collect()]
    assert sorted(got) == brute(x, q, 25, metric)
    assert RT.nearest(vectors.limit(3), queries, 25, metric).count() == 37 * 3
    assert RT.nearest(vectors, queries.limit(0), 5, metric).count() == 0 == RT.nearest(vectors.limit(0), queries, 5, metric).count()


def test_nearest_runs_no_job_before_its_plan_does(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = vectors.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("nearest-plan", "plan only")
    try:
        frame = RT.nearest(vectors, queries, 3)
        assert list(tracker.getJobIdsForGroup("nearest-plan")) == []
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin BuildRight" in plan and "CartesianProduct" not in plan
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_distances_and_weights_have_the_doubles_of_the_sql(spark):
    """Scores of the diverse selection tie by nature, so the last bits decide what is picked."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(300, 64)).astype("float32").astype(float), rng.normal(size=(300, 64)).round(6)
    got, want = RT._distances(a, b, "l2"), []
    for x, y in zip((a - b).tolist(), range(300)):
        total = 0.0
        for v in x:
            total = math.fma(v, v, total)
        want.append(math.pow(math.sqrt(total), 2.0))
    assert got.tolist() == want
    x = [-k / 30 for k in range(400)] + [float("nan"), -800.0]
    rows = spark.createDataFrame(list(enumerate(x)), "i long, x double").select("i", RT._exp(F.col("x")).alias("e")).collect()
    e = [r["e"] for r in sorted(rows, key=lambda r: r["i"])]
    assert e[:400] == [math.exp(v) for v in x[:400]] and (e[400] is None or e[400] != e[400]) and e[401] == 0.0
