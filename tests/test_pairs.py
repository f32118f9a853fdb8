"""Correlated pairs of whole vectors against a plain computation."""

import numpy as np
import pytest

from tidemark.operators import pairs


@pytest.mark.parametrize("groups", [1, 5])
def test_vector_pairs(spark, monkeypatch, groups):
    monkeypatch.setattr(pairs, "TILE", 7)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, 12)) * [[1e-9], [1], [1e6], [5]]
    rows = {}
    for i in range(40):
        v = base[i % 4] * rng.choice([-2.0, 3.0]) + rng.normal(size=12) * abs(base[i % 4]).max() * 0.3
        rows[f"S{i:02d}"] = [None if rng.random() < 0.1 else float(x) for x in v]
    rows["flat"], rows["none"], rows["one"] = [7.0] * 12, [None] * 12, [1.0] + [None] * 11
    df = spark.createDataFrame(list(rows.items()), "symbol string, _v array<double>")
    got = {(r["a"], r["b"]): (r["n"], r["correlation"]) for r in pairs.vector_pairs(df, 0.6, groups=groups).collect()}
    want = {}
    names = sorted(rows)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            both = [(x, y) for x, y in zip(rows[a], rows[b]) if x is not None and y is not None]
            if len(both) < 2 or len({x for x, _ in both}) == 1 or len({y for _, y in both}) == 1:
                continue
            c = np.corrcoef(np.array(both).T)[0, 1]
            if abs(c) > 0.6:
                want[a, b] = (len(both), c)
    assert got.keys() == want.keys() and len(got) > 20
    for k, (n, c) in want.items():
        assert got[k][0] == n and abs(got[k][1] - c) < 1e-9


def test_vector_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "symbol string, _v array<double>")
    assert pairs.vector_pairs(df, 0.5).count() == 0


def test_partial_sums_stay_below_the_rows():
    for rows, symbols in [(10**6, 20), (10**9, 700), (10**9, 5_000), (10**12, 100_000), (10**12, 30)]:
        blocks, groups = pairs.pair_layout(rows, symbols)
        tiles = groups * (groups + 1) // 2
        per_group = -(-symbols // groups)
        sent = blocks * (groups * per_group * (per_group - 1) // 2 + (tiles - groups) * per_group**2)
        assert blocks == 1 or sent <= rows * groups
        assert rows * min(1.0, 2 / groups) / blocks <= pairs.PAIR_ROWS
