"""Operators with unbounded frames, ranks or splits: one hot key, cut into small blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_layout import same, walk
from tidemark import series as S
from tidemark.functions import stats as ST
from tidemark.operators import factors as FA
from tidemark.operators import features as FE
from tidemark.operators import flows as FL
from tidemark.operators import performance as PF
from tidemark.operators import risk as R
from tidemark.operators import sentiment as SE
from tidemark.operators import signals as SG


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk({"HOT": 700, "MID": 90, "ONE": 1}, seed=7)).cache()


def both(op, bars, keys=("symbol", "time"), **kw):
    a = op(bars, max_rows=700, **kw).toPandas()
    b = op(bars, block_rows=60, **kw).toPandas()
    cols = sorted(a.columns)
    order = [k for k in keys if k in cols]
    a, b = (x[cols].sort_values(order).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, rtol=1e-8, atol=1e-9)


@pytest.mark.parametrize("op", [
    FE.price_features, FE.technical_features, FE.volatility_features, FE.volatility_regime, FE.direction_features,
    FE.direction_label, FE.training_target, FE.ewm_variance, FE.sequences, FL.estimate_flows, SG.trend_signal,
    SG.mean_reversion_signal, SG.ma_signal, FE.all_features,
], ids=lambda o: o.__name__)
def test_bar_operators(bars, op):
    both(op, bars)


def test_backtest_and_report(bars):
    signals = SG.ma_signal(bars, max_rows=700)
    both(PF.signal_backtest, signals)
    curve = PF.signal_backtest(signals, max_rows=700)
    both(PF.performance_metrics, curve)
    both(PF.ma_sweep, bars, keys=("symbol", "fast", "slow"), fasts=(3, 5), slows=(8, 13))


def test_splits(bars):
    both(PF.walk_forward_splits, bars, keys=("symbol", "fold", "time"), n_splits=3, test=10, gap=1)
    both(PF.chrono_split, bars)


def test_drawdown(bars):
    r = bars.withColumn("returns", F.sin("close") / 50)
    both(FL.drawdown, r)


def test_factors(bars):
    gold = bars.where("symbol = 'HOT'").select("time", F.col("close").alias("gold_price"))
    both(lambda df, **k: FA.calculate_factors(df, gold, **k), bars)
    f = FA.calculate_factors(bars, max_rows=700).cache()
    for method in ("z_score", "min_max", "rank"):
        both(FA.normalize_factors, f, cols=["rsi", "volume_surge"], method=method)
    both(FA.factor_ic, f, keys=("symbol", "period"), cols=["rsi", "volume_surge"], returns="return_1m", periods=(3,))


def test_quantiles_match_numpy(bars):
    p = {"q05": 0.05, "q50": 0.5, "q99": 0.99}
    for kw in ({"max_rows": 700}, {"block_rows": 50}):
        got = ST.quantiles(bars, "close", p, **kw).toPandas().set_index("symbol")
        for sym, g in bars.toPandas().groupby("symbol"):
            want = np.percentile(g["close"], [5, 50, 99])
            assert np.allclose(got.loc[sym, list(p)].to_numpy(dtype=float), want)
        wide = ST.with_quantiles(bars, "close", p, **kw).groupBy("symbol").agg(F.max("q50").alias("m")).toPandas()
        assert np.allclose(sorted(wide["m"]), sorted(got["q50"]))


def test_average_rank_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"symbol": "H", "id": range(400), "v": rng.integers(0, 9, 400).astype(float)})
    pdf.loc[::17, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None)))
    want = pdf["v"].rank()
    for kw in ({"max_rows": 400}, {"block_rows": 5}):
        got = ST.average_rank(df, "v", ["symbol"], "r", **kw).toPandas().sort_values("id")["r"]
        assert np.allclose(got, want, equal_nan=True)


def test_smaller_before():
    v = np.random.default_rng(1).integers(0, 50, 1300).astype(float)
    want = [int((v[:i] < x).sum()) for i, x in enumerate(v)]
    assert ST.smaller_before(v).tolist() == want


def test_var_is_the_same_in_both_layouts(bars):
    r = bars.withColumn("returns", F.sin("close") / 50)
    both(R.historical_var, r, keys=("symbol",))


def test_daily_metrics(bars):
    news = bars.select("symbol", "time", F.sin("close").alias("score"), F.lit(0.3).alias("p_pos"), F.lit(0.2).alias("p_neg"),
                       F.lit(0.5).alias("p_neu"), F.lit("positive").alias("label"))
    both(SE.daily_metrics, news, keys=("symbol", "date"))


def test_same_helper(bars):
    same(bars, bars)


def test_sequential_rules_in_blocks(bars):
    from tidemark.operators import trend
    from tidemark.streaming import rules as SR
    from tidemark.streaming.stateful import apply_table

    both(lambda df, **k: trend.parabolic_sar(df, **k), bars, warm=5)
    timed = bars.withColumn("epoch", F.unix_timestamp("time").cast("double")).withColumn("event_id", F.unix_timestamp("time"))
    for rule in (SR.cooldown(30 * 3600), SR.rate_limit(3, 86400, 7, 5 * 86400)):
        both(lambda df, r=rule, **k: apply_table(df, r, ["symbol"], ["symbol", "time"], ["time"], **k), timed, warm=5)


@pytest.mark.parametrize("kw", [{}, {"block_rows": 150, "tile": 2}])
def test_pair_correlation_matches_pandas(spark, kw):
    from tidemark.operators import pairs

    rng = np.random.default_rng(9)
    wide = pd.DataFrame(rng.normal(1e5, 3, (90, 6)), columns=list("ABCDEF"))
    wide["E"], wide["F"] = 7.0, wide["A"] * 2 + rng.normal(0, 1, 90)
    wide = wide.mask(rng.random(wide.shape) < 0.2)
    long = wide.stack().reset_index()
    long.columns = ["time", "symbol", "close"]
    got = {(r["a"], r["b"]): r for r in pairs.pair_correlation(spark.createDataFrame(long), "close", **kw).collect()}
    want = wide.corr()
    assert len(got) == 15
    for (a, b), r in got.items():
        assert a < b and r["n"] == int((wide[a].notna() & wide[b].notna()).sum())
        assert r["correlation"] is None if "E" in (a, b) else abs(r["correlation"] - want.loc[a, b]) < 1e-9


def test_a_rule_that_forgets_nothing(spark, tmp_path):
    """Every block's true entry state differs from its guess: runs of a block stay bounded, rows are written once."""
    n, block = 4000, 100
    frame = spark.createDataFrame([("HOT", i, (i * 7919) % 101) for i in range(n)] + [(None, i, i) for i in range(500)], "symbol string, time long, x long").repartition(6)
    log = str(tmp_path / "runs")

    def step(state, x):
        state = [(state[0] * 31 + int(x)) % 1_000_003, state[1] + 1]
        if state[1] % block == 1:
            with open(log, "a") as f:
                f.write(f"{state[1]}\n")
        return state, (state[0],)

    got = S.scan(frame, ["symbol"], ["time"], lambda: [1, 0], step, ["x"], [("code", "long")], warm=10, block_rows=block)
    want, state = {}, {"HOT": [1, 0], None: [1, 0]}
    for k, xs in (("HOT", [(i * 7919) % 101 for i in range(n)]), (None, range(500))):
        c = 1
        for i, x in enumerate(xs):
            c = (c * 31 + x) % 1_000_003
            want[k, i] = c
    assert {(r["symbol"], r["time"]): r["code"] for r in got.collect()} == want and got.count() == len(want)
    # for each block a first run (and its warm rows), at most two guesses, one sure run and the two writes above
    assert sum(1 for _ in open(log)) <= 7 * (n + 500) // block
