"""The blocked layout must give the same rows as one window per symbol."""

import numpy as np
import pandas as pd
import pytest

from tidemark import series as S
from tidemark.operators import composites, momentum, trend, volatility, volume


def walk(n_by_symbol, seed=42):
    rng = np.random.default_rng(seed)
    parts = []
    for sym, n in n_by_symbol.items():
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        parts.append(pd.DataFrame({
            "symbol": sym,
            "time": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(rng.integers(1, 9, n)), unit="h"),
            "open": close, "high": close + rng.random(n) * 2, "low": close - rng.random(n) * 2,
            "close": close, "volume": rng.integers(0, 50, n).astype(float),
        }))
    return pd.concat(parts).sample(frac=1, random_state=1)


@pytest.fixture(scope="module")
def bars(spark):
    # one hot symbol, one short, one single row
    return spark.createDataFrame(walk({"HOT": 900, "MID": 130, "ONE": 1, "TWO": 2})).cache()


OPS = {
    "sma": (trend.sma, {}), "ema": (trend.ema, {}), "wma": (trend.wma, {}), "dema": (trend.dema, {"n": 3}),
    "macd": (trend.macd, {"fast": 3, "slow": 5, "signal": 4}), "bollinger": (trend.bollinger, {}),
    "adx": (trend.adx, {}), "ichimoku": (trend.ichimoku, {}), "rsi": (momentum.rsi, {}),
    "stochastic": (momentum.stochastic, {}), "cci": (momentum.cci, {}), "williams": (momentum.williams_r, {}),
    "roc": (momentum.roc, {}), "momentum": (momentum.momentum, {}), "obv": (volume.obv, {}),
    "mfi": (volume.mfi, {}), "vwap": (volume.vwap, {}), "cmf": (volume.cmf, {}), "acc": (volume.acc_dist, {}),
    "atr": (volatility.atr, {}), "keltner": (volatility.keltner, {"span": 5}),
    "std": (volatility.rolling_std, {}), "hist_vol": (volatility.hist_vol, {}),
    "donchian": (volatility.donchian, {}), "ta": (composites.technical_analysis, {}),
    "price_indicators": (composites.price_indicators, {}),
}


def same(a, b):
    a = a.toPandas().sort_values(["symbol", "time"]).reset_index(drop=True)
    b = b.toPandas().sort_values(["symbol", "time"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a[sorted(a.columns)], b[sorted(b.columns)], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("name", list(OPS))
def test_blocked_equals_whole(bars, name):
    op, kw = OPS[name]
    same(op(bars, max_rows=900, block_rows=1000, **kw), op(bars, block_rows=64, **kw))


def test_layout_is_chosen_from_the_largest_key(bars):
    assert S.largest_key_rows(bars, ["symbol"]) == 900
    assert not S.open_series(bars, block_rows=900).blocked
    s = S.open_series(bars, block_rows=100, back=5)
    assert s.blocked
    sizes = s.df.groupBy("symbol", S.BLOCK).count().agg({"count": "max"}).first()[0]
    assert sizes <= 105


def test_running_kinds(bars):
    from pyspark.sql import functions as F

    gaps = bars.withColumn("g", F.when(F.col("volume") > 30, F.col("close")))
    what = dict(v=("sum", F.col("volume")), m=("max", F.col("close")), lo=("min", F.col("close")),
                n=("count", F.col("g")), f=("last", F.col("g")))
    a = S.running(S.open_series(gaps, max_rows=900), **what).close()
    b = S.running(S.open_series(gaps, block_rows=50), **what).close()
    same(a, b)


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame(
        [(None, i, float(i)) for i in range(30)] + [("a", i, float(i)) for i in range(5)],
        "symbol string, time int, close double",
    )
    a = trend.sma(df, n=3, max_rows=30)
    b = trend.sma(df, n=3, block_rows=8)
    same(a, b)
    assert b.count() == 35
