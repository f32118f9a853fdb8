"""Edge rows: one row, constant, rising, zero volume, nulls, empty, calendar ends, odd texts."""

import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import rows as RW
from tidemark.functions import text as X
from tidemark.operators import composites, momentum, pairs, trend, volatility, volume
from tidemark.operators import features as FE
from tidemark.operators import hooks as HK
from tidemark.operators import retrieval as RT
from tidemark.operators import risk as R
from tidemark.operators import sentiment as SE
from tidemark.sources import tables as TB


def bars(spark, closes, symbol="A", volumes=None, spread=0.0):
    rows = [(symbol, i, c if c is None else float(c), None if c is None else c + spread, None if c is None else c - spread,
             float(volumes[i]) if volumes else 10.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, time int, close double, high double, low double, volume double")


def col(df, name):
    return [r[name] for r in df.orderBy("time").collect()]


def test_rsi_states(spark):
    up = col(momentum.rsi(bars(spark, range(1, 31))), "rsi")
    assert up[12] is None and up[13] == 100.0
    down = col(momentum.rsi(bars(spark, range(30, 0, -1))), "rsi")
    assert down[-1] == 0.0
    flat = col(momentum.rsi(bars(spark, [5] * 30)), "rsi")
    assert set(flat) == {None}


def test_constant_prices(spark):
    flat = bars(spark, [5] * 80)
    assert set(col(momentum.stochastic(flat), "stoch_k")) == {None}
    assert set(col(momentum.cci(flat), "cci")) == {None}
    assert set(col(trend.adx(flat), "adx")) == {None}
    assert col(composites.technical_analysis(flat), "bb_position")[-1] is None
    assert col(volume.cmf(flat), "cmf")[-1] == 0.0
    assert col(volatility.atr(flat), "atr")[-1] == 0.0


def test_short_and_single_series(spark):
    one = bars(spark, [7])
    assert col(trend.sma(one), "sma") == [None]
    assert col(trend.ema(one), "ema") == [7.0]
    assert col(volume.obv(one), "obv") == [10.0]
    assert col(trend.parabolic_sar(one), "sar") == [7.0]
    exact = bars(spark, range(1, 21))
    got = col(trend.sma(exact, n=20), "sma")
    assert got[:19] == [None] * 19 and got[19] == 10.5


def test_zero_volume_and_zero_price(spark):
    zero = bars(spark, range(1, 31), volumes=[0] * 30)
    assert set(col(volume.vwap(zero), "vwap")) == {None}
    assert set(col(volume.cmf(zero), "cmf")) == {None}
    assert set(col(volume.mfi(zero), "mfi")) == {None}
    gap = bars(spark, [1, 0, 2, 3])
    assert col(momentum.roc(gap, n=1), "roc") == [None, -100.0, None, 50.0]


def test_null_close_breaks_full_windows(spark):
    got = col(trend.sma(bars(spark, [1, 2, None, 4, 5, 6]), n=3), "sma")
    assert got == [None, None, None, None, None, 5.0]


def test_empty_table(spark):
    empty = bars(spark, [1]).where("false")
    assert trend.sma(empty).count() == 0
    assert trend.macd(empty).count() == 0
    assert FE.price_features(empty.withColumn("open", F.col("close"))).count() == 0


def test_unsorted_interleaved(spark):
    a, b = bars(spark, range(1, 31)), bars(spark, range(31, 61), "B")
    mixed = a.unionByName(b).orderBy(F.rand(1))
    got = trend.ema(mixed, span=5).toPandas()
    for sym, g in got.groupby("symbol"):
        g = g.sort_values("time")
        assert np.allclose(g["ema"], g["close"].ewm(span=5, adjust=False).mean())


def test_known_values(spark):
    rng = np.random.default_rng(42)
    close = 100 + np.cumsum(rng.normal(0, 2, 100))
    pdf = pd.DataFrame({"symbol": "T", "time": range(100), "close": close, "high": close + rng.random(100) * 2,
                        "low": close - rng.random(100) * 2, "volume": rng.integers(1_000_000, 5_000_000, 100).astype(float)})
    df = spark.createDataFrame(pdf)
    m = trend.macd(df).toPandas().sort_values("time")
    assert np.allclose(m["macd_hist"], m["macd"] - m["macd_signal"])
    b = trend.bollinger(df).toPandas().dropna()
    assert (b["bb_upper"] >= b["bb_middle"]).all() and (b["bb_middle"] >= b["bb_lower"]).all()
    w = momentum.williams_r(df).toPandas()["williams_r"].dropna()
    assert w.between(-100, 0).all()
    r = momentum.rsi(df).toPandas()["rsi"].dropna()
    assert r.between(0, 100).all()
    v = volume.vwap(df).toPandas()
    assert v["vwap"].between(pdf["low"].min(), pdf["high"].max()).all()
    wma = trend.wma(df, n=4).toPandas().sort_values("time")["wma"].to_numpy()
    assert np.isclose(wma[-1], np.dot(close[-4:], [1, 2, 3, 4]) / 10)
    reg = FE.volatility_regime(df).toPandas().sort_values("time")
    vol = pd.Series(close).pct_change().rolling(20).std() * math.sqrt(252)
    assert reg["high_volatility_regime"].tolist() == (vol > vol.expanding().median()).astype(int).tolist()


def test_calendar(spark):
    df = spark.createDataFrame([("2021-01-03",), ("2024-02-29",), ("2024-12-31",), ("2024-01-01",)], "time string")
    got = {r["time"]: r for r in FE.calendar_features(df.withColumn("d", F.to_date("time")), "d").collect()}
    assert got["2021-01-03"]["week_of_year"] == 53 and got["2021-01-03"]["day_of_week"] == 6
    assert got["2024-02-29"]["is_month_end"] == 1 and got["2024-02-29"]["is_quarter_end"] == 0
    assert got["2024-12-31"]["is_quarter_end"] == 1 and got["2024-01-01"]["is_month_start"] == 1


def test_constant_correlation_is_null(spark):
    df = bars(spark, [5] * 20).unionByName(bars(spark, range(20), "G"))
    got = {r["symbol"]: r["correlation"] for r in pairs.corr_with(df, "G").collect()}
    assert got == {"A": None, "G": 1.0}


def test_interval_gaps(spark):
    df = spark.createDataFrame([("A", "2024-01-05 10:00:00", 0.5, "positive"), ("A", "2024-01-08 09:00:00", -0.5, "negative")],
                               "symbol string, time string, score double, label string").withColumn("time", F.to_timestamp("time"))
    day = SE.by_interval(df, "1D").orderBy("time").collect()
    assert [r["score_count"] for r in day] == [1, 0, 0, 1] and day[1]["score_mean"] is None
    week = [str(r["time"])[:10] for r in SE.by_interval(df, "1W").orderBy("time").collect()]
    assert week == ["2024-01-07", "2024-01-14"]


@pytest.mark.parametrize("text, want", [
    ('{"a": 1}', '{"a": 1}'), ('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ('so {"a": 1} ok', '{"a": 1}'), ("none", None),
    ("} {", None), (None, None), ("", None),
])
def test_robust_json(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.robust_json(F.col("t"))).first()[0] == want


def test_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("<b></b>",), (" a  <i>b</i>\n c ",)], "t string")
    assert [r[0] for r in df.select(X.clean_text(F.col("t"))).collect()] == ["", "", "", "a b c"]
    k = df.select(X.keyword_match(F.col("t"), ["a"], [], [])).collect()
    assert [r[0] for r in k] == [False, False, False, True]
    m = spark.createDataFrame([("sk-abc123xyz",), ("short",), (None,)], "t string")
    assert [r[0] for r in m.select(X.mask(F.col("t"))).collect()] == ["sk-a***3xyz", "***", "***"]


def test_t_quantile_and_var_order(spark):
    df = spark.range(1).withColumn("dof", F.lit(5.0))
    assert abs(df.select(R.t_quantile(0.05, F.col("dof"))).first()[0] + 2.015048) < 1e-5
    rng = np.random.default_rng(42)
    r = spark.createDataFrame(pd.DataFrame({"symbol": "P", "returns": rng.normal(0.0005, 0.015, 250)}))
    for row in R.compare_var_methods(r, n=2000).collect():
        assert row["var"] < 0 and row["cvar"] < row["var"]


def test_mmr_matches_hand_count(spark):
    hits = spark.createDataFrame([("q", 1, 0.1, 1), ("q", 2, 0.15, 2), ("q", 3, 0.5, 3), ("q", 4, 0.9, 4)],
                                 "query_id string, vec_id long, distance double, rank int")
    got = [r["vec_id"] for r in RT.mmr(hits, 2).orderBy("pick").collect()]
    assert got == [1, 2]
    assert RT.mmr(hits, 9).count() == 4


def test_nearest_in_passes(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "query_id long, query array<double>")
    one = RT.nearest(v, q, 3).collect()
    for name, value in (("BLOCK", 2), ("SENT", 1)):
        monkeypatch.setattr(RT, name, value)
    assert sorted(one) == sorted(RT.nearest(v, q, 3).collect())


def test_sources(spark, tmp_path):
    lines = spark.createDataFrame([("# c",), ("",), ("Gold",), ("+price",), ("!Ring",)], "value string")
    rules = TB.load_keywords(lines)
    assert TB.keyword_lists(rules) == {"general": ["gold"], "must": ["price"], "exclude": ["ring"]}
    path = str(tmp_path / "csv")
    spark.createDataFrame([("2024-01-02", 1.0, 2.0)], "Date string, Close double, `Adj Close` double").write.csv(path, header=True)
    got = TB.load_ohlcv(spark, path, "GLD", fmt="csv", schema="Date string, Close double, `Adj Close` double", header=True)
    assert got.columns == ["time", "symbol", "close", "adj_close", "source"] and got.first()["symbol"] == "GLD"
    with pytest.raises(ValueError):
        RW.adhoc_select(spark, "drop table x")
    valid, bad = RW.quarantine(RW.valid_quote(spark.createDataFrame([("A", 1.0, "t"), ("A", -1.0, "t")], "symbol string, price double, timestamp string")))
    assert (valid.count(), bad.count()) == (1, 1)


def test_compounding_through_total_loss_and_beyond(spark):
    from tidemark.operators.flows import drawdown

    rows = [("a", i, r) for i, r in enumerate([0.1, -1.0, 0.5])] + [("b", i, r) for i, r in enumerate([None, -3.0, 0.5, -2.0])]
    frame = spark.createDataFrame(rows, "symbol string, time int, returns double")
    got = {(r["symbol"], r["time"]): (r["cumulative"], r["drawdown"]) for r in drawdown(frame).collect()}
    assert [round(got["a", i][0], 9) for i in range(3)] == [1.1, 0.0, 0.0] and round(got["a", 2][1], 9) == -1.0
    assert [round(got["b", i][0], 9) for i in range(4)] == [1.0, -2.0, -3.0, 3.0]


def test_consensus_keeps_the_order_of_strategies(spark):
    from tidemark.operators import signals as SG

    rows = [("a", 1, "Zeta", "BUY", 1.0, 0), ("a", 1, "Alpha", "SELL", 0.5, 1), ("a", 1, "Mid", "HOLD", 0.0, 2)]
    got = SG.consensus(spark.createDataFrame(rows, "symbol string, time int, strategy string, signal string, strength double, position int")).first()
    assert got["reasoning"] == "Consensus from 2 strategies: Zeta (buy); Alpha (sell)"


def test_insert_ignore_keeps_the_first_of_a_new_key(spark):
    from tidemark.sources import tables as TB

    base = spark.createDataFrame([(1, "stored")], "k int, v string")
    delta = spark.createDataFrame([(1, "x", 0), (2, "a", 9), (2, "z", 3), (None, "n", 1)], "k int, v string, at int")
    got = {tuple(r) for r in TB.insert_ignore(base, delta, ["k"], ["at"]).collect()}
    assert got == {(1, "stored"), (2, "z"), (None, "n")}


def test_simulated_risk_without_spread(spark):
    from tidemark.operators import risk

    df = spark.createDataFrame([("flat", 0.02), ("flat", 0.02), ("one", 0.5), ("none", None)], "symbol string, returns double")
    var = {r["symbol"]: r for r in risk.monte_carlo_var(df, n=200).collect()}
    assert var["flat"]["var"] == var["flat"]["cvar"] == 0.02
    assert var["one"]["var"] is None and var["one"]["cvar"] is None and "none" not in var
    stress = {r["symbol"]: r for r in risk.monte_carlo_stress(df, n=200).collect()}
    assert stress["flat"]["worst_case"] == stress["flat"]["expected_shortfall"] == 0.02
    assert stress["flat"]["extreme_loss_probability"] == 1.0 and stress["one"]["extreme_loss_probability"] is None
    assert risk.monte_carlo_var(df.where("false"), n=200).count() == 0


def test_scored_texts_stay_in_arrow(spark):
    """Other columns and nulls pass through; a score that is no number is null, as in pandas; no frame of all texts is made."""
    rows = [(i, None if i % 5 == 0 else "a" * i, [i], datetime(2024, 1, 1)) for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, body string, more array<long>, at timestamp").coalesce(1)
    got = HK.score_texts(frame, lambda texts: [(len(t), len(texts), float("nan") if len(t) == 7 else 0.5) for t in texts], "body", 16)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    want = [(*r, float(len(r[1] or "")), 16.0 if i < 32 else 8.0, None if i == 7 else 0.5) for i, r in enumerate(rows)]
    assert [tuple(r) for r in got.orderBy("id").collect()] == want
    assert HK.score_texts(frame.limit(0), lambda texts: [], "body").count() == 0
