"""Registered queries: technical indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import composites, momentum, pairs, trend, volatility, volume
from tidemark.plans import views as V
from tidemark.plans.registry import query
from tidemark.plans.sqlparts import TR, avg, chg, ema_cte, gains, lag, lead, roll, rsi, sd, win
from tidemark.plans.views import BARS

TIGHT = "symbol time |"


def _bars(op, **kw):
    """Query body: one operator over the hourly bars, with their proven bound."""
    return lambda spark, d: op(V.bars(spark, d), max_rows=V.hours_bound(spark, d), **kw)


def bar_query(name, cols, op, select, ctes="", src="bars", **kw):
    ctes = BARS + ("," + ctes if ctes else "")
    query(name, f"{TIGHT} {cols}", ctes=ctes, sql=f"SELECT symbol, time, {select} FROM {src}")(
        _bars(op, **kw)
    )


bar_query("w01_sma", "sma", trend.sma, f"{avg('close', 20)} AS sma", n=20)
bar_query("w02_ema", "ema", trend.ema, "ema", ema_cte("e", "bars", {"ema": ("close", 12)}), "e", span=12)
bar_query(
    "w03_wma", "wma", trend.wma,
    f"CASE WHEN count(close) OVER {win(10)} = 10 THEN (close * 10 + "
    + " + ".join(f"{lag('close', 10 - i)} * {i}" for i in range(1, 10)) + ") / 55 END AS wma", n=10,
)
bar_query(
    "w04_dema", "dema", trend.dema, "2 * e1 - e2 AS dema",
    ema_cte("a", "bars", {"e1": ("close", 20)}) + "," + ema_cte("b", "a", {"e2": ("e1", 20)}), "b", n=20,
)
MACD = (
    ema_cte("m0", "bars", {"e12": ("close", 12), "e26": ("close", 26)})
    + ", m1 AS (SELECT *, e12 - e26 AS macd FROM m0)," + ema_cte("m", "m1", {"macd_signal": ("macd", 9)})
)
bar_query("w05_macd", "macd macd_signal macd_hist", trend.macd,
          "macd, macd_signal, macd - macd_signal AS macd_hist", MACD, "m")
BB = (f"{avg('close', 20)} + 2 * {sd('close', 20)} AS bb_upper, {avg('close', 20)} AS bb_middle, "
      f"{avg('close', 20)} - 2 * {sd('close', 20)} AS bb_lower")
bar_query("w06_bollinger", "bb_upper bb_middle bb_lower", trend.bollinger, BB)


@query(
    "w07_parabolic_sar", "symbol time | sar",
    ctes="RECURSIVE " + BARS + """,
o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) AS k FROM bars),
walk AS (
  SELECT symbol, k, time, close AS sar, high AS ep, CAST(0.02 AS DOUBLE) AS af, true AS up FROM o WHERE k = 1
  UNION ALL
  SELECT symbol, k, time,
    CASE WHEN flip THEN ep ELSE nxt END,
    CASE WHEN flip AND up THEN low WHEN flip THEN high WHEN up THEN greatest(ep, high) ELSE least(ep, low) END,
    CASE WHEN flip THEN CAST(0.02 AS DOUBLE)
         WHEN (up AND high > ep) OR (NOT up AND low < ep) THEN least(af + CAST(0.02 AS DOUBLE), CAST(0.2 AS DOUBLE)) ELSE af END,
    CASE WHEN flip THEN NOT up ELSE up END
  FROM (SELECT o.symbol, o.k, o.time, o.high, o.low, w.ep, w.af, w.up, w.sar + w.af * (w.ep - w.sar) AS nxt,
          CASE WHEN w.up THEN o.low < w.sar + w.af * (w.ep - w.sar) ELSE o.high > w.sar + w.af * (w.ep - w.sar) END AS flip
        FROM walk w JOIN o ON o.symbol = w.symbol AND o.k = w.k + 1)
)""",
    sql="SELECT symbol, time, sar FROM walk",
)
def w07(spark, d):
    return trend.parabolic_sar(V.bars(spark, d), max_rows=V.hours_bound(spark, d))


DM = f"""d AS (SELECT *, {TR} AS tr, high - {lag('high')} AS up, {lag('low')} - low AS down FROM bars),
d1 AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mdm FROM d),
d2 AS (SELECT *, 100 * {avg('pdm', 14)} / nullif({avg('tr', 14)}, 0) AS plus_di, 100 * {avg('mdm', 14)} / nullif({avg('tr', 14)}, 0) AS minus_di FROM d1),
d3 AS (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM d2)"""
bar_query("w08_adx", "adx plus_di minus_di", trend.adx, f"{avg('dx', 14)} AS adx, plus_di, minus_di", DM, "d3")


def _mid(n):
    return f"({roll('max', 'high', n)} + {roll('min', 'low', n)}) / 2"


ICHI = f"i AS (SELECT *, {_mid(9)} AS conversion, {_mid(26)} AS base, {_mid(52)} AS sb FROM bars)"
bar_query(
    "w09_ichimoku", "conversion base span_a span_b lagging", trend.ichimoku,
    f"conversion, base, {lag('(conversion + base) / 2', 26)} AS span_a, {lag('sb', 26)} AS span_b, "
    f"{lead('close', 26)} AS lagging", ICHI, "i",
)
bar_query("w10_rsi", "rsi", momentum.rsi, f"{rsi(14)} AS rsi", gains("bars"), "g")
HH, LL = roll("max", "high", 14), roll("min", "low", 14)
STOCH = f"k AS (SELECT *, 100 * (close - {LL}) / nullif({HH} - {LL}, 0) AS stoch_k FROM bars)"
bar_query("w11_stochastic", "stoch_k stoch_d", momentum.stochastic,
          f"stoch_k, {avg('stoch_k', 3)} AS stoch_d", STOCH, "k")
bar_query(
    "w12_cci", "cci", momentum.cci,
    "CASE WHEN len(l) = 20 THEN (tp - list_avg(l)) / nullif(CAST(0.015 AS DOUBLE) * list_avg(list_transform(l, lambda x: abs(x - list_avg(l)))), 0) END AS cci",
    f"c0 AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), c AS (SELECT *, list(tp) OVER {win(20)} AS l FROM c0)", "c",
)
bar_query("w13_williams_r", "williams_r", momentum.williams_r,
          f"-100 * ({HH} - close) / nullif({HH} - {LL}, 0) AS williams_r")
bar_query("w14_roc", "roc", momentum.roc, f"100 * {chg('close', 12)} AS roc")
bar_query("w15_momentum", "momentum", momentum.momentum, f"close - {lag('close', 10)} AS momentum")
bar_query(
    "w16_obv", "obv", volume.obv, "sum(step) OVER (PARTITION BY symbol ORDER BY time) AS obv",
    f"o AS (SELECT *, CASE WHEN {lag('close')} IS NULL THEN volume ELSE sign(close - {lag('close')}) * volume END AS step FROM bars)", "o",
)
MFI = f"""f0 AS (SELECT *, (high + low + close) / 3 AS tp FROM bars),
f1 AS (SELECT *, tp - {lag('tp')} AS up FROM f0),
f2 AS (SELECT *, CASE WHEN up > 0 THEN tp * volume ELSE 0 END AS pos, CASE WHEN up < 0 THEN tp * volume ELSE 0 END AS neg FROM f1),
f3 AS (SELECT *, {roll('sum', 'pos', 14)} AS p, {roll('sum', 'neg', 14)} AS n FROM f2)"""
bar_query("w17_mfi", "mfi", volume.mfi,
          "CASE WHEN n > 0 THEN 100 - 100 / (1 + p / n) WHEN p > 0 THEN CAST(100 AS DOUBLE) END AS mfi", MFI, "f3")
bar_query("w18_vwap", "vwap", volume.vwap,
          "sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vwap",
          "v AS (SELECT * FROM bars)", "v WINDOW w AS (PARTITION BY symbol ORDER BY time)")
MULT = "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume"
bar_query("w19_cmf", "cmf", volume.cmf, f"{roll('sum', 'mv', 20)} / nullif({roll('sum', 'volume', 20)}, 0) AS cmf",
          f"m AS (SELECT *, {MULT} AS mv FROM bars)", "m")
bar_query("w20_acc_dist", "acc_dist", volume.acc_dist,
          f"sum({MULT}) OVER (PARTITION BY symbol ORDER BY time) AS acc_dist")
bar_query("w21_atr", "atr", volatility.atr, f"{avg('tr', 14)} AS atr", f"t AS (SELECT *, {TR} AS tr FROM bars)", "t")
bar_query(
    "w22_keltner", "kc_upper kc_middle kc_lower", volatility.keltner,
    f"kc_middle + 2 * {avg('tr', 10)} AS kc_upper, kc_middle, kc_middle - 2 * {avg('tr', 10)} AS kc_lower",
    f"t AS (SELECT *, {TR} AS tr FROM bars)," + ema_cte("k", "t", {"kc_middle": ("close", 20)}), "k",
)
bar_query("w23_rolling_std", "rolling_std", volatility.rolling_std, f"{sd('close', 20)} AS rolling_std")
bar_query("w24_hist_vol", "hist_vol", volatility.hist_vol, f"{sd('r', 30)} * sqrt(252) AS hist_vol",
          f"l AS (SELECT *, ln(close / {lag('close')}) AS r FROM bars)", "l")
bar_query(
    "w25_donchian", "dc_upper dc_lower dc_middle", volatility.donchian,
    f"{roll('max', 'high', 20)} AS dc_upper, {roll('min', 'low', 20)} AS dc_lower, "
    f"({roll('max', 'high', 20)} + {roll('min', 'low', 20)}) / 2 AS dc_middle",
)

PAIR = BARS + """,
pairs AS (SELECT a.time, a.close AS a, b.close AS b, 'click/view' AS pair FROM bars a JOIN bars b USING (time)
  WHERE a.symbol = 'click' AND b.symbol = 'view')"""
PP = "ORDER BY time"


def _pair(spark, d):
    return pairs.pair_series(V.bars(spark, d), "click", "view")


query("w26_price_ratio", "time | ratio", ctes=PAIR, sql="SELECT time, a / nullif(b, 0) AS ratio FROM pairs")(
    lambda spark, d: pairs.price_ratio(V.bars(spark, d), "click", "view")
)
query("j11_pair_series", "time pair | a b", ctes=PAIR, sql="SELECT time, pair, a, b FROM pairs")(_pair)


@query(
    "w27_rolling_corr", "time | rolling_corr",
    ctes=PAIR + f", r AS (SELECT time, {chg('a', 1, PP)} AS ra, {chg('b', 1, PP)} AS rb FROM pairs)",
    sql=f"""SELECT time, CASE WHEN count(ra) OVER {win(60, PP)} = 60 THEN corr(ra, rb) OVER {win(60, PP)} END AS rolling_corr FROM r""",
)
def w27(spark, d):
    return pairs.rolling_corr(_pair(spark, d), by=("pair",), max_rows=V.hours_bound(spark, d))


query("w28_real_rate", "symbol time | real_rate", ctes=BARS,
      sql="SELECT symbol, time, high - low AS real_rate FROM bars")(
    lambda spark, d: pairs.real_rate(V.bars(spark, d), "high", "low")
)


@query(
    "w29_ratio_zscore", "time | ratio_zscore", ctes=PAIR + ", z AS (SELECT time, a / b AS r FROM pairs)",
    sql=f"SELECT time, (r - {avg('r', 60, PP)}) / nullif({sd('r', 60, PP)}, 0) AS ratio_zscore FROM z",
)
def w29(spark, d):
    return pairs.ratio_zscore(_pair(spark, d), by=("pair",), max_rows=V.hours_bound(spark, d))


TA_SQL = (
    ema_cte("m0", "bars", {"ema_12": ("close", 12), "e26": ("close", 26)})
    + ", m1 AS (SELECT *, ema_12 - e26 AS macd FROM m0)," + ema_cte("m", "m1", {"macd_signal": ("macd", 9)})
    + "," + gains("m")
    + f", ta AS (SELECT *, macd - macd_signal AS macd_hist, {BB}, {avg('close', 20)} AS sma_20, {avg('close', 50)} AS sma_50, {rsi(14)} AS rsi FROM g)"
    + ", tb AS (SELECT *, bb_upper - bb_lower AS bb_width, (close - bb_lower) / nullif(bb_upper - bb_lower, 0) AS bb_position FROM ta)"
)
TA_COLS = "sma_20 sma_50 ema_12 rsi macd macd_signal macd_hist bb_upper bb_middle bb_lower bb_width bb_position"
bar_query("w30_technical_analysis", TA_COLS, composites.technical_analysis, ", ".join(TA_COLS.split()), TA_SQL, "tb")
LEVELS = composites.bars.RETRACE + [(n, -r) for n, r in composites.bars.EXTEND]
query(
    "w30_technical_fibonacci", "symbol time | sma_20 rsi " + " ".join(n for n, _ in LEVELS), ctes=BARS + "," + TA_SQL,
    sql="SELECT symbol, time, sma_20, rsi, " + ", ".join(
        f"max(close) OVER k - (max(close) OVER k - min(close) OVER k) * CAST({r} AS DOUBLE) AS {n}" for n, r in LEVELS)
    + " FROM tb WINDOW k AS (PARTITION BY symbol)",
)(lambda s, d: composites.with_fibonacci(composites.technical_analysis(V.bars(s, d), max_rows=V.hours_bound(s, d))))
PI = "returns ma_5 ma_20 ma_50 volatility_20 rsi_14 bb_upper bb_middle bb_lower"
bar_query(
    "w31_price_indicators", PI, composites.price_indicators,
    f"returns, {avg('close', 5)} AS ma_5, {avg('close', 20)} AS ma_20, {avg('close', 50)} AS ma_50, "
    f"{sd('returns', 20)} AS volatility_20, {rsi(14)} AS rsi_14, {BB}",
    gains("bars") + f", p AS (SELECT *, {chg('close')} AS returns FROM g)", "p",
)


@query(
    "t16_state_labels", "symbol time rsi_signal macd_signal_label bollinger_signal", ctes=BARS + "," + TA_SQL,
    sql="""SELECT symbol, time,
  CASE WHEN rsi > 70 THEN 'OVERBOUGHT' WHEN rsi < 30 THEN 'OVERSOLD' WHEN rsi IS NOT NULL THEN 'NEUTRAL' END AS rsi_signal,
  CASE WHEN macd > macd_signal THEN 'BULLISH' ELSE 'BEARISH' END AS macd_signal_label,
  CASE WHEN bb_position > 1 THEN 'ABOVE_UPPER_BAND' WHEN bb_position < 0 THEN 'BELOW_LOWER_BAND'
    WHEN bb_position > CAST(0.8 AS DOUBLE) THEN 'NEAR_UPPER_BAND' WHEN bb_position < CAST(0.2 AS DOUBLE) THEN 'NEAR_LOWER_BAND'
    WHEN bb_position IS NOT NULL THEN 'MIDDLE_RANGE' END AS bollinger_signal FROM tb""",
)
def t16(spark, d):
    df = composites.technical_analysis(V.bars(spark, d), max_rows=V.hours_bound(spark, d))
    return composites.with_state_labels(df)


def flagship(spark, d):
    """Hourly bars, RSI and bands, with state names."""
    bars = V.bars(spark, d)
    s = composites.S.open_series(bars, back=21, max_rows=V.hours_bound(spark, d))
    s, value = momentum.rsi_columns(s, 14)
    s = trend.bollinger.on(s).add(rsi=value)
    width = F.col("bb_upper") - F.col("bb_lower")
    s = s.add(bb_position=composites.S.ratio(F.col("close") - F.col("bb_lower"), width))
    return composites.with_state_labels(s.close("_x_gain", "_x_loss"))


query(
    "flagship_bar_states", "symbol time rsi_signal bollinger_signal | close rsi bb_upper bb_lower",
    ctes=BARS + "," + gains("bars") + f", h AS (SELECT *, {rsi(14)} AS rsi, {BB} FROM g), hp AS (SELECT *, (close - bb_lower) / nullif(bb_upper - bb_lower, 0) AS pos FROM h)",
    sql="""SELECT symbol, time, close, rsi, bb_upper, bb_lower,
  CASE WHEN rsi > 70 THEN 'OVERBOUGHT' WHEN rsi < 30 THEN 'OVERSOLD' WHEN rsi IS NOT NULL THEN 'NEUTRAL' END AS rsi_signal,
  CASE WHEN pos > 1 THEN 'ABOVE_UPPER_BAND' WHEN pos < 0 THEN 'BELOW_LOWER_BAND' WHEN pos > CAST(0.8 AS DOUBLE) THEN 'NEAR_UPPER_BAND'
    WHEN pos < CAST(0.2 AS DOUBLE) THEN 'NEAR_LOWER_BAND' WHEN pos IS NOT NULL THEN 'MIDDLE_RANGE' END AS bollinger_signal FROM hp""",
)(flagship)
