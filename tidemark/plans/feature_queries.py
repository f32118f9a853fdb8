"""Registered queries: features, flows, sentiment series, factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import factors as FA
from tidemark.operators import features as FE
from tidemark.operators import flows as FL
from tidemark.plans import views as V
from tidemark.plans.indicators import bar_query
from tidemark.plans.registry import query
from tidemark.plans.sqlparts import TR, avg, chg, ema_cte, gains, lag, lead, roll, sd, win
from tidemark.plans.views import BARS, DAILY, FLOWS, NEWS

D = "CAST({} AS DOUBLE)"

# --- features -----------------------------------------------------------------

PRICE_COLS = (
    [f"close_lag_{n}" for n in (1, 2, 3, 5, 10, 20)] + [f"returns_{n}d" for n in (1, 5, 20)]
    + ["log_returns"] + [f"ma_{n}" for n in (5, 10, 20, 50)] + [f"ma_{n}_ratio" for n in (5, 10, 20, 50)]
    + ["ema_12", "ema_26", "momentum_5d", "momentum_20d", "daily_range", "daily_range_pct"]
)
PRICE_SQL = ", ".join(
    [f"{lag('close', n)} AS close_lag_{n}" for n in (1, 2, 3, 5, 10, 20)]
    + [f"{chg('close', n)} AS returns_{n}d" for n in (1, 5, 20)]
    + [f"ln(close / {lag('close')}) AS log_returns"]
    + [f"{avg('close', n)} AS ma_{n}" for n in (5, 10, 20, 50)]
    + [f"close / {avg('close', n)} AS ma_{n}_ratio" for n in (5, 10, 20, 50)]
    + ["ema_12", "ema_26", f"close - {lag('close', 5)} AS momentum_5d", f"close - {lag('close', 20)} AS momentum_20d",
       "high - low AS daily_range", "(high - low) / close AS daily_range_pct"]
)
EMAS = ema_cte("e", "bars", {"ema_12": ("close", 12), "ema_26": ("close", 26)}, adjust=True)
bar_query("w40_price_features", " ".join(PRICE_COLS), FE.price_features, PRICE_SQL, EMAS, "e")


def _rsi_eps(n):
    return f"100 - 100 / (1 + {avg('gain', n)} / ({avg('loss', n)} + 1e-10))"


TECH_CTE = (
    EMAS + ", m1 AS (SELECT *, ema_12 - ema_26 AS macd FROM e),"
    + ema_cte("m2", "m1", {"macd_signal": ("macd", 9)}, adjust=True) + "," + gains("m2", "g")
    + f", t AS (SELECT *, {TR} AS tr, {avg('close', 20)} AS mid, {sd('close', 20)} AS sdev, "
      f"100 * (close - {roll('min', 'low', 14)}) / ({roll('max', 'high', 14)} - {roll('min', 'low', 14)} + 1e-10) AS stoch_k FROM g)"
)
TECH_COLS = ("rsi_7 rsi_14 rsi_21 macd macd_signal macd_hist bb_upper_20 bb_lower_20 bb_width_20 bb_position_20 "
             "atr_14 atr_ratio stoch_k stoch_d roc_5 roc_10 roc_20")
TECH_SQL = (
    f"{_rsi_eps(7)} AS rsi_7, {_rsi_eps(14)} AS rsi_14, {_rsi_eps(21)} AS rsi_21, macd, macd_signal, macd - macd_signal AS macd_hist, "
    "mid + 2 * sdev AS bb_upper_20, mid - 2 * sdev AS bb_lower_20, ((mid + 2 * sdev) - (mid - 2 * sdev)) / mid AS bb_width_20, "
    "(close - (mid - 2 * sdev)) / ((mid + 2 * sdev) - (mid - 2 * sdev) + 1e-10) AS bb_position_20, "
    f"{avg('tr', 14)} AS atr_14, {avg('tr', 14)} / close AS atr_ratio, stoch_k, {avg('stoch_k', 3)} AS stoch_d, "
    f"{chg('close', 5)} * 100 AS roc_5, {chg('close', 10)} * 100 AS roc_10, {chg('close', 20)} * 100 AS roc_20"
)
bar_query("w41_technical_features", TECH_COLS, FE.technical_features, TECH_SQL, TECH_CTE, "t")

VOL_CTE = (
    f"v0 AS (SELECT *, {chg('close')} AS r, pow(ln(high / low), 2) AS hl2 FROM bars), "
    "v0b AS (SELECT *, r * r AS squared_returns FROM v0), "
    # the first return is null; weights count from the first value
    + "v1 AS (SELECT a.*, b.ewm_variance FROM v0b a LEFT JOIN (SELECT symbol, time, ewm_variance FROM ("
    + "WITH " + ema_cte("ev", "(SELECT * FROM v0b WHERE r IS NOT NULL)", {"ewm_variance": ("squared_returns", 20)}, adjust=True)
    + " SELECT * FROM ev)) b USING (symbol, time)), "
    + "v2 AS (SELECT *, " + ", ".join(f"{sd('r', n)} * sqrt(252) AS volatility_{n}d" for n in (5, 10, 20, 60)) + " FROM v1), "
    + "v3 AS (SELECT *, median(volatility_20d) OVER (PARTITION BY symbol ORDER BY time) AS med FROM v2)"
)
VOL_COLS = ("volatility_5d volatility_10d volatility_20d volatility_60d volatility_ratio_5_20 parkinson_vol "
            "squared_returns ewm_variance")
query(
    "w42_volatility_features", f"symbol time | {VOL_COLS} | high_volatility_regime", ctes=BARS + "," + VOL_CTE,
    sql=f"""SELECT symbol, time, volatility_5d, volatility_10d, volatility_20d, volatility_60d,
  volatility_5d / (volatility_20d + 1e-10) AS volatility_ratio_5_20,
  sqrt({avg('hl2', 20)} / (4 * ln(2))) * sqrt(252) AS parkinson_vol, squared_returns, ewm_variance,
  CASE WHEN volatility_20d > med THEN 1 ELSE 0 END AS high_volatility_regime FROM v3""",
)(lambda s, d: FE.volatility_features(V.bars(s, d), max_rows=V.hours_bound(s, d)))
bar_query("w43_ewm_variance", "ewm_variance", FE.ewm_variance, "ewm_variance", VOL_CTE, "v3")
query(
    "w44_vol_regime", "symbol time | volatility_20d | high_volatility_regime", ctes=BARS + "," + VOL_CTE,
    sql="SELECT symbol, time, volatility_20d, CASE WHEN volatility_20d > med THEN 1 ELSE 0 END AS high_volatility_regime FROM v3",
)(lambda s, d: FE.volatility_regime(V.bars(s, d), max_rows=V.hours_bound(s, d)))

CAL = ("day_of_week day_of_month week_of_year month quarter is_monday is_friday is_month_start is_month_end is_quarter_end")
CAL_SQL = """isodow(t) - 1 AS day_of_week, day(t) AS day_of_month, weekofyear(t) AS week_of_year, month(t) AS month, quarter(t) AS quarter,
  CASE WHEN isodow(t) = 1 THEN 1 ELSE 0 END AS is_monday, CASE WHEN isodow(t) = 5 THEN 1 ELSE 0 END AS is_friday,
  CASE WHEN day(t) = 1 THEN 1 ELSE 0 END AS is_month_start, CASE WHEN t = last_day(t) THEN 1 ELSE 0 END AS is_month_end,
  CASE WHEN t = last_day(t) AND month(t) % 3 = 0 THEN 1 ELSE 0 END AS is_quarter_end,
  sin(2 * pi() * (isodow(t) - 1) / 7) AS day_sin, cos(2 * pi() * (isodow(t) - 1) / 7) AS day_cos,
  sin(2 * pi() * month(t) / 12) AS month_sin, cos(2 * pi() * month(t) / 12) AS month_cos"""
query(
    "w45_calendar_features", f"o_orderkey | day_sin day_cos month_sin month_cos | {CAL}",
    sql=f"SELECT o_orderkey, {CAL_SQL} FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS t FROM orders) x",
)(lambda s, d: FE.calendar_features(V.table(s, d, "orders"), "o_orderdate"))

query(
    "w46_training_target", "symbol time | target target_price | target_direction", ctes=BARS,
    sql=f"""SELECT * FROM (SELECT symbol, time, {lead('close', 5)} / close - 1 AS target, {lead('close', 5)} AS target_price,
  CASE WHEN {lead('close', 5)} / close - 1 > 0 THEN 1 ELSE 0 END AS target_direction FROM bars) x WHERE target IS NOT NULL""",
)(lambda s, d: FE.training_target(V.bars(s, d), h=5, max_rows=V.hours_bound(s, d)))

DIR_CTE = (EMAS + "," + gains("e", "g")
           + f", f0 AS (SELECT *, {chg('close')} AS returns_1d, {avg('close', 20)} AS mid, {sd('close', 20)} AS sdev FROM g)")
RSI14 = (f"(CASE WHEN {avg('loss', 14)} > 0 THEN 100 - 100 / (1 + {avg('gain', 14)} / {avg('loss', 14)}) "
         f"WHEN {avg('gain', 14)} > 0 THEN CAST(100 AS DOUBLE) END)")
DIR_SQL = (
    f"SELECT symbol, time, returns_1d, {chg('close', 5)} AS returns_5d, {chg('close', 20)} AS returns_20d, "
    + ", ".join(f"{avg('close', n)} / close - 1 AS sma_{n}" for n in (5, 20, 60)) + ", "
    + ", ".join(f"{sd('returns_1d', n)} AS volatility_{n}d" for n in (5, 20))
    + f", {RSI14} AS rsi, (ema_12 - ema_26) / close AS macd, (close - (mid - 2 * sdev)) / nullif(4 * sdev, 0) AS bb_position, "
    + f"volume / nullif({avg('volume', 20)}, 0) AS volume_ratio, {chg('volume')} AS volume_change, (high - low) / close AS hl_ratio, "
    + f"{chg('close', 10)} AS momentum_10, {chg('close', 20)} AS momentum_20 FROM f0"
)
NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in FE.DIRECTION_COLUMNS)
query(
    "w49_direction_features", "symbol time | " + " ".join(FE.DIRECTION_COLUMNS), ctes=BARS + "," + DIR_CTE,
    sql=f"SELECT * FROM ({DIR_SQL}) x WHERE {NOT_NULL}",
)(lambda s, d: FE.direction_features(V.bars(s, d), max_rows=V.hours_bound(s, d)))
LABEL = f"CASE WHEN {lead('close')} / close - 1 > 0 THEN 1 ELSE 0 END AS label"
query("w50_direction_label", "symbol time | | label", ctes=BARS, sql=f"SELECT symbol, time, {LABEL} FROM bars")(
    lambda s, d: FE.direction_label(V.bars(s, d), max_rows=V.hours_bound(s, d)))


def _aligned(s, d):
    bound = V.hours_bound(s, d)
    x = FE.direction_features(V.bars(s, d), max_rows=bound).select("symbol", "time", *FE.DIRECTION_COLUMNS)
    y = FE.direction_label(V.bars(s, d), max_rows=bound).select("symbol", "time", "label")
    return FE.align(x, y)


query(
    "j08_align_features_labels", "symbol time | rsi macd | label",
    ctes=BARS + "," + DIR_CTE + f", x AS (SELECT * FROM ({DIR_SQL}) q WHERE {NOT_NULL}), y AS (SELECT symbol, time, {LABEL} FROM bars)",
    sql="SELECT symbol, time, rsi, macd, label FROM x JOIN y USING (symbol, time)",
)(_aligned)
query(
    "w51_sequences", "symbol time | last_close first_close | steps",
    ctes=BARS + f", q AS (SELECT symbol, time, {lag('close', 1)} AS last_close, {lag('close', 10)} AS first_close FROM bars)",
    sql="SELECT symbol, time, last_close, first_close, 10 AS steps FROM q WHERE first_close IS NOT NULL",
)(lambda s, d: FE.sequences(V.bars(s, d), length=10, max_rows=V.hours_bound(s, d)).select(
    "symbol", "time", F.element_at(F.element_at("sequence", -1), 1).alias("last_close"),
    F.element_at(F.element_at("sequence", 1), 1).alias("first_close"), F.size("sequence").alias("steps")))


def _scaled(s, d):
    z = FE.zscore_scale(V.bars(s, d), ["close", "volume"])
    return FE.minmax_scale(z, ["close"])


query(
    "w52_scaling", "symbol time | close_z volume_z close_scaled", ctes=BARS,
    sql="""SELECT symbol, time, (close - avg(close) OVER p) / (stddev_pop(close) OVER p + 1e-8) AS close_z,
  (volume - avg(volume) OVER p) / (stddev_pop(volume) OVER p + 1e-8) AS volume_z,
  (close - min(close) OVER p) / nullif(max(close) OVER p - min(close) OVER p, 0) AS close_scaled
  FROM bars WINDOW p AS (PARTITION BY symbol)""",
)(_scaled)

FLOW_CTE = (
    f"f1 AS (SELECT *, close * volume AS dollar_volume, coalesce(close * volume * sign({chg('close')}) * (volume / nullif({avg('volume', 20)}, 0) - 1), 0) AS net_flow FROM bars), "
    f"f2 AS (SELECT *, {roll('sum', 'net_flow', 5)} AS flow_change_5d, {roll('sum', 'net_flow', 20)} AS flow_change_20d, "
    "abs(net_flow - avg(net_flow) OVER p) > 2 * stddev_samp(net_flow) OVER p AS is_anomaly FROM f1 WINDOW p AS (PARTITION BY symbol))"
)
query(
    "w53_estimate_flows", "symbol time is_anomaly | dollar_volume net_flow flow_change_5d flow_change_20d", dp=4,
    ctes=BARS + "," + FLOW_CTE,
    sql="SELECT symbol, time, coalesce(is_anomaly, false) AS is_anomaly, dollar_volume, net_flow, flow_change_5d, flow_change_20d FROM f2",
)(lambda s, d: FL.estimate_flows(V.bars(s, d), max_rows=V.hours_bound(s, d)))
query(
    "w54_shares_history", "symbol time | close volume volume_ratio shares_outstanding", ctes=BARS,
    sql="SELECT symbol, time, close, volume, volume / nullif(avg(volume) OVER (PARTITION BY symbol), 0) AS volume_ratio, CAST(1000 AS DOUBLE) AS shares_outstanding FROM bars",
)(lambda s, d: FL.shares_history(V.bars(s, d), 1000.0))


def _info(s):
    rows = [(sym, name, kind) for sym, (_, name, kind, _x) in
            zip(["click", "view", "error"], FL.ETF_INFO)]
    return s.createDataFrame(rows, "symbol string, name string, type string")


query(
    "a10_latest_flow_snapshot", "symbol name type is_anomaly last_updated | latest_flow flow_change_5d flow_change_20d last_price", dp=4,
    ctes=BARS + "," + FLOW_CTE + ", info AS (SELECT * FROM (VALUES ('click', 'SPDR Gold Shares', 'gold'), ('view', 'iShares Gold Trust', 'gold'), ('error', 'SPDR Gold MiniShares', 'gold')) v(symbol, name, type))",
    sql="""SELECT symbol, name, type, coalesce(is_anomaly, false) AS is_anomaly, time AS last_updated, net_flow AS latest_flow, flow_change_5d, flow_change_20d, close AS last_price
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS k FROM f2) JOIN info USING (symbol) WHERE k = 1""",
)(lambda s, d: FL.latest_flow_snapshot(FL.estimate_flows(V.bars(s, d), max_rows=V.hours_bound(s, d)), _info(s)))

# --- macro ----------------------------------------------------------------------

WIDE = "macro AS (SELECT time, " + ", ".join(
    f"max(CASE WHEN symbol = '{c}' THEN close END) AS \"{c}\"" for c in ("click", "view", "error")) + " FROM bars GROUP BY time)"


def _macro(s, d):
    long = V.bars(s, d).select("time", F.col("symbol").alias("series_name"), F.col("close").alias("value"))
    return FL.pivot_macro(long, ["click", "view", "error"])


query("a14_pivot_macro", "time | click view error", ctes=BARS + "," + WIDE, sql="SELECT * FROM macro")(_macro)
bar_query("w55_macro_derived", "cpi_yoy", FL.macro_derived, f"{chg('close', 12)} * 100 AS cpi_yoy", cpi="close")
query(
    "w65_ffill", "symbol time | filled",
    ctes=BARS + ", g AS (SELECT symbol, time, CASE WHEN volume > 200 THEN close END AS x FROM bars)",
    sql="SELECT symbol, time, last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time) AS filled FROM g",
)(lambda s, d: FE.ffill(V.bars(s, d).withColumn("filled", F.when(F.col("volume") > 200, F.col("close"))),
                        ["filled"], max_rows=V.hours_bound(s, d)))

# --- side-table joins ------------------------------------------------------------

SENT = "sent AS (SELECT CAST(time AS DATE) AS date, avg(score) AS sentiment_score, avg(CASE WHEN label = 'positive' THEN 1.0 ELSE 0.0 END) AS bullish_ratio FROM news GROUP BY 1)"


def _sent(s, d):
    return V.news(s, d).select("time", F.col("score").alias("sentiment_score"),
                               F.when(F.col("label") == "positive", 1.0).otherwise(0.0).alias("bullish_ratio"))


query(
    "j01_join_sentiment", "symbol time date | close sentiment_score bullish_ratio", ctes=BARS + "," + NEWS + "," + SENT,
    sql="""SELECT symbol, time, CAST(time AS DATE) AS date, close, coalesce(sentiment_score, 0) AS sentiment_score,
  coalesce(bullish_ratio, 0.5) AS bullish_ratio FROM bars b LEFT JOIN sent s ON CAST(b.time AS DATE) = s.date""",
)(lambda s, d: FE.join_sentiment(V.bars(s, d), _sent(s, d)))
query(
    "j02_join_flows", "symbol time | close net_flow",
    ctes=DAILY + ", fl AS (SELECT symbol, CAST(o AS DATE) AS date, avg(v) AS net_flow FROM (SELECT symbol, day AS o, CASE WHEN flag = 'R' THEN -amount ELSE amount END AS v FROM trades WHERE qty > 40) GROUP BY 1, 2)",
    sql="SELECT d.symbol, d.time, close, coalesce(net_flow, 0) AS net_flow FROM daily d LEFT JOIN fl ON d.symbol = fl.symbol AND d.time = fl.date", dp=8,
)(lambda s, d: FE.join_flows(
    V.daily(s, d),
    V.trades(s, d).where("qty > 40").select("symbol", F.col("day").alias("time"), F.when(
        F.col("flag") == "R", -F.col("amount")).otherwise(F.col("amount")).alias("net_flow")),
    keys=("symbol", "date")))
MACRO_DAY = "md AS (SELECT CAST(o_orderdate AS DATE) AS date, CASE WHEN count(*) % 2 = 0 THEN max(o_totalprice) END AS rate FROM orders GROUP BY 1)"


def _macro_day(s, d):
    return V.table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.when(F.count(F.lit(1)) % 2 == 0, F.max("o_totalprice")).alias("rate"))


query(
    "j03_join_macro", "symbol time | close rate", dp=8,
    ctes=DAILY + "," + MACRO_DAY + ", mf AS (SELECT date, last_value(rate IGNORE NULLS) OVER (ORDER BY date) AS rate FROM md), "
    "jj AS (SELECT d.symbol, d.time, d.close, mf.rate FROM daily d LEFT JOIN mf ON d.time = mf.date)",
    sql="SELECT symbol, time, close, last_value(rate IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time) AS rate FROM jj",
)(lambda s, d: FE.join_macro(V.daily(s, d), _macro_day(s, d), max_rows=V.days_bound(s, d)))


def _side(s, d):
    """Flows of the events, and a macro series with gaps: a rate on every day with an even number of events."""
    events = V.table(s, d, "events")
    flows = events.select(F.col("ts").alias("time"), (F.col("value") - 50).alias("net_flow"))
    day = F.to_date("ts").alias("date")
    return flows, events.groupBy(day).agg(F.when(F.count(F.lit(1)) % 2 == 0, F.max("value")).alias("rate"))


SIDE = """fl AS (SELECT CAST(ts AS DATE) AS date, avg(value - 50) AS net_flow FROM events GROUP BY 1),
mdy AS (SELECT CAST(ts AS DATE) AS date, CASE WHEN count(*) % 2 = 0 THEN max(value) END AS rate FROM events GROUP BY 1),
mfl AS (SELECT date, last_value(rate IGNORE NULLS) OVER (ORDER BY date) AS rate FROM mdy),
mjn AS (SELECT symbol, time, last_value(m.rate IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time) AS rate FROM bars b LEFT JOIN mfl m ON CAST(b.time AS DATE) = m.date)"""


def _all(s, d):
    return FE.all_features(V.bars(s, d), _sent(s, d), *_side(s, d), max_rows=V.hours_bound(s, d))


query(
    "w48_all_features", "symbol time | ma_50_ratio rsi_21 atr_ratio parkinson_vol day_sin sentiment_score bullish_ratio net_flow rate | high_volatility_regime week_of_year",
    ctes=BARS + "," + TECH_CTE + "," + VOL_CTE + "," + NEWS + "," + SENT + "," + SIDE,
    sql=f"""SELECT p.symbol, p.time, ma_50_ratio, rsi_21, atr_ratio, parkinson_vol, sin(2 * pi() * (isodow(p.time) - 1) / 7) AS day_sin,
  coalesce(sentiment_score, 0) AS sentiment_score, coalesce(bullish_ratio, 0.5) AS bullish_ratio,
  coalesce(f.net_flow, 0) AS net_flow, j.rate AS rate, high_volatility_regime, weekofyear(p.time) AS week_of_year
  FROM (SELECT symbol, time, close / {avg('close', 50)} AS ma_50_ratio FROM bars) p
  JOIN (SELECT symbol, time, {_rsi_eps(21)} AS rsi_21, {avg('tr', 14)} / close AS atr_ratio FROM t) q USING (symbol, time)
  JOIN (SELECT symbol, time, sqrt({avg('hl2', 20)} / (4 * ln(2))) * sqrt(252) AS parkinson_vol,
    CASE WHEN volatility_20d > med THEN 1 ELSE 0 END AS high_volatility_regime FROM v3) v USING (symbol, time)
  JOIN mjn j USING (symbol, time)
  LEFT JOIN sent s ON CAST(p.time AS DATE) = s.date LEFT JOIN fl f ON CAST(p.time AS DATE) = f.date""",
)(_all)

# --- sentiment series --------------------------------------------------------------

HOURLY = NEWS + ", sents AS (SELECT symbol, date_trunc('hour', time) AS time, avg(score) + avg(length(content)) / 77777 AS sentiment, CAST(count(*) AS DOUBLE) AS volume, avg(length(content)) * (avg(p_pos) + 1) AS price FROM news GROUP BY 1, 2)"


def sents(s, d):
    return V.news(s, d).groupBy("symbol", F.date_trunc("hour", "time").alias("time")).agg(
        (F.avg("score") + F.avg(F.length("content")) / 77777).alias("sentiment"),
        F.count(F.lit(1)).cast("double").alias("volume"),
        (F.avg(F.length("content")) * (F.avg("p_pos") + 1)).alias("price"))


query(
    "w56_sentiment_momentum", "symbol time | ma_short ma_long momentum acceleration",
    ctes=HOURLY + f", a AS (SELECT *, {avg('sentiment', 5)} AS ma_short, {avg('sentiment', 20)} AS ma_long FROM sents), b AS (SELECT *, ma_short - ma_long AS momentum FROM a)",
    sql=f"SELECT symbol, time, ma_short, ma_long, momentum, momentum - {lag('momentum')} AS acceleration FROM b",
)(lambda s, d: FL.sentiment_momentum(sents(s, d)))
query(
    "w57_sentiment_anomalies", "symbol time is_anomaly_zscore is_anomaly_change is_anomaly_volume is_anomaly | z_score change volume_zscore",
    ctes=HOURLY + f""", a AS (SELECT *, abs(sentiment - {lag('sentiment')}) AS change FROM sents),
b AS (SELECT *, (sentiment - avg(sentiment) OVER p) / (stddev_samp(sentiment) OVER p + 1e-6) AS z_score,
  (volume - avg(volume) OVER p) / (stddev_samp(volume) OVER p + 1e-6) AS volume_zscore,
  avg(change) OVER p + 2 * stddev_samp(change) OVER p AS lim FROM a WINDOW p AS (PARTITION BY symbol)),
c AS (SELECT *, coalesce(abs(z_score) > 2, false) AS is_anomaly_zscore, coalesce(change > lim, false) AS is_anomaly_change,
  coalesce(abs(z_score) > 1.5 AND volume_zscore > 1.5, false) AS is_anomaly_volume FROM b)""",
    sql="SELECT *, is_anomaly_zscore OR is_anomaly_change OR is_anomaly_volume AS is_anomaly FROM c",
)(lambda s, d: FL.sentiment_anomalies(sents(s, d)))
query(
    "w58_sentiment_divergence", "symbol time bullish_divergence bearish_divergence | sentiment_trend price_trend divergence_strength",
    ctes=HOURLY + f""", a AS (SELECT *, {avg('sentiment', 10)} AS sm, {avg('price', 10)} AS pm FROM sents),
b AS (SELECT *, sm - {lag('sm')} AS ds, pm - {lag('pm')} AS dp FROM a)""",
    sql="""SELECT symbol, time, coalesce(dp < 0 AND ds > 0, false) AS bullish_divergence, coalesce(dp > 0 AND ds < 0, false) AS bearish_divergence,
  ds AS sentiment_trend, dp AS price_trend, abs(coalesce(ds, 0) - coalesce(dp, 0) * 0.01) AS divergence_strength FROM b""",
)(lambda s, d: FL.sentiment_divergence(sents(s, d)))

# --- factors -------------------------------------------------------------------------

GOLD = "Brand#11"
P = "PARTITION BY symbol ORDER BY time"
FACT = (
    DAILY + f", gold AS (SELECT time, close AS gold_price FROM daily WHERE symbol = '{GOLD}'), "
    "x0 AS (SELECT d.*, gold_price FROM daily d LEFT JOIN gold USING (time)), "
    + ema_cte("x1", "x0", {"e12": ("close", 12), "e26": ("close", 26)}) + ", x2 AS (SELECT *, e12 - e26 AS m FROM x1), "
    + ema_cte("x3", "x2", {"sg": ("m", 9)}) + "," + gains("x3", "x4")
    + f", x5 AS (SELECT *, {chg('close')} AS r, {chg('gold_price')} AS gr FROM x4), "
    + "x6 AS (SELECT *, CASE WHEN r IS NOT NULL AND gr IS NOT NULL THEN r END AS rp, CASE WHEN r IS NOT NULL AND gr IS NOT NULL THEN gr END AS gp FROM x5), "
    + f"x7 AS (SELECT *, CASE WHEN count(rp) OVER {win(60)} = 60 AND stddev_samp(rp) OVER {win(60)} > 0 AND stddev_samp(gp) OVER {win(60)} > 0 THEN corr(rp, gp) OVER {win(60)} END AS gold_correlation, "
    + f"CASE WHEN count(rp) OVER {win(60)} = 60 THEN covar_samp(rp, gp) OVER {win(60)} END / nullif({roll('var_samp', 'gr', 60)}, 0) AS gold_beta FROM x6), "
    + f"x AS (SELECT symbol, time, close, {chg('close', 21)} AS return_1m, {chg('close', 63)} AS return_3m, {chg('close', 126)} AS return_6m, {chg('close', 252)} AS return_12m, "
    + f"{RSI14} AS rsi, m - sg AS macd_signal, (close - ({avg('close', 20)} - 2 * {sd('close', 20)})) / nullif(4 * {sd('close', 20)}, 0) AS bb_position, "
    + f"volume / {avg('volume', 20)} AS volume_surge, {sd('r', 20)} * sqrt(252) AS volatility_20d, gold_correlation, gold_beta, "
    + f"-{sd('gold_correlation', 60)} AS correlation_stability FROM x7)"
)
ALL = FA.PRICE_FACTORS + FA.GOLD_FACTORS


def fact(s, d):
    return FA.calculate_factors(FA.with_reference(V.daily(s, d), GOLD), max_rows=V.days_bound(s, d))


query("w59_calculate_factors", "symbol time | " + " ".join(ALL), ctes=FACT, sql="SELECT * FROM x", dp=5)(fact)
SCALE = {
    "z_score": "({c} - avg({c}) OVER p) / nullif(stddev_samp({c}) OVER p, 0)",
    "min_max": "({c} - min({c}) OVER p) / nullif(max({c}) OVER p - min({c}) OVER p, 0)",
    "rank": "CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY symbol ORDER BY {c}) + (count(*) OVER (PARTITION BY symbol, {c}) - 1) / CAST(2 AS DOUBLE)) / count({c}) OVER p END",
}
NORMED = ALL


def _norm(method, cols):
    def one(c):
        x = SCALE[method].format(c=c)
        return x if method == "rank" else f"CASE WHEN {x} IS NOT NULL THEN greatest(least({x}, 3), -3) END"

    return ", ".join(f"{one(c)} AS {c}" for c in cols)


ROUNDED = FACT + ", xr AS (SELECT symbol, time, " + ", ".join(f"round({c}, 7) AS {c}" for c in ALL) + " FROM x)"


def _rounded(s, d):
    """Factors at seven decimals, so that both engines see the same ties and constants (gold against itself)."""
    return fact(s, d).select("symbol", "time", *[F.round(c, 7).alias(c) for c in ALL])


for _m in ("z_score", "min_max"):
    query(
        f"w60_normalize_{_m}", "symbol time | " + " ".join(NORMED), ctes=ROUNDED, dp=5,
        sql=f"SELECT symbol, time, {_norm(_m, NORMED)} FROM xr WINDOW p AS (PARTITION BY symbol)",
    )(lambda s, d, m=_m: FA.normalize_factors(_rounded(s, d), NORMED, m))
query(
    "w60_normalize_rank", "symbol time | " + " ".join(ALL), ctes=ROUNDED,
    sql=f"SELECT symbol, time, {_norm('rank', ALL)} FROM xr WINDOW p AS (PARTITION BY symbol)",
)(lambda s, d: FA.normalize_factors(_rounded(s, d), ALL, "rank", max_rows=V.days_bound(s, d)))
WEIGHT = {n: (w, k) for n, w, k in FA.FACTORS}
USED = FA.PRICE_FACTORS + FA.GOLD_FACTORS
query(
    "w61_composite_score", "symbol time | composite_score", ctes=FACT, dp=5,
    sql="SELECT symbol, time, " + " + ".join(f"{c} * {WEIGHT[c][0] * WEIGHT[c][1]}" for c in USED) + " AS composite_score FROM x",
)(lambda s, d: FA.composite_score(fact(s, d)))
PERIODS = (5, 10, 20)
IC_ROWS = " UNION ALL ".join(
    f"SELECT symbol, {p} AS period, '{c}' AS factor, {c} AS xv, {lead('return_1m', p)} AS yv FROM xr" for p in PERIODS for c in ALL)
PF = "PARTITION BY symbol, period, factor"
query(
    "w62_factor_ic", "symbol | ic_mean ic_std ic_ir ic_positive_ratio | period", dp=5,
    ctes=ROUNDED + f""", r0 AS ({IC_ROWS}), r1 AS (SELECT * FROM r0 WHERE xv IS NOT NULL AND yv IS NOT NULL),
r2 AS (SELECT *, rank() OVER ({PF} ORDER BY xv) + (count(*) OVER ({PF}, xv) - 1) / CAST(2 AS DOUBLE) AS rx,
  rank() OVER ({PF} ORDER BY yv) + (count(*) OVER ({PF}, yv) - 1) / CAST(2 AS DOUBLE) AS ry FROM r1),
ic AS (SELECT symbol, period, factor, CASE WHEN stddev_samp(rx) > 0 AND stddev_samp(ry) > 0 THEN corr(rx, ry) END AS ic FROM r2 GROUP BY symbol, period, factor)""",
    sql="""SELECT symbol, period, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(ic) / stddev_samp(ic) AS ic_ir,
  sum(CASE WHEN ic > 0 THEN 1 ELSE 0 END) / CAST(""" + str(len(ALL)) + """ AS DOUBLE) AS ic_positive_ratio FROM ic GROUP BY symbol, period""",
)(lambda s, d: FA.factor_ic(_rounded(s, d), ALL, "return_1m", PERIODS, max_rows=V.days_bound(s, d)))

# --- drawdown and forecast -------------------------------------------------------------

DD = BARS + f""", r AS (SELECT symbol, time, {chg('close')} AS returns FROM bars),
c AS (SELECT symbol, time, coalesce(product(1 + returns) OVER ({P}), 1) AS cumulative FROM r),
dd AS (SELECT *, cumulative / max(cumulative) OVER ({P}) - 1 AS drawdown FROM c)"""


def hourly_returns(s, d):
    """Hourly returns."""
    from tidemark import series as S

    x = S.open_series(V.bars(s, d), back=1, max_rows=V.hours_bound(s, d))
    return x.add(returns=S.change(x, "close")).close()


query("w63_drawdown", "symbol time | drawdown", ctes=DD, sql="SELECT symbol, time, drawdown FROM dd")(
    lambda s, d: FL.drawdown(hourly_returns(s, d), max_rows=V.hours_bound(s, d)))
query("w63_max_drawdown", "symbol | max_drawdown", ctes=DD,
      sql="SELECT symbol, min(drawdown) AS max_drawdown FROM dd GROUP BY symbol")(
    lambda s, d: FL.max_drawdown(hourly_returns(s, d), max_rows=V.hours_bound(s, d)))
query(
    "w64_trend_forecast", "symbol | forecast | step",
    ctes=BARS + """, l AS (SELECT *, 30 - row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS x, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
f AS (SELECT symbol, avg(close) AS ma, regr_slope(close, x) AS slope FROM l WHERE x >= 0 AND n >= 30 GROUP BY symbol)""",
    sql="SELECT symbol, step, ma + slope * step AS forecast FROM f, range(1, 8) t(step)",
)(lambda s, d: FL.trend_forecast(V.bars(s, d)))

# --- flow tables --------------------------------------------------------------------------

BRANDS = [f"Brand#{i}" for i in range(1, 26)]
query(
    "a13_pivot_flows", "time | " + " ".join(f"b{i + 1}" for i in range(len(BRANDS))), dp=2, ctes=FLOWS,
    sql="SELECT time, " + ", ".join(f"sum(CASE WHEN symbol = '{b}' THEN net_flow END) AS b{i + 1}" for i, b in enumerate(BRANDS))
        + " FROM flows WHERE time IN (SELECT DISTINCT time FROM flows ORDER BY time DESC LIMIT 20) GROUP BY time",
)(lambda s, d: FL.pivot_flows(V.flows(s, d), BRANDS).withColumnsRenamed({b: f"b{i + 1}" for i, b in enumerate(BRANDS)}))
query(
    "a09_flow_summary", "symbol | total_flow_30d avg_daily_flow last_flow | flow_count", dp=5, ctes=FLOWS,
    sql="""SELECT symbol, sum(net_flow) AS total_flow_30d, avg(net_flow) AS avg_daily_flow, arg_max(net_flow, time) AS last_flow, count(*) AS flow_count
  FROM flows WHERE time >= DATE '2001-06-01' - 30 GROUP BY symbol""",
)(lambda s, d: FL.flow_summary(V.flows(s, d), "2001-06-01"))
