"""Registered queries: signals, alerts, risk, backtests."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from tidemark.operators import alerts as A
from tidemark.operators import momentum
from tidemark.operators import pairs as P
from tidemark.operators import performance as PF
from tidemark.operators import risk as R
from tidemark.operators import signals as SG
from tidemark.plans import views as V
from tidemark.plans.feature_queries import hourly_returns
from tidemark.plans.registry import query
from tidemark.plans.sqlparts import TR, avg, chg, gains, lag, rsi, sd, win
from tidemark.plans.views import BARS, DAILY, FLOWS
from tidemark.session import cut_lineage

PT = "PARTITION BY symbol ORDER BY time"
# --- signals ---------------------------------------------------------------------------
TS = f"ts0 AS (SELECT *, {TR} AS tr, {avg('close', 10)} AS f, {avg('close', 30)} AS w FROM bars), ts AS (SELECT *, {avg('tr', 14)} AS atr FROM ts0)"
TSX = """CASE WHEN f > w THEN 'BUY' WHEN f < w THEN 'SELL' ELSE 'HOLD' END AS signal,
  CASE WHEN f > w THEN least((f - w) / w * 10, 1) WHEN f < w THEN least((w - f) / w * 10, 1) ELSE 0 END AS strength"""
query("d01_trend_signal", "symbol time signal | strength stop_loss take_profit", ctes=BARS + "," + TS,
      sql=f"SELECT symbol, time, {TSX}, close - 2 * atr AS stop_loss, close + 4 * atr AS take_profit FROM ts")(
    lambda s, d: SG.trend_signal(V.bars(s, d), max_rows=V.hours_bound(s, d)))
MR = gains("bars", "mg") + f", mr AS (SELECT *, {avg('close', 20)} + 2 * {sd('close', 20)} AS hi, {avg('close', 20)} - 2 * {sd('close', 20)} AS lo, {rsi(14)} AS rsi FROM mg)"
MRX = """CASE WHEN close < lo AND rsi < 30 THEN 'BUY' WHEN close > hi AND rsi > 70 THEN 'SELL' ELSE 'HOLD' END AS signal,
  CASE WHEN close < lo AND rsi < 30 THEN least((lo - close) / lo * 5 + (30 - rsi) / 30, 1) WHEN close > hi AND rsi > 70 THEN least((close - hi) / hi * 5 + (rsi - 70) / 30, 1) ELSE 0 END AS strength"""
query("d02_mean_reversion_signal", "symbol time signal | strength rsi", ctes=BARS + "," + MR, sql=f"SELECT symbol, time, {MRX}, rsi FROM mr")(
    lambda s, d: SG.mean_reversion_signal(V.bars(s, d), max_rows=V.hours_bound(s, d)))


def _both(s, d):
    m = V.hours_bound(s, d)
    return SG.run_strategies(V.bars(s, d), [lambda b: SG.trend_signal(b, max_rows=m), lambda b: SG.mean_reversion_signal(b, max_rows=m)])


query(
    "d03_consensus", "symbol time signal reasoning | consensus_score strength",
    ctes=BARS + "," + TS + "," + MR + f""", un AS (SELECT symbol, time, 'Trend Following' AS strategy, {TSX}, 2.0 AS wt FROM ts UNION ALL SELECT symbol, time, 'Mean Reversion', {MRX}, 1.0 FROM mr),
co AS (SELECT symbol, time, sum(strength * CASE signal WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END * wt) / sum(wt) AS x,
  list(concat(strategy, ' (', lower(signal), ')') ORDER BY strategy DESC) FILTER (signal <> 'HOLD') AS act FROM un GROUP BY 1, 2)""",
    sql="""SELECT symbol, time, x AS consensus_score, least(abs(x) / 2, 1) AS strength, CASE WHEN x >= 1.5 THEN 'STRONG_BUY' WHEN x >= 0.5 THEN 'BUY' WHEN x <= -1.5 THEN 'STRONG_SELL' WHEN x <= -0.5 THEN 'SELL' ELSE 'HOLD' END AS signal,
  CASE WHEN len(act) > 0 THEN concat('Consensus from ', len(act), ' strategies: ', array_to_string(act, '; ')) ELSE 'No clear signals from any strategy' END AS reasoning FROM co""",
)(lambda s, d: SG.consensus(_both(s, d), {"Trend Following": 2.0, "Mean Reversion": 1.0}))
query("d04_sentiment_signal", "doc_id | strength | direction", ctes=V.NEWS,
      sql="SELECT doc_id, abs(score) AS strength, CASE WHEN score > CAST(0.3 AS DOUBLE) THEN 1 WHEN score < CAST(-0.3 AS DOUBLE) THEN -1 ELSE 0 END AS direction FROM news")(
    lambda s, d: SG.sentiment_signal(V.news(s, d), col="score"))
query("d05_probability_signal", "doc_id | strength confidence | direction", ctes=V.NEWS + ", pb AS (SELECT doc_id, (score + 1) / 2 AS p FROM news)",
      sql="SELECT doc_id, CASE WHEN p > CAST(0.6 AS DOUBLE) THEN least(p, 1) WHEN p < CAST(0.4 AS DOUBLE) THEN least(1 - p, 1) ELSE 0.5 END AS strength, abs(p - 0.5) * 2 AS confidence, CASE WHEN p > CAST(0.6 AS DOUBLE) THEN 1 WHEN p < CAST(0.4 AS DOUBLE) THEN -1 ELSE 0 END AS direction FROM pb")(
    lambda s, d: SG.probability_signal(V.news(s, d).withColumn("probability", (F.col("score") + 1) / 2)))
query("d06_ma_signal", "symbol time | | direction", ctes=BARS,
      sql=f"SELECT symbol, time, CASE WHEN count(close) OVER {win(51)} >= 50 THEN CASE WHEN {avg('close', 20)} > avg(close) OVER {win(51)} THEN 1 WHEN {avg('close', 20)} < avg(close) OVER {win(51)} THEN -1 ELSE 0 END END AS direction FROM bars")(
    lambda s, d: SG.ma_signal(V.bars(s, d), max_rows=V.hours_bound(s, d)))

# --- flow alerts -----------------------------------------------------------------------
ZS = """zs AS (SELECT symbol, count(*) AS n, avg({c}) AS m, stddev_samp({c}) AS s, max(CASE WHEN b = 1 THEN {c} END) AS v FROM
  (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS b FROM {t}) q WHERE b <= {n} GROUP BY symbol)"""
COLS = "alert_type severity symbol title | value threshold"
LF = FLOWS + "," + ZS.format(c="net_flow", t="flows", n=60)
LFX = """SELECT CASE WHEN v > 0 THEN 'large_inflow' ELSE 'large_outflow' END AS alert_type, CASE WHEN abs((v - m) / s) > 4 THEN 'critical' WHEN abs((v - m) / s) > 3 THEN 'high' ELSE 'medium' END AS severity, symbol,
  concat('Large ', CASE WHEN v > 0 THEN 'Inflow' ELSE 'Outflow' END, ' Detected - ', symbol) AS title, v AS value, m + {z} * s AS threshold FROM zs WHERE n >= 60 AND s > 0 AND abs((v - m) / s) > {z}"""
query("d07_large_flow_alert", COLS, dp=2, ctes=LF, sql=LFX.format(z=0.8))(lambda s, d: A.large_flows(V.flows(s, d), z=0.8))
query("t21_alert_text", "symbol description", ctes=LF,
      sql="SELECT symbol, printf('%s experienced a %.1fσ %s of $%.1fM', symbol, abs((v - m) / s), CASE WHEN v > 0 THEN 'inflow' ELSE 'outflow' END, abs(v) / 1e6) AS description FROM zs WHERE n >= 60 AND s > 0 AND abs((v - m) / s) > 0.8")(
    lambda s, d: A.large_flows(V.flows(s, d), z=0.8))
query("d08_volume_alert", COLS, ctes=FLOWS + "," + ZS.format(c="volume", t="flows", n=20),
      sql="SELECT 'unusual_volume' AS alert_type, CASE WHEN (v - m) / s > 3.5 THEN 'high' ELSE 'medium' END AS severity, symbol, concat('Unusual Volume - ', symbol) AS title, v AS value, m + 0.5 * s AS threshold FROM zs WHERE n >= 20 AND s > 0 AND (v - m) / s > 0.5")(
    lambda s, d: A.volume_anomalies(V.flows(s, d), z=0.5))
RV = """rv AS (SELECT symbol, count(*) AS n, sum(CASE WHEN b <= 5 THEN net_flow END) AS nw, coalesce(sum(CASE WHEN b > 5 THEN net_flow END), 0) AS od FROM
  (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS b FROM flows) q WHERE b <= 10 GROUP BY symbol)"""
RVX = "SELECT 'flow_reversal' AS alert_type, 'high' AS severity, symbol, concat('Flow Reversal - ', symbol) AS title, nw AS value, od AS threshold FROM rv WHERE n >= 6 AND abs(od) >= 1000 AND ((od > 0 AND nw < -od * 0.5) OR (od < 0 AND nw > abs(od) * 0.5))"
query("d09_flow_reversal", COLS, dp=2, ctes=FLOWS + "," + RV, sql=RVX)(lambda s, d: A.flow_reversals(V.flows(s, d), floor=1000.0))
CF = """cdt AS (SELECT DISTINCT time FROM flows ORDER BY time DESC LIMIT 20), rc AS (SELECT * FROM flows WHERE time IN (SELECT time FROM cdt)),
fv AS (SELECT symbol, sum(net_flow) AS f FROM rc WHERE time IN (SELECT time FROM cdt ORDER BY time DESC LIMIT 5) GROUP BY symbol),
cr AS (SELECT x.symbol AS a, y.symbol AS b, CASE WHEN max(x.net_flow) > min(x.net_flow) AND max(y.net_flow) > min(y.net_flow) THEN corr(x.net_flow, y.net_flow) END AS c FROM rc x JOIN rc y ON x.time = y.time AND x.symbol < y.symbol GROUP BY 1, 2)"""
CFX = """SELECT 'correlated_flow' AS alert_type, 'medium' AS severity, concat(a, '/', b) AS symbol, concat('Correlated Flows - ', a, ' & ', b) AS title, c AS value, 0.8 AS threshold
  FROM cr JOIN fv fa ON fa.symbol = a JOIN fv fb ON fb.symbol = b WHERE abs(c) > 0.8 AND abs(fa.f) > 10000 AND abs(fb.f) > 10000"""
query("d10_correlated_flows", COLS, dp=2, ctes=FLOWS + "," + CF, sql=CFX)(lambda s, d: A.correlated_flows(V.flows(s, d), floor=10000.0))
VAX = "SELECT 'unusual_volume' AS alert_type, CASE WHEN (v - m) / s > 3.5 THEN 'high' ELSE 'medium' END AS severity, symbol, concat('Unusual Volume - ', symbol) AS title, v AS value, m + 2.5 * s AS threshold FROM zv WHERE n >= 20 AND s > 0 AND (v - m) / s > 2.5"


def _detections(flows):
    return A.run_all(flows, flows, reversal_floor=1000.0, pair_floor=10000.0)


query(
    "d11_run_all_detections", COLS, dp=2, ctes=LF + "," + RV + "," + CF + "," + ZS.format(c="volume", t="flows", n=20).replace("zs AS", "zv AS"),
    sql=" UNION ALL ".join([LFX.format(z=2.0), RVX, CFX, VAX]),
)(lambda s, d: _detections(V.flows(s, d)))

ALERTS = "al AS (SELECT event_id AS alert_id, event_type AS symbol, ['low','medium','high'][CAST(event_id % 3 AS INT) + 1] AS severity, CAST(ts AS TIMESTAMP) AS time, event_id % 4 = 0 AS is_read FROM events)"


def _alerts(s, d):
    return V.table(s, d, "events").select(
        F.col("event_id").alias("alert_id"), F.col("event_type").alias("symbol"),
        F.element_at(F.array(*map(F.lit, ["low", "medium", "high"])), (F.col("event_id") % 3 + 1).cast("int")).alias("severity"),
        F.col("ts").alias("time"), (F.col("event_id") % 4 == 0).alias("is_read"))


AL = "alert_id symbol severity time is_read"
query("f16_unread_alerts", AL, ctes=ALERTS, sql="SELECT * FROM al WHERE NOT is_read AND severity = 'high'")(lambda s, d: A.unread(_alerts(s, d), "high"))
query("f16_alert_history", AL, ctes=ALERTS, sql="SELECT * FROM al WHERE time >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 48 HOURS AND symbol = 'click'")(
    lambda s, d: A.history(_alerts(s, d), "2024-01-20 00:00:00", 48, "click"))
query("f16_active_alerts", AL, ctes=ALERTS, sql="SELECT * FROM al WHERE time >= TIMESTAMP '2024-01-28 00:00:00' - INTERVAL 1 HOUR")(
    lambda s, d: A.active(_alerts(s, d), "2024-01-28 00:00:00"))
query("f16_mark_read", AL, ctes=ALERTS, sql="SELECT alert_id, symbol, severity, time, is_read OR alert_id IN (SELECT l_orderkey FROM lineitem) AS is_read FROM al")(
    lambda s, d: A.mark_read(_alerts(s, d), V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("alert_id"))))
query("u02_distinct_symbols", "symbol", ctes=ALERTS, sql="SELECT DISTINCT symbol FROM al WHERE NOT is_read")(
    lambda s, d: A.unread(_alerts(s, d)).select("symbol").distinct())

# --- rules on quotes ----------------------------------------------------------------------
QUOTES = DAILY + f""", qr AS (SELECT *, (close - {lag('close')}) / {lag('close')} * 100 AS change_percent FROM daily), {gains('qr', 'qg')},
qq AS (SELECT symbol, close AS price, change_percent, rsi FROM (SELECT *, {rsi(14)} AS rsi, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS k FROM qg) z WHERE k = 1),
qc AS (SELECT a.symbol, CASE WHEN count(*) >= 10 THEN round(corr(a.close, g.close), 4) END AS gold_correlation FROM daily a JOIN daily g ON a.time = g.time AND g.symbol = 'Brand#11' GROUP BY 1),
ru AS (SELECT * FROM (VALUES ('r1', 'PriceBreakoutRule', 'above'), ('r2', 'PercentChangeRule', 'both'), ('r3', 'CorrelationDivergenceRule', NULL), ('r4', 'RSIAlertRule', NULL), ('r5', 'PriceBreakoutRule', 'below')) v(rule_id, type, direction)),
jr AS (SELECT q.*, qc.gold_correlation, ru.*, (SELECT max(change_percent) FROM qq WHERE symbol = 'Brand#11') AS gold_change_percent FROM qq q JOIN qc USING (symbol), ru)"""


def _quotes(s, d):
    from tidemark import series as S

    x = S.open_series(V.daily(s, d), back=16, max_rows=V.days_bound(s, d))
    x = x.add(change_percent=S.change(x, "close") * 100)
    x, value = momentum.rsi_columns(x, 14)
    newest = F.max_by(F.struct(F.col("close").alias("price"), "change_percent", "rsi"), "time")
    return x.add(rsi=value).close().groupBy("symbol").agg(newest.alias("q")).select("symbol", "q.*")


def _joined(s, d):
    kinds = [("r1", A.BREAKOUT, "above"), ("r2", A.PERCENT, "both"), ("r3", A.DIVERGENCE, None), ("r4", A.RSI, None),
             ("r5", A.BREAKOUT, "below")]
    q = cut_lineage(_quotes(s, d))  # a row per symbol, read for the quotes and for the reference
    each = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(t).alias("type"), F.lit(w).cast("string").alias("direction")) for r, t, w in kinds])
    none = F.lit(None).cast("double")
    rules = V.table(s, d, "part").select(F.col("p_brand").alias("symbol")).distinct().withColumn("_r", F.explode(each)).select(
        "symbol", "_r.*", F.lit(True).alias("enabled"), F.lit(60.0).alias("breakout_price"), F.lit(20.0).alias("threshold_percent"),
        F.lit(-1.0).alias("min_correlation"), none.alias("divergence_threshold"), F.lit(45.0).alias("oversold_threshold"),
        F.lit(55.0).alias("overbought_threshold"))
    return A.rules_on_quotes(rules, q, "Brand#11", P.corr_with(V.daily(s, d), "Brand#11"))


query("j09_rules_x_quotes", "symbol rule_id type direction | price change_percent gold_change_percent gold_correlation rsi", ctes=QUOTES, dp=8, sql="SELECT * FROM jr")(_joined)
FIRED = """CASE WHEN type = 'PriceBreakoutRule' AND ((direction = 'above' AND price >= 60) OR (direction = 'below' AND price <= 60)) THEN 'PRICE_BREAKOUT'
  WHEN type = 'PercentChangeRule' AND abs(change_percent) >= 20 THEN 'PERCENT_CHANGE'
  WHEN type = 'CorrelationDivergenceRule' AND gold_correlation >= -1 AND abs(change_percent - gold_change_percent) >= 5 AND sign(change_percent) * sign(gold_change_percent) < 0 THEN 'CORRELATION_DIVERGENCE'
  WHEN type = 'RSIAlertRule' AND rsi <= 45 THEN 'RSI_OVERSOLD' WHEN type = 'RSIAlertRule' AND rsi >= 55 THEN 'RSI_OVERBOUGHT' END"""
for _n, _types in (("t17_price_breakout_rule", ["PRICE_BREAKOUT"]), ("t18_percent_change_rule", ["PERCENT_CHANGE"]),
                   ("t19_divergence_rule", ["CORRELATION_DIVERGENCE"]), ("t20_rsi_rule", ["RSI_OVERSOLD", "RSI_OVERBOUGHT"])):
    query(_n, "symbol rule_id alert_type severity | change_percent rsi", dp=4, ctes=QUOTES,
          sql=f"SELECT * FROM (SELECT *, {FIRED} AS alert_type, CASE WHEN type = 'PercentChangeRule' AND abs(change_percent) >= 30 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM jr) z WHERE alert_type IN ({', '.join(repr(t) for t in _types)})")(
        lambda s, d, t=_types: A.check_rules(_joined(s, d)).where(F.col("alert_type").isin(t)))

# --- risk -----------------------------------------------------------------------------------
RET = DAILY + f", rt AS (SELECT * FROM (SELECT symbol, time, {chg('close')} AS returns FROM daily) q WHERE returns IS NOT NULL)"


def _ret(s, d):
    from tidemark import series as S

    x = S.open_series(V.daily(s, d), back=1, max_rows=V.days_bound(s, d))
    return x.add(returns=S.change(x, "close")).close().where("returns IS NOT NULL")


Z = NormalDist().inv_cdf(0.05)
PDF = NormalDist().pdf(Z) / 0.05
ZD = f"CAST({Z!r} AS DOUBLE)"
query("d12_historical_var", "symbol | var cvar", ctes=RET + ", qv AS (SELECT symbol, quantile_cont(returns, CAST(0.05 AS DOUBLE)) AS var FROM rt GROUP BY symbol)",
      sql="SELECT symbol, max(var) AS var, avg(CASE WHEN returns <= var THEN returns END) AS cvar FROM rt JOIN qv USING (symbol) GROUP BY symbol")(
    lambda s, d: R.historical_var(_ret(s, d), max_rows=V.days_bound(s, d)))
query("d13_parametric_var_normal", "symbol | var cvar", ctes=RET,
      sql=f"SELECT symbol, avg(returns) + {ZD} * stddev_samp(returns) AS var, avg(returns) - stddev_samp(returns) * CAST({PDF!r} AS DOUBLE) AS cvar FROM rt GROUP BY symbol")(
    lambda s, d: R.parametric_var(_ret(s, d)))
# Student t quantile: the density integrated by Simpson's rule after t = sqrt(dof) tan(a), bisected
STEPS = 2000
TQ = f"""mo AS (SELECT symbol, avg(returns) AS m, stddev_samp(returns) AS s, CAST(greatest(6 / greatest(kurtosis(returns), 0.1) + 4, 5) AS DOUBLE) AS dof FROM rt GROUP BY symbol),
bi AS (SELECT symbol, dof, CAST(-50 AS DOUBLE) AS lo, CAST(0 AS DOUBLE) AS hi, 0 AS i FROM mo
  UNION ALL SELECT symbol, dof, CASE WHEN p < 0.05 THEN mid ELSE lo END, CASE WHEN p < 0.05 THEN hi ELSE mid END, i + 1 FROM (SELECT *, 0.5 - exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(pi()) * top / {3 * STEPS}
    * list_sum(list_transform(range({STEPS + 1}), lambda k: CASE WHEN k IN (0, {STEPS}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(cos(top * k / {STEPS}), dof - 1))) AS p
    FROM (SELECT *, (lo + hi) / 2 AS mid, atan(-(lo + hi) / 2 / sqrt(dof)) AS top FROM bi WHERE i < 50) z) y),
tv AS (SELECT symbol, dof, m + (lo + hi) / 2 * s * sqrt((dof - 2) / dof) AS var FROM mo JOIN bi USING (symbol, dof) WHERE i = 50)"""
query("d14_parametric_var_t", "symbol | dof var cvar", ctes="RECURSIVE " + RET + "," + TQ, sql="SELECT symbol, dof, var, var * 1.2 AS cvar FROM tv")(lambda s, d: R.parametric_var(_ret(s, d), distribution="t_student"))
query("d15_parametric_var_cornish_fisher", "symbol | var cvar", ctes=RET + f", cfv AS (SELECT symbol, avg(returns) + ({ZD} + ({ZD} * {ZD} - 1) * skewness(returns) / 6 + (pow({ZD}, 3) - 3 * {ZD}) * (kurtosis(returns) - 3) / 24) * stddev_samp(returns) AS var FROM rt GROUP BY symbol)",
      sql="SELECT symbol, var, var * 1.15 AS cvar FROM cfv")(lambda s, d: R.parametric_var(_ret(s, d), distribution="skewed_t"))


def _u(k, i):
    return f"((CAST(concat('0x', substr(md5(concat(draw, '|42|{k}')), {1 + 8 * i}, 8)) AS UBIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE))"


def _z(k, j):
    return f"(sqrt(-2 * ln({_u(k, 2 * j)})) * cos(2 * pi() * {_u(k, 2 * j + 1)}))"


MCS = "st AS (SELECT symbol, avg(returns) AS m, stddev_samp(returns) AS s FROM rt GROUP BY symbol)"
query("d16_monte_carlo_var", "symbol | var cvar", ctes=RET + "," + MCS + f", dr AS (SELECT draw, {_z(0, 0)} AS z FROM range(10000) t(draw)), sm AS (SELECT symbol, m + s * z AS x FROM st, dr), qv AS (SELECT symbol, quantile_cont(x, CAST(0.05 AS DOUBLE)) AS var FROM sm GROUP BY symbol)",
      sql="SELECT symbol, max(var) AS var, avg(CASE WHEN x <= var THEN x END) AS cvar FROM sm JOIN qv USING (symbol) GROUP BY symbol")(
    lambda s, d: R.monte_carlo_var(_ret(s, d)))
CHI = " + ".join(f"pow({_z(k, j)}, 2)" for k, j in ((0, 1), (1, 0), (1, 1), (2, 0), (2, 1)))
query("d17_monte_carlo_stress", "symbol | worst_case worst_percentile expected_shortfall extreme_loss_probability",
      ctes=RET + "," + MCS + f", dr AS (SELECT draw, {_z(0, 0)} / sqrt(({CHI}) / 5) AS z FROM range(10000) t(draw)), sm AS (SELECT symbol, m + s * z AS x FROM st, dr), qv AS (SELECT symbol, quantile_cont(x, CAST(0.01 AS DOUBLE)) AS q FROM sm GROUP BY symbol)",
      sql="SELECT symbol, min(x) AS worst_case, max(q) AS worst_percentile, avg(CASE WHEN x <= q THEN x END) AS expected_shortfall, count_if(x <= q) / CAST(count(*) AS DOUBLE) AS extreme_loss_probability FROM sm JOIN qv USING (symbol) GROUP BY symbol")(
    lambda s, d: R.monte_carlo_stress(_ret(s, d)))
FOUR = f"""qh AS (SELECT symbol, quantile_cont(returns, CAST(0.05 AS DOUBLE)) AS q FROM rt GROUP BY symbol),
dr AS (SELECT draw, {_z(0, 0)} AS z FROM range(10000) t(draw)), sm AS (SELECT symbol, m + s * z AS x FROM mo, dr), qm AS (SELECT symbol, quantile_cont(x, CAST(0.05 AS DOUBLE)) AS q FROM sm GROUP BY symbol),
fo AS (SELECT symbol, 'Historical' AS method, max(q) AS var, avg(CASE WHEN returns <= q THEN returns END) AS cvar FROM rt JOIN qh USING (symbol) GROUP BY symbol
  UNION ALL SELECT symbol, 'Parametric Normal', m + {ZD} * s, m - s * CAST({PDF!r} AS DOUBLE) FROM mo UNION ALL SELECT symbol, 'Parametric t-Student', var, var * 1.2 FROM tv
  UNION ALL SELECT symbol, 'Monte Carlo', max(q), avg(CASE WHEN x <= q THEN x END) FROM sm JOIN qm USING (symbol) GROUP BY symbol)"""
query("d18_compare_var_methods", "symbol method | var cvar var_pct cvar_pct", ctes="RECURSIVE " + RET + "," + TQ + "," + FOUR,
      sql="SELECT symbol, method, var, cvar, var * 100 AS var_pct, cvar * 100 AS cvar_pct FROM fo")(lambda s, d: R.compare_var_methods(_ret(s, d)))

ASSETS = ["GLD", "SPY", "GDX", "goldfund", "miningco", "XYZ"]
SCN = ", ".join(
    f"('{n}', {p}, " + ", ".join(str(sh[k]) if k in sh else "NULL" for k in ("gold_return", "stocks_return", "mining_stocks")) + ")"
    for n, p, sh in R.SCENARIOS)
HOLDING = f"""ho AS (SELECT o_orderpriority AS portfolio, [{', '.join(repr(a) for a in ASSETS)}][CAST(o_custkey % 6 AS INT) + 1] AS asset, 1 + o_orderkey % 50 AS quantity, o_totalprice AS price FROM orders),
sc AS (SELECT * FROM (VALUES {SCN}) v(scenario, probability, g, st, mi)),
sh AS (SELECT *, CASE WHEN contains(lower(asset), 'gold') OR upper(asset) IN ('GLD', 'XAUUSD') THEN coalesce(g, 0) WHEN upper(asset) IN ('SPY', 'QQQ', 'DIA') THEN coalesce(st, 0)
  WHEN contains(lower(asset), 'mining') OR upper(asset) IN ('GDX', 'GDXJ') THEN coalesce(mi, coalesce(st, 0) * 1.5) ELSE coalesce(st, 0) * 0.8 END AS shock FROM ho, sc),
sv AS (SELECT portfolio, scenario, max(probability) AS probability, sum(quantity * price) AS cv, sum(quantity * price * (1 + shock)) AS sv FROM sh GROUP BY 1, 2)"""


def _holdings(s, d):
    return V.table(s, d, "orders").select(
        F.col("o_orderpriority").alias("portfolio"),
        F.element_at(F.array(*map(F.lit, ASSETS)), (F.col("o_custkey") % 6 + 1).cast("int")).alias("asset"),
        (F.lit(1) + F.col("o_orderkey") % 50).alias("quantity"), F.col("o_totalprice").alias("price"))


SCX = "SELECT portfolio, scenario, probability, cv AS current_value, sv AS shocked_value, sv - cv AS loss, (sv - cv) / cv AS loss_pct, (sv - cv) * probability AS expected_loss FROM sv"
query("d19_scenario_analysis", "portfolio scenario | probability current_value shocked_value loss loss_pct expected_loss", dp=2, ctes=HOLDING, sql=SCX)(
    lambda s, d: R.scenario_analysis(_holdings(s, d)))
query("k07_worst_scenario", "portfolio worst_scenario | expected_loss expected_loss_pct probability risk_weighted_loss", dp=3, ctes=HOLDING,
      sql=f"SELECT portfolio, scenario AS worst_scenario, loss AS expected_loss, loss_pct AS expected_loss_pct, probability, expected_loss AS risk_weighted_loss FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY loss_pct, scenario) AS k FROM ({SCX}) q) z WHERE k = 1")(
    lambda s, d: R.worst_scenario(R.scenario_analysis(_holdings(s, d))))
query("j10_portfolio_x_scenarios", "o_orderkey scenario | shock", ctes=HOLDING.replace("SELECT o_orderpriority", "SELECT o_orderkey, o_orderpriority"), sql="SELECT o_orderkey, scenario, shock FROM sh")(
    lambda s, d: _shocks(s, d))
query("t22_shock", "portfolio asset scenario | shock | n", ctes=HOLDING, sql="SELECT portfolio, asset, scenario, max(shock) AS shock, count(*) AS n FROM sh GROUP BY 1, 2, 3")(
    lambda s, d: _holdings(s, d).withColumn("_s", F.explode(R.scenario_column())).select("portfolio", "asset", "_s.scenario", R.shock(F.col("asset"), F.col("_s.shocks")).alias("shock"))
    .groupBy("portfolio", "asset", "scenario").agg(F.max("shock").alias("shock"), F.count(F.lit(1)).alias("n")))


def _shocks(s, d):
    o = V.table(s, d, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, ASSETS)), (F.col("o_custkey") % 6 + 1).cast("int")).alias("asset"))
    return o.withColumn("_s", F.explode(R.scenario_column())).select("o_orderkey", "_s.scenario", R.shock(F.col("asset"), F.col("_s.shocks")).alias("shock"))


# --- backtests ---------------------------------------------------------------------------------
BT = f"""b0 AS (SELECT symbol, {{k}}time, close, direction FROM ({{src}}) q),
b1 AS (SELECT *, coalesce(greatest(last_value(CASE WHEN direction <> 0 THEN CAST(direction AS DOUBLE) END IGNORE NULLS) OVER ({{p}}), 0), 0) AS target FROM b0),
b2 AS (SELECT *, coalesce(lag(target) OVER ({{p}}), 0) AS position, coalesce(close / lag(close) OVER ({{p}}) - 1, 0) AS bar_return FROM b1),
b3 AS (SELECT *, abs(position - coalesce(lag(position) OVER ({{p}}), 0)) AS turnover FROM b2),
b4 AS (SELECT *, position * bar_return - turnover * 0.002 AS strategy_return FROM b3),
bt AS (SELECT *, product(1 + strategy_return) OVER ({{p}}) AS equity FROM b4)"""
MAS = f"SELECT symbol, time, close, CASE WHEN count(close) OVER {win(51)} >= 50 THEN CASE WHEN {avg('close', 20)} > avg(close) OVER {win(51)} THEN 1 WHEN {avg('close', 20)} < avg(close) OVER {win(51)} THEN -1 ELSE 0 END END AS direction FROM bars"
BACK = BARS + "," + BT.format(k="", src=MAS, p=PT)
PERF = """pr AS (SELECT *, CASE WHEN abs(equity / lag(equity) OVER (PARTITION BY {g} ORDER BY time) - 1) < 1e-12 THEN 0 ELSE equity / lag(equity) OVER (PARTITION BY {g} ORDER BY time) - 1 END AS r, equity / max(equity) OVER (PARTITION BY {g} ORDER BY time) - 1 AS dd FROM bt),
pm AS (SELECT {g}, (arg_max(equity, time) / 1 - 1) * 100 AS total_return, date_diff('day', min(CAST(time AS DATE)), max(CAST(time AS DATE))) AS days, avg(r) AS m, stddev_samp(r) AS s, min(dd) AS dd, stddev_samp(CASE WHEN r < 0 THEN r END) AS dn, count(*) AS n FROM pr GROUP BY {g}),
pa AS (SELECT *, (pow(1 + total_return / 100, CAST(365 AS DOUBLE) / greatest(days, 1)) - 1) * 100 AS annual_return, abs(dd) * 100 AS max_drawdown, s * sqrt(252) * 100 AS volatility, (m - CAST(0.02 AS DOUBLE) / 252) * sqrt(252) / (s + 1e-10) AS sharpe_ratio FROM pm)"""


def _curve(s, d):
    m = V.hours_bound(s, d)
    return PF.signal_backtest(SG.ma_signal(V.bars(s, d), max_rows=m), max_rows=m)


query("d23_signal_backtest", "symbol time | position turnover strategy_return equity", ctes=BACK, sql="SELECT * FROM bt")(_curve)


def _trades(s, d):
    return V.trades(s, d).select("symbol", F.col("day").alias("time"), (F.col("amount") - 38000).alias("pnl"), F.col("qty").alias("holding_period"))


TRD = "tr AS (SELECT ['click','view','error','purchase','signup'][CAST(l_orderkey % 5 AS INT) + 1] AS symbol, l_extendedprice - 38000 AS pnl, l_quantity AS holding_period FROM lineitem), "\
      "tp AS (SELECT symbol, count_if(pnl > 0) / CAST(count(*) AS DOUBLE) * 100 AS win_rate, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / (abs(sum(CASE WHEN pnl <= 0 THEN pnl ELSE 0 END)) + 1e-10) AS profit_factor, avg(pnl) AS avg_trade_pnl, avg(holding_period) AS avg_holding_period, count(*) AS total_trades FROM tr GROUP BY symbol)"


def _tr(s, d):
    return V.table(s, d, "lineitem").select(
        F.element_at(F.array(*map(F.lit, ["click", "view", "error", "purchase", "signup"])), (F.col("l_orderkey") % 5 + 1).cast("int")).alias("symbol"),
        (F.col("l_extendedprice") - 38000).alias("pnl"), F.col("l_quantity").alias("holding_period"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("trade_id"), F.col("l_shipdate").alias("time"))


query(
    "d20_performance_metrics", "symbol | total_return annual_return max_drawdown volatility sharpe_ratio calmar_ratio sortino_ratio win_rate profit_factor avg_trade_pnl avg_holding_period | total_trades", dp=4,
    ctes=BACK + "," + PERF.format(g="symbol") + "," + TRD,
    sql="""SELECT symbol, total_return, annual_return, max_drawdown, volatility, sharpe_ratio, annual_return / (max_drawdown + 1e-10) AS calmar_ratio, (annual_return / 100 - CAST(0.02 AS DOUBLE)) / (dn * sqrt(252) + 1e-10) AS sortino_ratio,
  coalesce(win_rate, 0) AS win_rate, coalesce(profit_factor, 0) AS profit_factor, coalesce(avg_trade_pnl, 0) AS avg_trade_pnl, coalesce(avg_holding_period, 0) AS avg_holding_period, coalesce(total_trades, 0) AS total_trades FROM pa LEFT JOIN tp USING (symbol)""",
)(lambda s, d: PF.performance_metrics(_curve(s, d), _tr(s, d), max_rows=V.hours_bound(s, d)))
ACT = """ac AS (SELECT ['click','view','error','purchase','signup'][CAST(o_custkey % 5 AS INT) + 1] AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS action, o_totalprice AS amount, o_orderdate AS time, o_orderkey AS trade_id FROM orders),
an AS (SELECT *, row_number() OVER (PARTITION BY symbol, action ORDER BY time, trade_id) AS k FROM ac),
aw AS (SELECT b.symbol, count(*) AS total_trades, count_if(s.amount > b.amount) / CAST(count(*) AS DOUBLE) AS win_rate FROM an b JOIN an s ON b.symbol = s.symbol AND b.k = s.k AND b.action = 'BUY' AND s.action = 'SELL' GROUP BY 1)"""


def _actions(s, d):
    return V.table(s, d, "orders").select(
        F.element_at(F.array(*map(F.lit, ["click", "view", "error", "purchase", "signup"])), (F.col("o_custkey") % 5 + 1).cast("int")).alias("symbol"),
        F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("action"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("time"), F.col("o_orderkey").alias("trade_id"))


query(
    "d21_simple_report", "symbol | final_equity total_return annual_return sharpe_ratio max_drawdown win_rate | total_trades", dp=5, ctes=BACK + "," + PERF.format(g="symbol") + "," + ACT,
    sql="""SELECT symbol, total_return / 100 + 1 AS final_equity, total_return / 100 AS total_return, pow(1 + total_return / 100, CAST(252 AS DOUBLE) / n) - 1 AS annual_return,
  CASE WHEN s > 0 THEN m / s * sqrt(252) ELSE 0 END AS sharpe_ratio, dd AS max_drawdown, coalesce(win_rate, 0) AS win_rate, coalesce(total_trades, 0) AS total_trades FROM pa LEFT JOIN aw USING (symbol)""",
)(lambda s, d: PF.simple_report(_curve(s, d), _actions(s, d), max_rows=V.hours_bound(s, d)))
query(
    "d22_formatted_report", "symbol total_return_text max_drawdown_text volatility_text | start_equity end_equity peak trough", dp=5, ctes=BACK + "," + PERF.format(g="symbol"),
    sql="""SELECT symbol, printf('%.2f%%', total_return) AS total_return_text, printf('%.2f%%', max_drawdown) AS max_drawdown_text, printf('%.2f%%', volatility) AS volatility_text, start_equity, end_equity, peak, trough
  FROM pa JOIN (SELECT symbol, arg_min(equity, time) AS start_equity, arg_max(equity, time) AS end_equity, max(equity) AS peak, min(equity) AS trough FROM bt GROUP BY symbol) q USING (symbol)""",
)(lambda s, d: PF.formatted_report(PF.performance_metrics(_curve(s, d), max_rows=V.hours_bound(s, d)), _curve(s, d)))
FASTS, SLOWS = (5, 10, 15, 20), (20, 30, 40, 50, 60)
SWEEP = BARS + ", sm AS (SELECT symbol, time, close, " + ", ".join(f"{avg('close', n)} AS m{n}" for n in sorted({*FASTS, *SLOWS})) + " FROM bars), sp AS (" + " UNION ALL ".join(
    f"SELECT symbol, {a} AS fast, {b} AS slow, time, close, sign(m{a} - m{b}) AS direction FROM sm" for a in FASTS for b in SLOWS if a < b) + "), " + BT.format(
    k="fast, slow, ", src="SELECT * FROM sp", p="PARTITION BY symbol, fast, slow ORDER BY time") + "," + PERF.format(g="symbol, fast, slow") + \
    ", tc AS (SELECT symbol, fast, slow, count_if(turnover > 0) AS trades FROM bt GROUP BY 1, 2, 3)"


def _sweep(s, d):
    return PF.ma_sweep(V.bars(s, d), FASTS, SLOWS, max_rows=V.hours_bound(s, d))


query("d24_param_sweep", "symbol | sharpe_ratio total_return max_drawdown | fast slow trades", dp=4, ctes=SWEEP,
      sql="SELECT symbol, fast, slow, sharpe_ratio, total_return, max_drawdown, trades FROM pa JOIN tc USING (symbol, fast, slow)")(_sweep)
query("k06_best_worst_params", "symbol | best_metric worst_metric | best_fast best_slow worst_fast worst_slow n_combinations", dp=4, ctes=SWEEP,
      sql="""SELECT symbol, max(sharpe_ratio) AS best_metric, min(sharpe_ratio) AS worst_metric, arg_max(fast, sharpe_ratio) AS best_fast, arg_max(slow, sharpe_ratio) AS best_slow,
  arg_min(fast, sharpe_ratio) AS worst_fast, arg_min(slow, sharpe_ratio) AS worst_slow, count(*) AS n_combinations FROM pa GROUP BY symbol""")(lambda s, d: PF.best_and_worst(_sweep(s, d)))
query("a15_pivot_grid", "| " + " ".join(f"s{n}" for n in SLOWS) + " | fast", dp=4, ctes=SWEEP,
      sql="SELECT fast, " + ", ".join(f"avg(CASE WHEN slow = {n} THEN sharpe_ratio END) AS s{n}" for n in SLOWS) + " FROM pa GROUP BY fast")(
    lambda s, d: PF.pivot_grid(_sweep(s, d), "fast", "slow", SLOWS, "sharpe_ratio").withColumnsRenamed({str(n): f"s{n}" for n in SLOWS}))
WF = BARS + """, wr AS (SELECT symbol, time, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
wf AS (SELECT *, n - i * 22 AS te, n - i * 22 - 20 AS ts, n - i * 22 - 22 AS tre, {start} AS trs FROM wr, range(5) t(i))"""
for _n, _m, _st in (("d25_walk_forward_expanding", "expanding", "0"), ("d25_walk_forward_rolling", "rolling", "greatest(0, n - i * 22 - 20 - (n - 5 * 22))")):
    query(_n, "symbol time role | | fold row", ctes=WF.format(start=_st),
          sql="SELECT symbol, time, k + 1 AS row, 4 - i AS fold, CASE WHEN k >= trs AND k < tre THEN 'train' ELSE 'test' END AS role FROM wf WHERE tre > trs AND ((k >= trs AND k < tre) OR (k >= ts AND k < te))")(
        lambda s, d, m=_m: PF.walk_forward_splits(V.bars(s, d), 5, 20, 2, m, max_rows=V.hours_bound(s, d)))
query("d26_chrono_split", "symbol time is_test | | row", ctes=BARS,
      sql=f"SELECT symbol, time, row_number() OVER ({PT}) AS row, row_number() OVER ({PT}) > count(*) OVER (PARTITION BY symbol) - ceil(count(*) OVER (PARTITION BY symbol) * 0.2) AS is_test FROM bars")(
    lambda s, d: PF.chrono_split(V.bars(s, d), max_rows=V.hours_bound(s, d)))
query("t23_forecast_direction", "symbol time direction | predicted_price confidence", ctes=BARS + f", fd AS (SELECT symbol, time, close, {chg('close')} AS r, (high - low) / close / 20 AS u FROM bars)",
      sql="SELECT symbol, time, CASE WHEN r > 0.005 THEN 'up' WHEN r < -0.005 THEN 'down' ELSE 'neutral' END AS direction, close * (1 + r) AS predicted_price, greatest(0, least(1, 1 - u * 10)) AS confidence FROM fd")(
    lambda s, d: PF.forecast_direction(hourly_returns(s, d).withColumn("r", F.col("returns")).withColumn("u", (F.col("high") - F.col("low")) / F.col("close") / 20), "r", "u", "close"))
LOSS = {"a": 0.1, "b": 0.2, "c": 0.4}
INV = {k: 1 / (v + 1e-6) for k, v in LOSS.items()}
WT = {k: v / sum(INV.values()) for k, v in INV.items()}
query("t24_ensemble_combine", "o_orderkey | prediction confidence", ctes="en AS (SELECT o_orderkey, o_totalprice / 1e7 AS a, o_custkey / 1e6 AS b, o_orderkey / 1e7 AS c FROM orders)",
      sql=f"SELECT o_orderkey, a * {WT['a']!r} + b * {WT['b']!r} + c * {WT['c']!r} AS prediction, greatest(0, 1 - sqrt((pow(a - (a + b + c) / 3, 2) + pow(b - (a + b + c) / 3, 2) + pow(c - (a + b + c) / 3, 2)) / 3) * 10) AS confidence FROM en")(
    lambda s, d: PF.ensemble_combine(V.table(s, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1e7).alias("a"), (F.col("o_custkey") / 1e6).alias("b"), (F.col("o_orderkey") / 1e7).alias("c")),
                                     {"a": "a", "b": "b", "c": "c"}, LOSS))
