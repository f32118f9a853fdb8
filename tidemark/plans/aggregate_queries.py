"""Registered queries: bars, sentiment, holders, costs, monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import costs as C
from tidemark.operators import holders as H
from tidemark.operators import monitoring as M
from tidemark.operators import pairs as P
from tidemark.operators import sentiment as SE
from tidemark.plans import views as V
from tidemark.plans.registry import query
from tidemark.plans.sqlparts import lag
from tidemark.plans.views import BARS, CALLS, DAILY, HOLDERS, NEWS, PREDICTIONS, REQUESTS, TICKS

OHLCV = """first(price ORDER BY time, event_id) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY time, event_id) AS close, sum(volume) AS volume"""
query("a01_bars_hourly", "symbol bucket | open high low close volume", ctes=TICKS,
      sql=f"SELECT symbol, date_trunc('hour', time) AS bucket, {OHLCV} FROM ticks GROUP BY 1, 2")(
    lambda s, d: B.hourly(V.ticks(s, d)))
query("a02_bars_daily", "symbol bucket | open high low close volume avg_price price_stddev", ctes=TICKS,
      sql=f"SELECT symbol, CAST(date_trunc('day', time) AS TIMESTAMP) AS bucket, {OHLCV}, avg(price) AS avg_price, stddev_samp(price) AS price_stddev FROM ticks GROUP BY 1, 2")(
    lambda s, d: B.daily(V.ticks(s, d)))
query(
    "a03_daily_sentiment_summary", "bucket symbol | avg_sentiment sentiment_stddev | news_count positive_count negative_count neutral_count", ctes=NEWS,
    sql="""SELECT CAST(date_trunc('day', time) AS TIMESTAMP) AS bucket, symbol, count(*) AS news_count, avg(score) AS avg_sentiment, stddev_samp(score) AS sentiment_stddev,
  count_if(label = 'positive') AS positive_count, count_if(label = 'negative') AS negative_count, count_if(label = 'neutral') AS neutral_count FROM news WHERE symbol IS NOT NULL GROUP BY 1, 2""",
)(lambda s, d: SE.daily_summary(V.news(s, d)))
PD = "PARTITION BY symbol ORDER BY date"
query(
    "a04_daily_metrics", "symbol date | avg_sentiment sentiment_std avg_neutral sentiment_index bullish_ratio bearish_ratio sentiment_change_1d sentiment_change_5d heat_index | news_volume positive_count",
    ctes=NEWS + f""", g AS (SELECT symbol, CAST(time AS DATE) AS date, avg(score) AS avg_sentiment, stddev_samp(score) AS sentiment_std, count(score) AS news_volume, avg(p_neu) AS avg_neutral,
  count_if(label = 'positive') AS positive_count FROM news GROUP BY 1, 2), h AS (SELECT *, news_volume * (1 - avg_neutral) AS heat FROM g)""",
    sql=f"""SELECT symbol, date, avg_sentiment, sentiment_std, avg_neutral, news_volume, positive_count, (avg_sentiment + 1) * 50 AS sentiment_index,
  positive_count / CAST(news_volume AS DOUBLE) AS bullish_ratio, 1 - positive_count / CAST(news_volume AS DOUBLE) - avg_neutral AS bearish_ratio,
  avg_sentiment - {lag('avg_sentiment', 1, PD)} AS sentiment_change_1d, avg_sentiment - {lag('avg_sentiment', 5, PD)} AS sentiment_change_5d,
  (heat - min(heat) OVER (PARTITION BY symbol)) / (max(heat) OVER (PARTITION BY symbol) - min(heat) OVER (PARTITION BY symbol) + 1e-6) * 100 AS heat_index FROM h""",
)(lambda s, d: SE.daily_metrics(V.news(s, d)))
query(
    "a05_sentiment_summary", "symbol | avg_score std_score min_score max_score bullish_ratio bearish_ratio avg_confidence sentiment_index | count positive_count negative_count neutral_count", ctes=NEWS,
    sql="""SELECT symbol, count(*) AS count, avg(score) AS avg_score, stddev_pop(score) AS std_score, min(score) AS min_score, max(score) AS max_score,
  count_if(label = 'positive') AS positive_count, count_if(label = 'negative') AS negative_count, count_if(label = 'neutral') AS neutral_count,
  count_if(label = 'positive') / CAST(count(*) AS DOUBLE) AS bullish_ratio, count_if(label = 'negative') / CAST(count(*) AS DOUBLE) AS bearish_ratio,
  avg(greatest(p_pos, p_neg, p_neu)) AS avg_confidence, (avg(score) + 1) * 50 AS sentiment_index FROM news GROUP BY symbol""",
)(lambda s, d: SE.summary(V.news(s, d).withColumn("confidence", F.greatest("p_pos", "p_neg", "p_neu"))))
for _iv, _unit, _step, _shift, _kind in (("1H", "hour", "1 HOUR", 0, "hourly"), ("1D", "day", "1 DAY", 0, "daily"), ("1W", "week", "7 DAYS", 6, "hourly")):
    query(
        f"a06_by_interval_{_iv.lower()}", "symbol time interval_type | score_mean score_std score_min score_max sentiment_index | score_count positive_count",
        ctes=NEWS + f""", g AS (SELECT symbol, CAST(date_trunc('{_unit}', time) AS TIMESTAMP) AS b, avg(score) AS score_mean, stddev_samp(score) AS score_std, min(score) AS score_min, max(score) AS score_max,
  count(score) AS score_count, count_if(label = 'positive') AS positive_count FROM news GROUP BY 1, 2),
cal AS (SELECT symbol, unnest(generate_series(min(b), max(b), INTERVAL {_step})) AS b FROM g GROUP BY symbol)""",
        sql=f"""SELECT symbol, b + INTERVAL {_shift} DAYS AS time, '{_kind}' AS interval_type, score_mean, score_std, score_min, score_max, (score_mean + 1) * 50 AS sentiment_index,
  coalesce(score_count, 0) AS score_count, coalesce(positive_count, 0) AS positive_count FROM cal LEFT JOIN g USING (symbol, b)""",
    )(lambda s, d, iv=_iv: SE.by_interval(V.news(s, d), iv))
ASOF = "2024-01-07 12:00:00"
LBL = "CASE WHEN {0} > 0.2 THEN 'positive' WHEN {0} < -0.2 THEN 'negative' ELSE 'neutral' END"
DASH_TAIL = """l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS back, least(count(*) OVER (PARTITION BY symbol), 10) AS m FROM news),
t AS (SELECT symbol, max(m) AS m, avg(score) AS avg, count(*) AS n, avg(CASE WHEN label = 'positive' THEN 1.0 ELSE 0.0 END) AS bull, avg(CASE WHEN label = 'negative' THEN 1.0 ELSE 0.0 END) AS bear,
  avg(CASE WHEN back <= 5 THEN score END) - avg(CASE WHEN back > m - 5 THEN score END) AS change FROM l WHERE back <= 10 GROUP BY symbol),
r AS (SELECT symbol, avg(score) AS avg, count(*) AS n, avg(CASE WHEN label = 'positive' THEN 1.0 ELSE 0.0 END) AS bull, avg(CASE WHEN label = 'negative' THEN 1.0 ELSE 0.0 END) AS bear
  FROM news WHERE time >= TIMESTAMP '{0}' - INTERVAL 24 HOURS GROUP BY symbol),
z AS (SELECT t.symbol, t.m, t.change, coalesce(r.avg, t.avg) AS a, coalesce(r.n, t.n) AS n, coalesce(r.bull, t.bull) AS bull, coalesce(r.bear, t.bear) AS bear FROM t LEFT JOIN r USING (symbol))"""
for _name, _asof in (("a07_sentiment_dashboard", ASOF), ("a07_sentiment_dashboard_stale", "2034-01-01 00:00:00")):
    query(
        _name, "symbol sentiment_label trend | current_sentiment bullish_ratio bearish_ratio heat_index | news_volume_24h",
        ctes=NEWS + "," + DASH_TAIL.replace("{0}", _asof),
        sql=f"""SELECT symbol, {LBL.format('a')} AS sentiment_label, CASE WHEN m < 5 THEN 'stable' WHEN change > 0.05 THEN 'improving' WHEN change < -0.05 THEN 'declining' ELSE 'stable' END AS trend,
  a AS current_sentiment, bull AS bullish_ratio, bear AS bearish_ratio, n AS news_volume_24h,
  greatest(0, least(100, ((a + 1) * 50 * 0.6 + bull * 100 * 0.4) * least(1.5, greatest(0.5, n / CAST(10 AS DOUBLE))))) AS heat_index FROM z""",
    )(lambda s, d, a=_asof: SE.dashboard(V.news(s, d), a))


def _scores(s, d):
    n = SE.daily_summary(V.news(s, d))
    return n.select("symbol", F.col("bucket").alias("time"), "avg_sentiment", "news_count",
                    (F.col("positive_count") / F.col("news_count")).alias("positive_ratio"),
                    (F.col("negative_count") / F.col("news_count")).alias("negative_ratio"))


query(
    "a08_score_dashboard", "symbol trend | current_sentiment avg_7d positive_ratio negative_ratio | news_count",
    ctes=NEWS + f""", sc AS (SELECT symbol, CAST(time AS DATE) AS t, avg(score) AS a, count(*) AS n, count_if(label = 'positive') / CAST(count(*) AS DOUBLE) AS p, count_if(label = 'negative') / CAST(count(*) AS DOUBLE) AS q FROM news GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS back FROM sc WHERE t >= TIMESTAMP '{ASOF}' - INTERVAL 30 DAYS),
g AS (SELECT symbol, max(CASE WHEN back = 1 THEN a END) AS cur, avg(a) AS a7, sum(n) AS n, max(CASE WHEN back = 1 THEN p END) AS p, max(CASE WHEN back = 1 THEN q END) AS q FROM k WHERE back <= 7 GROUP BY symbol)""",
    sql="""SELECT symbol, CASE WHEN cur > a7 + 0.1 THEN 'improving' WHEN cur < a7 - 0.1 THEN 'declining' ELSE 'stable' END AS trend, cur AS current_sentiment, a7 AS avg_7d,
  p AS positive_ratio, q AS negative_ratio, n AS news_count FROM g""",
)(lambda s, d: SE.score_dashboard(_scores(s, d), V.news(s, d), ASOF))
query("a11_latest_per_symbol", "symbol time | open close volume", ctes=BARS,
      sql="SELECT symbol, time, open, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS k FROM bars) x WHERE k = 1")(
    lambda s, d: B.latest_per_symbol(V.bars(s, d), ["time", "open", "close", "volume"]))
query("a12_sentiment_index", "symbol | sentiment_index", ctes=NEWS,
      sql="SELECT symbol, ((avg(score) + sum(score * length(content)) / CAST(sum(length(content)) AS DOUBLE)) / 2 + 1) * 50 AS sentiment_index FROM news GROUP BY symbol")(
    lambda s, d: SE.sentiment_index(V.news(s, d).withColumn("volume", F.length("content")), volume="volume"))
FIB = BARS + """, rng AS (SELECT symbol, max(close) AS hi, max(close) - min(close) AS sp, arg_max(close, time) AS last FROM bars GROUP BY symbol),
lv AS (SELECT symbol, pos, level, hi - sp * r AS price, abs(hi - sp * r - last) AS distance FROM rng, (VALUES (0, 'level_0', 0.0), (1, 'level_236', 0.236), (2, 'level_382', 0.382), (3, 'level_500', 0.5), (4, 'level_618', 0.618), (5, 'level_100', 1.0)) v(pos, level, r)),
ex AS (SELECT symbol, level, hi + sp * r AS price FROM rng, (VALUES ('ext_1272', 0.272), ('ext_1618', 0.618), ('ext_2618', 1.618)) v(level, r))"""
query("a16_fibonacci_levels", "symbol level | price", ctes=FIB, sql="SELECT symbol, level, price FROM lv UNION ALL SELECT symbol, level, price FROM ex")(
    lambda s, d: B.fibonacci_levels(V.bars(s, d)).select("symbol", "level", "price").unionByName(
        B.fibonacci_extensions(V.bars(s, d)).select("symbol", "level", "price")))
query("a17_nearest_fibonacci", "symbol level | price distance", ctes=FIB,
      sql="SELECT symbol, level, price, distance FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY distance, pos) AS k FROM lv) x WHERE k = 1")(
    lambda s, d: B.nearest_fibonacci(V.bars(s, d)))
query(
    "a18_etf_holdings_stats", "symbol trend | current_holdings change_1d change_5d change_20d", ctes=BARS + ", h AS (SELECT symbol, time, volume AS v, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS b FROM bars)",
    sql="""SELECT symbol, max(CASE WHEN b = 1 THEN v END) AS current_holdings, max(CASE WHEN b = 1 THEN v END) - max(CASE WHEN b = 2 THEN v END) AS change_1d,
  max(CASE WHEN b = 1 THEN v END) - max(CASE WHEN b = 6 THEN v END) AS change_5d, max(CASE WHEN b = 1 THEN v END) - max(CASE WHEN b = 21 THEN v END) AS change_20d,
  CASE WHEN max(CASE WHEN b = 1 THEN v END) - max(CASE WHEN b = 6 THEN v END) > 0 THEN 'increasing' ELSE 'decreasing' END AS trend FROM h GROUP BY symbol""",
)(lambda s, d: B.etf_holdings_stats(V.bars(s, d), "volume"))
query(
    "a19_cot_positioning", "symbol sentiment contrarian_signal | commercial_net speculative_net commercial_net_change_5w speculative_net_change_5w",
    ctes=BARS + """, n AS (SELECT symbol, time, high - open AS c, close - low AS s, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS b FROM bars),
g AS (SELECT symbol, max(CASE WHEN b = 1 THEN c END) AS c1, max(CASE WHEN b = 1 THEN s END) AS s1, max(CASE WHEN b = 2 THEN c END) AS c2, max(CASE WHEN b = 2 THEN s END) AS s2,
  max(CASE WHEN b = 6 THEN c END) AS c6, max(CASE WHEN b = 6 THEN s END) AS s6, quantile_cont(s, 0.2) AS q2, quantile_cont(s, 0.4) AS q4, quantile_cont(s, 0.6) AS q6, quantile_cont(s, 0.8) AS q8 FROM n GROUP BY symbol)""",
    sql="""SELECT symbol, c1 AS commercial_net, s1 AS speculative_net, c1 - c6 AS commercial_net_change_5w, s1 - s6 AS speculative_net_change_5w, (c1 > c2 AND s1 < s2) AS contrarian_signal,
  CASE WHEN s1 > q8 THEN 'extremely_bullish' WHEN s1 > q6 THEN 'bullish' WHEN s1 < q2 THEN 'extremely_bearish' WHEN s1 < q4 THEN 'bearish' ELSE 'neutral' END AS sentiment FROM g""",
)(lambda s, d: B.cot_positioning(V.bars(s, d).select(
    "symbol", "time", F.col("high").alias("commercial_long"), F.col("open").alias("commercial_short"),
    F.col("close").alias("non_commercial_long"), F.col("low").alias("non_commercial_short")), max_rows=V.hours_bound(s, d)))

# --- correlation joins -----------------------------------------------------------------
query(
    "j04_corr_with_gold", "symbol | correlation | n", ctes=DAILY, dp=4,
    sql="SELECT a.symbol, count(*) AS n, CASE WHEN count(*) >= 10 THEN corr(a.close, g.close) END AS correlation FROM daily a JOIN daily g ON a.time = g.time AND g.symbol = 'Brand#11' GROUP BY a.symbol",
)(lambda s, d: P.corr_with(V.daily(s, d), "Brand#11"))
SY = ["Brand#11", "Brand#12", "Brand#2", "Brand#3"]
query(
    "j05_corr_matrix", "a b | correlation | n",
    ctes=DAILY + f""", pk AS (SELECT * FROM daily WHERE symbol IN ({', '.join(repr(x) for x in SY)})),
full_days AS (SELECT time FROM pk GROUP BY time HAVING count(DISTINCT symbol) = {len(SY)})""",
    sql="""SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, corr(x.close, y.close) AS correlation FROM pk x JOIN pk y ON x.time = y.time AND x.symbol < y.symbol
  WHERE x.time IN (SELECT time FROM full_days) GROUP BY 1, 2""",
)(lambda s, d: P.corr_matrix(V.daily(s, d), SY))
query("j06_correlated_pairs", "a b | correlation | n", ctes=BARS,
      sql="SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, corr(x.volume, y.volume) AS correlation FROM bars x JOIN bars y ON x.time = y.time AND x.symbol < y.symbol GROUP BY 1, 2")(
    lambda s, d: P.pair_correlation(V.bars(s, d), "volume"))
query(
    "j13_outer_align", "symbol time | sentiment close",
    ctes=BARS + "," + NEWS + ", s AS (SELECT ['click','view','error','purchase','signup'][CAST(doc_id % 5 AS INT) + 1] AS symbol, date_trunc('hour', time) AS time, avg(score) AS sentiment FROM news GROUP BY 1, 2)",
    sql="SELECT symbol, time, sentiment, close FROM s FULL OUTER JOIN bars USING (symbol, time)",
)(lambda s, d: SE.outer_align(
    V.news(s, d).groupBy(F.element_at(F.array(*map(F.lit, ["click", "view", "error", "purchase", "signup"])), (F.col("doc_id") % 5 + 1).cast("int")).alias("symbol"),
                         F.date_trunc("hour", "time").alias("time")).agg(F.avg("score").alias("sentiment")), V.bars(s, d)))

# --- holders -------------------------------------------------------------------------------
HOLD = HOLDERS + """, hp AS (SELECT *, shares / 1000000 AS pct_held FROM holders),
hr AS (SELECT *, row_number() OVER (PARTITION BY symbol, report_date ORDER BY shares DESC, name) AS rank FROM hp),
snap AS (SELECT symbol, report_date, sum(shares) AS total_shares, sum(pct_held) AS total_pct, count(*) AS num_holders,
  sum(CASE WHEN rank <= 10 THEN shares END) / (sum(shares) + 1e-10) * 100 AS concentration, list(name ORDER BY rank) FILTER (rank <= 20) AS top_holders FROM hr GROUP BY 1, 2),
st AS (SELECT symbol, report_date, lag(report_date) OVER (PARTITION BY symbol ORDER BY report_date) AS prev_date FROM (SELECT DISTINCT symbol, report_date FROM hp)),
cj AS (SELECT n.symbol, n.report_date, n.name, n.shares, p.shares AS prev FROM hp n JOIN st USING (symbol, report_date)
  LEFT JOIN hr p ON p.symbol = n.symbol AND p.report_date = st.prev_date AND p.name = n.name AND p.rank <= 20 WHERE st.prev_date IS NOT NULL),
cp AS (SELECT *, CASE WHEN prev IS NULL THEN 100 ELSE shares / prev * 100 - 100 END AS change_pct FROM cj),
chg AS (SELECT symbol, report_date, name, coalesce(prev, 0) AS prev_shares, shares AS new_shares, shares - coalesce(prev, 0) AS change_shares, change_pct, significance FROM (
  SELECT *, CASE WHEN prev IS NULL THEN CASE WHEN contains(lower(name), 'customer#00000012') THEN 'major' END WHEN abs(change_pct) > 50 THEN 'major' WHEN abs(change_pct) > 20 THEN 'moderate' WHEN abs(change_pct) > 5 THEN 'minor' END AS significance FROM cp) q
  WHERE significance IS NOT NULL)"""
NOTE = ("Customer#00000012",)


def _hold(s, d):
    return V.holders(s, d).withColumn("pct_held", F.col("shares") / 1000000)


query("a20_holder_snapshot", "symbol report_date top_holders | total_shares total_pct concentration | num_holders", dp=4, ctes=HOLD,
      sql="SELECT * FROM snap")(lambda s, d: H.snapshot(_hold(s, d)))
query("k10_top_holders", "symbol report_date name | shares | rank", dp=2, ctes=HOLD, sql="SELECT symbol, report_date, name, shares, rank FROM hr WHERE rank <= 10")(
    lambda s, d: H.top_holders(_hold(s, d), 10))
query("a21_holder_comparison", "symbol snapshot_date | total_pct concentration_top10 | num_holders", dp=4, ctes=HOLD,
      sql="SELECT symbol, report_date AS snapshot_date, total_pct, concentration AS concentration_top10, num_holders FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY report_date DESC) AS k FROM snap) x WHERE k = 1")(
    lambda s, d: H.comparison(H.snapshot(_hold(s, d))))
query("j07_holder_diff", "symbol report_date name significance | prev_shares new_shares change_shares change_pct", dp=4, ctes=HOLD, sql="SELECT * FROM chg")(
    lambda s, d: H.holder_diff(_hold(s, d), NOTE))
query("k04_recent_changes", "symbol report_date name significance | change_pct", dp=4, ctes=HOLD,
      sql="SELECT * FROM chg WHERE report_date >= DATE '2001-07-01' - 90 AND significance = 'major'")(
    lambda s, d: H.recent_changes(H.holder_diff(_hold(s, d), NOTE), "2001-07-01", significance="major"))
query(
    "a22_smart_money_flow", "symbol direction notable_increases notable_decreases | net_change_shares current_concentration | num_holders", dp=2,
    ctes=HOLD + """, mv AS (SELECT *, row_number() OVER (PARTITION BY symbol, change_shares > 0 ORDER BY report_date, new_shares DESC, name) AS k FROM chg WHERE significance IN ('major', 'moderate') AND change_shares <> 0),
mn AS (SELECT symbol, list(name ORDER BY k) FILTER (change_shares > 0) AS up, list(name ORDER BY k) FILTER (change_shares < 0) AS down FROM mv WHERE k <= 5 GROUP BY symbol),
nt AS (SELECT symbol, sum(change_shares) AS net FROM chg GROUP BY symbol), la AS (SELECT symbol, count(*) AS k, arg_max(concentration, report_date) AS c, arg_max(num_holders, report_date) AS n FROM snap GROUP BY symbol)""",
    sql="""SELECT symbol, CASE WHEN k < 2 THEN 'unknown' WHEN coalesce(net, 0) > 0 THEN 'increasing' WHEN coalesce(net, 0) < 0 THEN 'decreasing' ELSE 'stable' END AS direction,
  coalesce(net, 0) AS net_change_shares, c AS current_concentration, n AS num_holders, coalesce(up, []) AS notable_increases, coalesce(down, []) AS notable_decreases
  FROM la LEFT JOIN nt USING (symbol) LEFT JOIN mn USING (symbol)""",
)(lambda s, d: H.smart_money(_hold(s, d), NOTE))

# --- costs -------------------------------------------------------------------------------
COST = CALLS + """, pr AS (SELECT * FROM (VALUES ('gpt-4o', 2.5, 10.0), ('gpt-4o-mini', 0.15, 0.6), ('gpt-4-turbo', 10.0, 30.0), ('gpt-3.5-turbo', 0.5, 1.5)) v(model, i, o)),
cc AS (SELECT c.*, coalesce(input_tokens / 1e6 * CAST(i AS DOUBLE) + output_tokens / 1e6 * CAST(o AS DOUBLE), 0) AS cost, input_tokens + output_tokens AS tokens FROM calls c LEFT JOIN pr USING (model))"""
CA = "2024-01-08 00:00:00"


def since(n):
    return f"time >= TIMESTAMP '{CA}' - INTERVAL {n} DAYS"


def _cost(s, d):
    return C.with_cost(V.calls(s, d))


query("j12_price_lookup", "conv_id turn model | cost", dp=9, ctes=COST, sql="SELECT conv_id, turn, model, cost FROM cc")(_cost)
query("a23_cost_daily", "| cost", dp=9, ctes=COST, sql="SELECT coalesce(sum(cost), 0) AS cost FROM cc WHERE CAST(time AS DATE) = DATE '2024-01-03' AND NOT cached")(
    lambda s, d: C.daily_cost(_cost(s, d), "2024-01-03"))
query("a23_cost_monthly", "| cost", dp=9, ctes=COST, sql="SELECT coalesce(sum(cost), 0) AS cost FROM cc WHERE date_trunc('month', time) = DATE '2024-01-01' AND NOT cached")(
    lambda s, d: C.monthly_cost(_cost(s, d), "2024-01-15"))
for _n, _k in (("a24_cost_by_provider", "provider"), ("a24_cost_by_task", "task_type")):
    query(_n, f"{_k} | total_cost", dp=9, ctes=COST, sql=f"SELECT {_k}, sum(cost) AS total_cost FROM cc WHERE {since(30)} AND NOT cached GROUP BY {_k}")(
        lambda s, d, k=_k: C.cost_by(_cost(s, d), k, CA))
query("a25_usage_stats", "| cache_hit_rate total_cost avg_latency | total_calls cached_calls total_tokens", dp=9, ctes=COST,
      sql=f"SELECT count(*) AS total_calls, count_if(cached) AS cached_calls, count_if(cached) / CAST(count(*) AS DOUBLE) AS cache_hit_rate, sum(tokens) AS total_tokens, sum(cost) AS total_cost, avg(latency_s) AS avg_latency FROM cc WHERE {since(7)}")(
    lambda s, d: C.usage_stats(_cost(s, d), CA))
TREND = f"SELECT CAST(time AS DATE) AS date, count(*) AS calls, sum(tokens) AS tokens, sum(cost) AS cost FROM cc WHERE {since(30)} AND NOT cached GROUP BY 1"
query("a26_cost_trend", "date | cost | calls tokens", dp=9, ctes=COST, sql=TREND)(lambda s, d: C.cost_trend(_cost(s, d), CA))
query(
    "a27_cost_report", "section name | cost share_pct", ctes=COST + f", tr AS ({TREND}), tot AS (SELECT sum(cost) AS t FROM cc WHERE {since(30)})",
    sql=f"""SELECT 'provider' AS section, provider AS name, sum(cost) AS cost, sum(cost) * 100 / max(t) AS share_pct FROM cc, tot WHERE {since(30)} AND NOT cached GROUP BY provider
  UNION ALL SELECT 'task_type', task_type, sum(cost), sum(cost) * 100 / max(t) FROM cc, tot WHERE {since(30)} AND NOT cached GROUP BY task_type
  UNION ALL SELECT 'daily', 'mean', avg(cost), NULL FROM tr UNION ALL SELECT 'daily', 'max', max(cost), NULL FROM tr UNION ALL SELECT 'daily', 'min', min(cost), NULL FROM tr""",
)(lambda s, d: C.cost_report(_cost(s, d), CA))
query(
    "a28_budget_alerts", "period over_budget | cost budget", dp=9, ctes=COST,
    sql="""SELECT *, cost > budget AS over_budget FROM (SELECT 'daily' AS period, coalesce(sum(cost), 0) AS cost, CAST(0.01 AS DOUBLE) AS budget FROM cc WHERE CAST(time AS DATE) = DATE '2024-01-03' AND NOT cached
  UNION ALL SELECT 'monthly', coalesce(sum(cost), 0), CAST(200 AS DOUBLE) FROM cc WHERE date_trunc('month', time) = DATE '2024-01-01' AND NOT cached) x""",
)(lambda s, d: C.budget_alerts(_cost(s, d), "2024-01-03", 0.01, 200.0))
query("a29_provider_usage", "provider | cost cache_hit_rate avg_cost_per_request | requests tokens", dp=9, ctes=COST,
      sql="SELECT provider, count(*) AS requests, sum(tokens) AS tokens, sum(cost) AS cost, count_if(cached) / CAST(count(*) AS DOUBLE) AS cache_hit_rate, sum(cost) / count(*) AS avg_cost_per_request FROM cc GROUP BY provider")(
    lambda s, d: C.provider_usage(_cost(s, d)))
query("k01_top_expensive_calls", "conv_id turn provider model | cost", dp=9, ctes=COST,
      sql=f"SELECT conv_id, turn, provider, model, cost FROM cc WHERE {since(7)} AND NOT cached ORDER BY cost DESC, conv_id, turn LIMIT 10")(
    lambda s, d: C.top_expensive(_cost(s, d), CA))
USAGE = "usage AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS time, CASE event_type WHEN 'click' THEN 'deepseek' WHEN 'view' THEN 'openai' WHEN 'error' THEN 'news_api' ELSE 'other' END AS api FROM events), uc AS (SELECT *, CAST(CASE api WHEN 'deepseek' THEN 0.002 WHEN 'openai' THEN 0.003 ELSE 0.001 END AS DOUBLE) AS c, CAST(time AS DATE) AS date FROM usage)"


def _usage(s, d):
    t = F.col("event_type")
    return V.table(s, d, "events").select(
        "event_id", F.col("ts").alias("time"),
        F.when(t == "click", "deepseek").when(t == "view", "openai").when(t == "error", "news_api").otherwise("other").alias("api"))


query(
    "a30_api_budget", "date api alert exceeded | cost total_spent remaining usage_pct | calls", ctes=USAGE + ", pa AS (SELECT date, api, count(*) AS calls, sum(c) AS cost FROM uc GROUP BY 1, 2), ps AS (SELECT *, sum(cost) OVER (PARTITION BY date) AS total_spent FROM pa)",
    sql="SELECT *, round(0.7 - total_spent, 4) AS remaining, round(total_spent / 0.7 * 100, 1) AS usage_pct, total_spent > CAST(0.7 AS DOUBLE) * CAST(0.8 AS DOUBLE) AS alert, total_spent > CAST(0.7 AS DOUBLE) AS exceeded FROM ps",
)(lambda s, d: C.api_budget(_usage(s, d), 0.7))
query(
    "a30_budget_running", "event_id date | spent_before | within", ctes=USAGE,
    sql="SELECT event_id, date, sum(c) OVER w - c AS spent_before, CASE WHEN sum(c) OVER w <= 0.5005 THEN 1 ELSE 0 END AS within FROM uc WINDOW w AS (PARTITION BY date ORDER BY time, event_id ROWS UNBOUNDED PRECEDING)",
)(lambda s, d: C.budget_running(_usage(s, d), 0.5005).withColumn("within", F.when(F.col("within_budget"), 1).otherwise(0)))

# --- monitoring ---------------------------------------------------------------------------
query("a31_error_stats", "endpoint | | count total", ctes=REQUESTS + ", nw AS (SELECT * FROM requests ORDER BY time DESC, event_id DESC LIMIT 1000)",
      sql="SELECT endpoint, count(*) AS count, (SELECT count(*) FROM nw) AS total FROM nw GROUP BY endpoint ORDER BY count DESC LIMIT 10")(
    lambda s, d: M.error_stats(V.requests(s, d), kind="endpoint"))
EDGE = ", ".join(f"({e})" for e in M.EDGES["api"])
HIST = f"hist AS (SELECT endpoint, CAST(le AS DOUBLE) AS le, count_if(latency_s <= le) AS cumulative, count(latency_s) AS total FROM requests, (VALUES {EDGE}) v(le) GROUP BY 1, 2)"
query("a32_latency_histogram", "endpoint | le | cumulative total", ctes=REQUESTS + "," + HIST, sql="SELECT * FROM hist")(
    lambda s, d: M.latency_histogram(V.requests(s, d), M.EDGES["api"]))
query(
    "a33_histogram_quantile", "endpoint | quantile", ctes=REQUESTS + "," + HIST + """, hb AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(cumulative) OVER w, 0) AS before FROM hist WINDOW w AS (PARTITION BY endpoint ORDER BY le))""",
    sql="SELECT endpoint, coalesce(max(CASE WHEN cumulative >= total * 0.95 AND before < total * 0.95 THEN low + (le - low) * (total * 0.95 - before) / (cumulative - before) END), max(le)) AS quantile FROM hb GROUP BY endpoint",
)(lambda s, d: M.histogram_quantile(M.latency_histogram(V.requests(s, d), M.EDGES["api"]), 0.95))
query("a33_latency_quantiles", "endpoint bucket | p50 p95 rate | requests", ctes=REQUESTS,
      sql="SELECT endpoint, time_bucket(INTERVAL 6 HOURS, time) AS bucket, quantile_cont(latency_s, 0.5) AS p50, quantile_cont(latency_s, 0.95) AS p95, count(*) / CAST(21600 AS DOUBLE) AS rate, count(*) AS requests FROM requests GROUP BY 1, 2")(
    lambda s, d: M.latency_quantiles(V.requests(s, d), "6 hours", 21600.0))
query("a34_slow_queries", "event_id endpoint time | latency_s", ctes=REQUESTS, sql="SELECT event_id, endpoint, time, latency_s FROM requests WHERE latency_s > 0.3 ORDER BY time DESC, event_id DESC LIMIT 10")(
    lambda s, d: M.slow_queries(V.requests(s, d), 0.3))
query("a35_prediction_errors", "model symbol | mae rmse max_error | prediction_count high_errors", dp=4, ctes=PREDICTIONS,
      sql="SELECT model, symbol, avg(abs(actual - predicted)) AS mae, sqrt(avg(pow(actual - predicted, 2))) AS rmse, max(abs(actual - predicted)) AS max_error, count(*) AS prediction_count, count_if(abs(actual - predicted) > 0.05) AS high_errors FROM predictions GROUP BY 1, 2")(
    lambda s, d: M.prediction_errors(V.predictions(s, d)))


def _health(s, d):
    t = F.col("event_type")
    return V.table(s, d, "events").select(
        "event_id", F.col("ts").alias("time"), "value",
        F.when(t == "click", "cpu").when(t == "view", "memory").otherwise("disk").alias("metric"))


query(
    "a36_rolling_health", "event_id metric status | average", dp=9, ctes="hm AS (SELECT event_id, ts, value, CASE event_type WHEN 'click' THEN 'cpu' WHEN 'view' THEN 'memory' ELSE 'disk' END AS metric FROM events)",
    sql="""SELECT event_id, metric, avg(value) OVER (PARTITION BY metric ORDER BY ts, event_id ROWS 99 PRECEDING) AS average,
  CASE WHEN metric IN ('cpu', 'memory') AND value > 80 THEN 'critical' WHEN metric = 'disk' AND value >= 90 THEN 'warning' ELSE 'ok' END AS status FROM hm""",
)(lambda s, d: M.rolling_health(_health(s, d)))
query("a37_severity_counts", "o_orderpriority | | count", sql="SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")(
    lambda s, d: M.counts(V.table(s, d, "orders"), "o_orderpriority"))
CONF = "SELECT class, sum(support) AS support, sum(called) AS called, sum(hits) AS hits FROM (SELECT quality AS class, count(*) AS support, 0 AS called, count_if(quality = toxic) AS hits FROM labels GROUP BY 1 UNION ALL SELECT toxic, 0, count(*), 0 FROM labels GROUP BY 1) x GROUP BY class"
query(
    "a38_classification_report", "| precision recall f1 accuracy | class support", ctes=f"cf AS ({CONF}), pr AS (SELECT *, coalesce(hits / nullif(CAST(called AS DOUBLE), 0), 0) AS p, coalesce(hits / nullif(CAST(support AS DOUBLE), 0), 0) AS r FROM cf)",
    sql="SELECT class, support, p AS precision, r AS recall, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1, (SELECT count_if(quality = toxic) / CAST(count(*) AS DOUBLE) FROM labels) AS accuracy FROM pr",
)(lambda s, d: M.classification_report(V.table(s, d, "labels"), "quality", "toxic"))
query("a38_confusion", "| | label prediction count", sql="SELECT quality AS label, toxic AS prediction, count(*) AS count FROM labels GROUP BY 1, 2")(
    lambda s, d: M.confusion(V.table(s, d, "labels"), "quality", "toxic"))
query("a39_collection_counts", "lang | | count", sql="SELECT lang, count(*) AS count FROM documents GROUP BY lang")(
    lambda s, d: M.counts(V.table(s, d, "documents"), "lang"))
