"""Registered queries: stateful rules as table passes and as replayed streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import alerts as A
from tidemark.operators import sentiment as SE
from tidemark.plans import views as V
from tidemark.plans.registry import query
from tidemark.plans.views import NEWS, TICKS
from tidemark.sources import kafka as K
from tidemark.streaming import flows as SF
from tidemark.streaming import rules as SR
from tidemark.streaming.dashboard import live_dashboard
from tidemark.streaming.stateful import apply_stream, apply_table

ORDER = ["time", "event_id"]


def played(s, d, make, name, mode="append", table="events", late=False, batch=None):
    """What ``make`` emits over the table as a stream that comes in four parts, by time. With ``late`` a third of the rows
    of the last half hour of a part comes with the next one."""
    t = V.table(s, d, table)
    at, key = (F.unix_seconds("ts"), "event_id") if table == "events" else (F.col("doc_id"), "doc_id")
    come = SF.arrivals(t, at, late=F.col(key) % 3 == 0 if late else None, by=1800.0)
    return SF.replay(make(SF.file_stream(s, come.folder, t.schema)), mode, name, come, batch)


def _ruled(s, d, rule, by, name):
    return played(s, d, lambda x: apply_stream(_ticks(x), rule, [by], ["event_id", by], ORDER), name)


def _ticks(df):
    return df.select(
        "event_id", F.col("event_type").alias("symbol"), F.col("ts").alias("time"), (F.col("value") + 1.0).alias("price"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("volume"), F.col("user_id").alias("client"),
        (F.unix_micros("ts") / 1e6).alias("epoch"), (F.col("value") / 53 - 1).alias("score"))


def both(name, spec, table_fn, stream_fn, sql, ctes=TICKS, dp=6):
    """The same query over the table and over the replayed stream, with one SQL twin."""
    query(name, spec, sql, ctes, dp)(table_fn)
    query(f"{name}_stream", spec, sql, ctes, dp)(stream_fn)


W = "(PARTITION BY symbol ORDER BY time, event_id ROWS {} PRECEDING)"
N = f"count(price) OVER {W.format(19)}"
both(
    "r01_price_features", "event_id symbol signal | returns ma_short volatility momentum ma_long",
    lambda s, d: SR.price_features_table(_ticks(V.table(s, d, "events")), order=tuple(ORDER)),
    lambda s, d: _ruled(s, d, SR.price_features(), "symbol", "r01"),
    f"""SELECT * FROM (SELECT event_id, symbol, {N} AS n, (price / lag(price) OVER (PARTITION BY symbol ORDER BY time, event_id) - 1) * 100 AS returns, avg(price) OVER {W.format(4)} AS ma_short,
  CASE WHEN {N} >= 5 THEN stddev_pop(price) OVER {W.format(19)} ELSE 0 END AS volatility, CASE WHEN {N} >= 5 THEN price - first_value(price) OVER {W.format(19)} ELSE 0 END AS momentum,
  CASE WHEN {N} >= 20 THEN avg(price) OVER {W.format(19)} END AS ma_long, CASE WHEN {N} >= 20 THEN CASE WHEN avg(price) OVER {W.format(4)} > avg(price) OVER {W.format(19)} THEN 'bullish' ELSE 'bearish' END END AS signal FROM ticks) z WHERE n >= 2""",
    dp=5,
)
SC = "sc AS (SELECT event_id, event_type AS symbol, ts AS time, value / CAST(53 AS DOUBLE) - 1 AS score, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k FROM events)"
both(
    "r02_sentiment_ewma", "event_id symbol | current_sentiment | message_count",
    lambda s, d: SR.sentiment_ewma_table(_ticks(V.table(s, d, "events")), order=tuple(ORDER)),
    lambda s, d: _ruled(s, d, SR.sentiment_ewma(), "symbol", "r02"),
    "SELECT event_id, symbol, pow(0.95, k) * sum(score * CASE WHEN k = 0 THEN 1 ELSE 0.05 END * pow(0.95, -k)) OVER (PARTITION BY symbol ORDER BY k) AS current_sentiment, k + 1 AS message_count FROM sc",
    ctes=SC,
)
query("r02_sentiment_ewma_late_stream", "event_id symbol | current_sentiment | message_count", ctes=SC,
      sql="SELECT event_id, symbol, pow(0.95, k) * sum(score * CASE WHEN k = 0 THEN 1 ELSE 0.05 END * pow(0.95, -k)) OVER (PARTITION BY symbol ORDER BY k) AS current_sentiment, k + 1 AS message_count FROM sc QUALIFY time < date_trunc('hour', (SELECT max(time) FROM sc) - INTERVAL 3 HOURS)")(
    lambda s, d: played(s, d, lambda x: apply_stream(_ticks(x), SR.sentiment_ewma(), ["symbol"], ["event_id", "symbol"], ORDER, delay="3 hours"), "r02l", late=True))
COOL = """RECURSIVE ev AS (SELECT event_id, event_type AS symbol, epoch_us(CAST(ts AS TIMESTAMP)) / CAST(1000000 AS DOUBLE) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
cd AS (SELECT event_id, symbol, k, t AS last, true AS fired FROM ev WHERE k = 1
  UNION ALL SELECT e.event_id, e.symbol, e.k, CASE WHEN e.t - c.last < 10800 THEN c.last ELSE e.t END, e.t - c.last >= 10800 FROM cd c JOIN ev e ON e.symbol = c.symbol AND e.k = c.k + 1)"""
both(
    "r05_cooldown", "event_id symbol fired",
    lambda s, d: apply_table(_ticks(V.table(s, d, "events")), SR.cooldown(10800), ["symbol"], ["event_id", "symbol"], ORDER),
    lambda s, d: _ruled(s, d, SR.cooldown(10800), "symbol", "r05"),
    "SELECT event_id, symbol, fired FROM cd WHERE fired", ctes=COOL,
)
# the periods of price rules (60 minutes), divergence (180 minutes) and of the service monitor (300 seconds)
PERIODS = {A.BREAKOUT: 60.0 * A.COOLDOWN_MINUTES[A.BREAKOUT], A.DIVERGENCE: 60.0 * A.COOLDOWN_MINUTES[A.DIVERGENCE], "Monitor": 300.0}


def _raised(df):
    """Alerts of three rule types on the events of each symbol."""
    v = F.col("value")
    kinds = F.array(F.when(v >= 30, A.BREAKOUT), F.when(v >= 10, A.DIVERGENCE), F.lit("Monitor"))
    raised = df.select("event_id", F.col("event_type").alias("symbol"), F.col("ts").alias("time"), F.explode(F.array_compact(kinds)).alias("alert_type"))
    return SR.with_periods(raised, PERIODS)


BY_RULE = ["symbol", "alert_type"]
COOLED = """RECURSIVE al AS (SELECT event_id, event_type AS symbol, epoch_us(CAST(ts AS TIMESTAMP)) AS t, 'PriceBreakoutRule' AS alert_type, 3600000000 AS p, ts FROM events WHERE value >= 30
  UNION ALL SELECT event_id, event_type, epoch_us(CAST(ts AS TIMESTAMP)), 'CorrelationDivergenceRule', 10800000000, ts FROM events WHERE value >= 10
  UNION ALL SELECT event_id, event_type, epoch_us(CAST(ts AS TIMESTAMP)), 'Monitor', 300000000, ts FROM events),
ak AS (SELECT *, row_number() OVER (PARTITION BY symbol, alert_type ORDER BY ts, event_id) AS k FROM al),
ac AS (SELECT event_id, symbol, alert_type, k, t AS last, true AS fired FROM ak WHERE k = 1
  UNION ALL SELECT e.event_id, e.symbol, e.alert_type, e.k, CASE WHEN e.t - c.last < e.p THEN c.last ELSE e.t END, e.t - c.last >= e.p
  FROM ac c JOIN ak e ON e.symbol = c.symbol AND e.alert_type = c.alert_type AND e.k = c.k + 1)"""
both(
    "r05_cooldown_by_rule", "event_id symbol alert_type fired",
    lambda s, d: SR.cooldown_table(_raised(V.table(s, d, "events")), BY_RULE, ORDER),
    lambda s, d: played(s, d, lambda x: apply_stream(_raised(x), SR.cooldown_by_period(), BY_RULE, ["event_id", *BY_RULE], ORDER), "r05r"),
    "SELECT event_id, symbol, alert_type, fired FROM ac WHERE fired", ctes=COOLED,
)
RATE = """RECURSIVE rv AS (SELECT event_id, user_id AS client, epoch_us(CAST(ts AS TIMESTAMP)) / CAST(1000000 AS DOUBLE) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
rl AS (SELECT event_id, client, k, [t] AS times, 1 AS used, t + 604800 AS reset, true AS allowed, 3 AS remaining FROM rv WHERE k = 1
  UNION ALL SELECT event_id, client, k, CASE WHEN len(lt) < 3 AND u < 12 THEN list_append(lt, t) ELSE lt END, CASE WHEN len(lt) < 3 AND u < 12 THEN u + 1 ELSE u END, rs, len(lt) < 3 AND u < 12, greatest(0, 3 - len(lt))
  FROM (SELECT e.event_id, e.client, e.k, e.t, list_filter(r.times, lambda x: x > e.t - 86400) AS lt, CASE WHEN e.t > r.reset THEN 0 ELSE r.used END AS u, CASE WHEN e.t > r.reset THEN e.t + 604800 ELSE r.reset END AS rs
        FROM rl r JOIN rv e ON e.client = r.client AND e.k = r.k + 1))"""
LIMIT = dict(per_window=3, window=86400.0, per_period=12, period=604800.0)
both(
    "r07_rate_violations", "event_id client allowed | | remaining",
    lambda s, d: apply_table(_ticks(V.table(s, d, "events")), SR.rate_limit(**LIMIT), ["client"], ["event_id", "client"], ORDER),
    lambda s, d: _ruled(s, d, SR.rate_limit(**LIMIT), "client", "r07"),
    "SELECT event_id, client, allowed, remaining FROM rl", ctes=RATE,
)
query("r07_requests_in_window", "event_id | | recent", sql="SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(CAST(ts AS TIMESTAMP)) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent FROM events")(
    lambda s, d: SR.requests_in_window(_ticks(V.table(s, d, "events")), 3600))


def _enriched(df):
    """Events as (symbol, time) keyed records for the router."""
    return K.envelope(df.select(F.col("event_type").alias("symbol"), "value"), "prices", "symbol", "2024-01-01 00:00:00").unionByName(
        K.envelope(df.select(F.col("event_type").alias("symbol"), "value"), "news", "symbol", "2024-01-01 00:00:00"))


PROCESSORS = {
    "prices": lambda r: r.select("key", F.when(F.get_json_object("value", "$.value").cast("double") > 50, F.upper("key")).alias("value")),
    "news": lambda r: r.select("key", F.lower("key").alias("value")),
}
ROUTED = "SELECT 'prices-processed' AS topic, event_type AS key, upper(event_type) AS value, count(*) AS n FROM events WHERE value > 50 GROUP BY 2 UNION ALL SELECT 'news-processed', event_type, lower(event_type), count(*) FROM events GROUP BY 2"


def _routed(s, d):
    """Every batch of the stream goes through the router into a table."""
    from tidemark.sources.tables import scratch_path

    path = scratch_path(s, "r03-out")
    write = SF.router(PROCESSORS, lambda df: df.write.mode("append").parquet(path))
    played(s, d, _enriched, "r03", batch=write)
    return _per_key(s.read.parquet(path))


def _per_key(routed):
    return routed.groupBy("topic", "key", "value").agg(F.count(F.lit(1)).alias("n"))


both("r03_topic_router", "topic key value | | n", lambda s, d: _per_key(SF.route_batch(_enriched(V.table(s, d, "events")), PROCESSORS)), _routed, ROUTED, ctes="")


def _quotes(df):
    return df.select(F.col("event_id"), F.col("event_type").alias("symbol"), F.col("value").alias("price"), (F.col("value") - 50).alias("change_percent"),
                     (F.col("value")).alias("rsi"), F.lit(-3.0).alias("gold_change_percent"), F.lit(0.9).alias("gold_correlation"))


def _rules(s, d):
    kinds = [("b", A.BREAKOUT, "above"), ("p", A.PERCENT, "up"), ("c", A.DIVERGENCE, None), ("r", A.RSI, None)]
    each = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(t).alias("type"), F.lit(w).cast("string").alias("direction")) for r, t, w in kinds])
    none = F.lit(None).cast("double")
    return V.table(s, d, "events").select(F.col("event_type").alias("symbol")).distinct().withColumn("_r", F.explode(each)).select(
        "symbol", "_r.*", F.lit(True).alias("enabled"), F.lit(90.0).alias("breakout_price"), F.lit(20.0).alias("threshold_percent"),
        none.alias("min_correlation"), none.alias("divergence_threshold"), none.alias("oversold_threshold"), none.alias("overbought_threshold"))


both(
    "r04_alert_rules", "event_id rule_id alert_type severity",
    lambda s, d: SF.alert_rules_stream(_quotes(V.table(s, d, "events")), _rules(s, d)),
    lambda s, d: played(s, d, lambda x: SF.alert_rules_stream(_quotes(x), _rules(s, d)).select("event_id", "rule_id", "alert_type", "severity"), "r04"),
    """SELECT event_id, 'b' AS rule_id, 'PRICE_BREAKOUT' AS alert_type, 'MEDIUM' AS severity FROM events WHERE value >= 90
  UNION ALL SELECT event_id, 'p', 'PERCENT_CHANGE', CASE WHEN abs(value - 50) >= 30 THEN 'HIGH' ELSE 'MEDIUM' END FROM events WHERE value - 50 >= 20
  UNION ALL SELECT event_id, 'c', 'CORRELATION_DIVERGENCE', 'MEDIUM' FROM events WHERE value - 50 > 0 AND value - 50 + 3 >= 5
  UNION ALL SELECT event_id, 'r', CASE WHEN value <= 30 THEN 'RSI_OVERSOLD' ELSE 'RSI_OVERBOUGHT' END, 'MEDIUM' FROM events WHERE value <= 30 OR value >= 70""", ctes="",
)
query(
    "r06_continuous_ohlcv_stream", "symbol bucket | open high low close volume", ctes=TICKS,
    sql="""SELECT symbol, date_trunc('hour', time) AS bucket, first(price ORDER BY time, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY time, event_id) AS close, sum(volume) AS volume
  FROM ticks GROUP BY 1, 2 HAVING date_trunc('hour', time) + INTERVAL 1 HOUR <= (SELECT max(time) FROM ticks) - INTERVAL 3 HOURS""",
)(lambda s, d: played(s, d, lambda x: SF.bars_stream(_ticks(x)), "r06", late=True))


def _news(df):
    p, q = (F.col("n_chars") % 7).cast("double") / 14, (F.col("doc_id") % 7).cast("double") / 14
    x = p - q
    return df.select("doc_id", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 600).alias("time"), F.concat(F.lit("S"), (F.col("doc_id") % 5).cast("string")).alias("symbol"),
                     x.alias("score"), F.when(x > 0.2, "positive").when(x < -0.2, "negative").otherwise("neutral").alias("label"))


query("r06_continuous_sentiment_stream", "symbol bucket | avg_sentiment | news_count positive_count", ctes=NEWS,
      sql="SELECT symbol, CAST(date_trunc('day', time) AS TIMESTAMP) AS bucket, count(*) AS news_count, avg(score) AS avg_sentiment, count_if(label = 'positive') AS positive_count FROM news GROUP BY 1, 2 HAVING CAST(date_trunc('day', time) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(time) FROM news) - INTERVAL 3 DAYS")(
    lambda s, d: played(s, d, lambda x: SF.sentiment_stream(_news(x)), "r06s", table="documents"))


def _bursts(df):
    """The news with two quiet days after every forty, so that the last ten rows are shown too."""
    quiet = F.expr("make_dt_interval(CAST(2 * (doc_id DIV 40) AS INT))")
    return _news(df).withColumn("time", F.col("time") + quiet)


BURSTS = NEWS + """, bu AS (SELECT doc_id, symbol, time + to_days(CAST(2 * (doc_id // 40) AS INT)) AS time, score, label FROM news),
gr AS (SELECT DISTINCT symbol, time_bucket(INTERVAL 5 MINUTES, time) + to_minutes(CAST(5 * k AS INT)) AS until FROM bu, range(1, 290) r(k)),
wd AS (SELECT g.symbol, g.until, avg(score) AS a, count(*) AS n, avg(CASE WHEN label = 'positive' THEN 1.0 ELSE 0.0 END) AS bull, avg(CASE WHEN label = 'negative' THEN 1.0 ELSE 0.0 END) AS bear
  FROM gr g JOIN bu USING (symbol) WHERE bu.time >= g.until - INTERVAL 24 HOURS AND bu.time < g.until GROUP BY 1, 2),
ra AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time, doc_id) AS k FROM bu),
la AS (SELECT x.symbol, x.time, count(*) AS m, avg(y.score) AS a, avg(CASE WHEN y.label = 'positive' THEN 1.0 ELSE 0.0 END) AS bull, avg(CASE WHEN y.label = 'negative' THEN 1.0 ELSE 0.0 END) AS bear,
  avg(CASE WHEN x.k - y.k < 5 THEN y.score END) - avg(CASE WHEN y.k - greatest(x.k - 10, 0) <= 5 THEN y.score END) AS change
  FROM ra x JOIN ra y ON x.symbol = y.symbol AND y.k BETWEEN x.k - 9 AND x.k GROUP BY 1, 2),
lz AS (SELECT g.symbol, g.until, m, change, coalesce(w.a, la.a) AS a, coalesce(w.n, m) AS n, coalesce(w.bull, la.bull) AS bull, coalesce(w.bear, la.bear) AS bear
  FROM gr g ASOF JOIN la ON g.symbol = la.symbol AND g.until > la.time LEFT JOIN wd w ON w.symbol = g.symbol AND w.until = g.until)"""
LIVEX = """SELECT symbol, until, a AS current_sentiment, CASE WHEN a > 0.2 THEN 'positive' WHEN a < -0.2 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
  CASE WHEN m < 5 THEN 'stable' WHEN change > 0.05 THEN 'improving' WHEN change < -0.05 THEN 'declining' ELSE 'stable' END AS trend, n AS news_volume_24h, bull AS bullish_ratio, bear AS bearish_ratio,
  greatest(0, least(100, ((a + 1) * 50 * 0.6 + bull * 100 * 0.4) * least(1.5, greatest(0.5, n / CAST(10 AS DOUBLE))))) AS heat_index FROM lz"""
DONE = " WHERE until <= (SELECT max(time) FROM bu) - INTERVAL 7 MINUTES"
LSPEC = "symbol until sentiment_label trend | current_sentiment bullish_ratio bearish_ratio heat_index | news_volume_24h"
query("r08_live_dashboard", LSPEC, ctes=BURSTS, sql=LIVEX)(lambda s, d: SE.live_dashboards(_bursts(V.table(s, d, "documents")), order=("time", "doc_id")))
query("r08_live_dashboard_stream", LSPEC, ctes=BURSTS, sql=LIVEX + DONE)(
    lambda s, d: played(s, d, lambda x: live_dashboard(_bursts(x), tie=F.col("doc_id"), delay="7 minutes"), "r08", table="documents"))
both(
    "r09_live_quotes", "symbol time | price",
    lambda s, d: SF.live_quotes(_ticks(V.table(s, d, "events"))),
    lambda s, d: played(s, d, lambda x: SF.live_quotes(_ticks(x)), "r09", "complete", late=True),
    "SELECT symbol, arg_max(time, (time, event_id)) AS time, arg_max(price, (time, event_id)) AS price FROM ticks GROUP BY symbol",
)
query("r10_stream_dedupe", "| | client symbols", sql="SELECT user_id AS client, count(DISTINCT event_type) AS symbols FROM events GROUP BY 1")(
    lambda s, d: played(s, d, lambda x: SF.dedupe_stream(_ticks(x), ["client", "symbol"]), "r10", late=True)
    .groupBy("client").agg(F.count(F.lit(1)).alias("symbols")))
both(
    "r10_first_of_key", "event_id client symbol",
    lambda s, d: apply_table(_ticks(V.table(s, d, "events")), SR.first_of_key(), ["client", "symbol"], ["event_id", "client", "symbol"], ORDER),
    lambda s, d: played(s, d, lambda x: apply_stream(_ticks(x), SR.first_of_key(), ["client", "symbol"], ["event_id", "client", "symbol"], ORDER), "r10f"),
    "SELECT event_id, user_id AS client, event_type AS symbol FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1", ctes="",
)


def _upserted(s, d):
    """The last price of each user, symbol and day; days that two parts of the stream share are merged."""
    from tidemark.sources.tables import scratch_path

    path = scratch_path(s, "r11-table")
    write = SF.upsert_batch(path, keys=("client", "symbol"))
    played(s, d, lambda x: _ticks(x).select("client", "symbol", "time", F.col("price").alias("close")), "r11", batch=write)
    return s.read.parquet(path)


query("r11_stream_upsert", "client symbol date | close", ctes=TICKS,
      sql="SELECT user_id AS client, event_type AS symbol, CAST(ts AS DATE) AS date, arg_max(value + 1, (ts, value)) AS close FROM events GROUP BY 1, 2, 3")(_upserted)


def _usage(df):
    t = F.col("event_type")
    return df.select("event_id", F.col("ts").alias("time"), F.when(t == "click", "deepseek").when(t == "view", "openai").when(t == "error", "news_api").otherwise("other").alias("api"))


query("r12_daily_budget", "date exceeded | spent | calls", ctes="us AS (SELECT CAST(ts AS DATE) AS date, CAST(CASE event_type WHEN 'click' THEN 0.002 WHEN 'view' THEN 0.003 ELSE 0.001 END AS DOUBLE) AS c FROM events)",
      sql="SELECT date, count(*) AS calls, sum(c) AS spent, sum(c) > 0.57 AS exceeded FROM us GROUP BY date")(
    lambda s, d: SF.budget_stream(_usage(V.table(s, d, "events")), 0.57))
query("r12_daily_budget_stream", "date exceeded | spent | calls", ctes="us AS (SELECT CAST(ts AS DATE) AS date, CAST(CASE event_type WHEN 'click' THEN 0.002 WHEN 'view' THEN 0.003 ELSE 0.001 END AS DOUBLE) AS c FROM events)",
      sql="SELECT date, count(*) AS calls, sum(c) AS spent, sum(c) > 0.57 AS exceeded FROM us GROUP BY date")(
    lambda s, d: played(s, d, lambda x: SF.budget_stream(_usage(x), 0.57), "r12", "complete", late=True))


def _record_high():
    """A user's rule: emits a price whenever it beats every earlier one of its symbol."""
    from tidemark.streaming.stateful import Rule

    def step(best, price):
        price = float(price)
        return (price, (price,)) if best is None or price > best else (best, None)

    return Rule(lambda: None, step, ("price",), (("record", "double"),))


both(
    "x04_stream_processor", "event_id symbol | record",
    lambda s, d: apply_table(_ticks(V.table(s, d, "events")), _record_high(), ["symbol"], ["event_id", "symbol"], ORDER),
    lambda s, d: _ruled(s, d, _record_high(), "symbol", "x04"),
    "SELECT event_id, symbol, price AS record FROM (SELECT *, max(price) OVER (PARTITION BY symbol ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ticks) z WHERE best IS NULL OR price > best",
)
