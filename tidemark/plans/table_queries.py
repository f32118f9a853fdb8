"""Registered queries: filters, sources, text, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import rows as RW
from tidemark.functions import text as X
from tidemark.functions.stats import tail
from tidemark.operators import alerts as A
from tidemark.operators import pairs as P
from tidemark.operators import sentiment as SE
from tidemark.plans import views as V
from tidemark.plans.registry import query
from tidemark.plans.sqlparts import chg, lag
from tidemark.plans.views import BARS, DAILY, FLOWS, NEWS
from tidemark.sources import kafka as K
from tidemark.sources import payloads as PL
from tidemark.sources import tables as TB

O = "open high low close volume"
ARR = "{}[CAST({} AS INT) + 1]"


def pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def first_line(c):
    """The title of a text: its first line."""
    return F.split_part(c, F.lit("\n"), F.lit(1))


# --- filters ------------------------------------------------------------------------
query("f01_prices_by_symbol", f"symbol time | {O}", ctes=BARS,
      sql="SELECT * FROM bars WHERE symbol = 'click' AND time >= TIMESTAMP '2024-01-03' AND time <= TIMESTAMP '2024-01-25 12:00:00' ORDER BY time DESC LIMIT 300")(
    lambda s, d: RW.prices_by_symbol(V.bars(s, d), "click", "2024-01-03", "2024-01-25 12:00:00", 300))
query("f02_date_filter", "o_orderkey o_orderdate", sql="SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-03-01'")(
    lambda s, d: RW.date_filter(V.table(s, d, "orders"), "o_orderdate", "1996-01-01", "1996-03-01"))
query("f03_paginate", "o_orderkey | o_totalprice", sql="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")(
    lambda s, d: RW.paginate(V.table(s, d, "orders"), ["o_orderkey"], 3))
query("f04_get_by_id", "o_orderkey o_custkey | o_totalprice", sql="SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")(
    lambda s, d: RW.get_by_id(V.table(s, d, "orders"), "o_orderkey", 77))
query("f05_recent_news", "doc_id time", ctes=NEWS,
      sql="SELECT doc_id, time FROM news WHERE (doc_id % 5 = 2 OR doc_id % 3 = 2) AND doc_id % 2 = 0 ORDER BY time DESC LIMIT 25")(
    lambda s, d: RW.recent_news(V.news(s, d).withColumn("symbols", F.array("symbol", F.concat(F.lit("S"), (F.col("doc_id") % 3).cast("string"))))
                                .withColumn("processed", F.col("doc_id") % 2 == 0), 25, "S2", True))
query("f06_flows_by_symbol", "symbol time | net_flow", dp=2, ctes=FLOWS,
      sql="SELECT symbol, time, net_flow FROM flows WHERE symbol = 'Brand#7' AND time >= DATE '2001-06-01' - 30")(
    lambda s, d: RW.since(V.flows(s, d), "2001-06-01", 30, "Brand#7"))
query("f06_sentiment_by_symbol", "symbol time | score", ctes=NEWS,
      sql="SELECT symbol, time, score FROM news WHERE symbol = 'S1' AND time >= TIMESTAMP '2024-01-06 00:00:00' - INTERVAL 3 DAYS")(
    lambda s, d: RW.since(V.news(s, d), "2024-01-06 00:00:00", 3, "S1"))
SQ = DAILY + f""", q AS (SELECT symbol, close AS price, volume, (close - pc) / pc * 100 AS change_percent FROM (SELECT *, {lag('close')} AS pc, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS k FROM daily) z WHERE k = 1),
c AS (SELECT a.symbol, round(corr(a.close, g.close), 4) AS gold_correlation FROM daily a JOIN daily g ON a.time = g.time AND g.symbol = 'Brand#11' GROUP BY 1)"""
PE = "CASE WHEN length(symbol) % 2 = 0 THEN NULL ELSE volume END"


def _screen(s, d):
    last2 = tail(V.daily(s, d), 2)
    q = last2.groupBy("symbol").agg(
        F.max(F.when(F.col("back") == 1, F.col("close"))).alias("price"), F.max(F.when(F.col("back") == 1, F.col("volume"))).alias("volume"),
        F.max(F.when(F.col("back") == 2, F.col("close"))).alias("_p"))
    q = q.withColumn("change_percent", (F.col("price") - F.col("_p")) / F.col("_p") * 100).withColumn(
        "pe_ratio", F.when(F.length("symbol") % 2 != 0, F.col("volume")))
    return RW.screener(q, -0.5, 40, 5, None, "volume", P.corr_with(V.daily(s, d), "Brand#11"))


query("f07_screener", "symbol | price volume change_percent gold_correlation", dp=8, ctes=SQ,
      sql=f"SELECT symbol, price, volume, change_percent, gold_correlation FROM q JOIN c USING (symbol) WHERE volume >= 5 AND coalesce({PE}, 0) <= 40 AND gold_correlation >= -0.5")(_screen)
query("f08_category", "p_partkey category", sql="SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1','Brand#2') THEN 'ETF' WHEN p_brand IN ('Brand#3') THEN 'Mining' WHEN p_brand IN ('Brand#4') THEN 'Index' ELSE 'Other' END AS category FROM part")(
    lambda s, d: V.table(s, d, "part").select("p_partkey", RW.category(F.col("p_brand"), ["Brand#1", "Brand#2"], ["Brand#3"], ["Brand#4"]).alias("category")))
query("f09_quote_change", "o_orderkey | change change_pct",
      sql="SELECT o_orderkey, CASE WHEN p <> 0 AND q <> 0 THEN round(p - q, 4) END AS change, CASE WHEN p <> 0 AND q <> 0 THEN round((p - q) / q * 100, 2) END AS change_pct FROM (SELECT o_orderkey, o_totalprice AS p, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_custkey * CAST(1.0371 AS DOUBLE) END AS q FROM orders) z", dp=4)(
    lambda s, d: RW.quote_change(V.table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"),
                                 F.when(F.col("o_orderkey") % 7 == 0, 0.0).otherwise(F.col("o_custkey") * 1.0371).alias("previous_close"))))
RQ = "rq AS (SELECT o_orderkey, [' gld ','SLV','Iau','NOPE','x'][CAST(o_custkey % 5 AS INT) + 1] AS symbol, ['1D','5m','2d',' 1h '][CAST(o_orderkey % 4 AS INT) + 1] AS interval, CAST(o_orderdate AS DATE) AS start_date, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN DATE '1997-01-01' ELSE CAST(o_orderdate AS DATE) END AS end_date FROM orders)"
query("f10_valid_query", "o_orderkey symbol_ok interval_ok range_ok is_valid failed_rules", ctes=RQ + """, rk AS (SELECT *, trim(upper(symbol)) IN ('GLD','IAU','GLDM','SGOL','PHYS','SLV','SIVR','PSLV','AGQ') AND length(symbol) BETWEEN 2 AND 10 AS symbol_ok,
  trim(lower(interval)) IN ('1m','5m','15m','30m','1h','4h','1d','1w','1M') AS interval_ok, end_date IS NULL OR start_date <= end_date AS range_ok FROM rq)""",
      sql="SELECT o_orderkey, symbol_ok, interval_ok, range_ok, symbol_ok AND interval_ok AND range_ok AS is_valid, list_filter([CASE WHEN NOT symbol_ok THEN 'symbol_ok' END, CASE WHEN NOT interval_ok THEN 'interval_ok' END, CASE WHEN NOT range_ok THEN 'range_ok' END], lambda x: x IS NOT NULL) AS failed_rules FROM rk")(
    lambda s, d: RW.valid_query(V.table(s, d, "orders").select(
        "o_orderkey", pick([" gld ", "SLV", "Iau", "NOPE", "x"], F.col("o_custkey") % 5).alias("symbol"), pick(["1D", "5m", "2d", " 1h "], F.col("o_orderkey") % 4).alias("interval"),
        F.to_date("o_orderdate").alias("start_date"), F.when(F.col("o_orderkey") % 3 == 1, F.lit("1997-01-01").cast("date")).when(F.col("o_orderkey") % 3 == 2, F.to_date("o_orderdate")).alias("end_date"))))
QT = "qt AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS symbol, value - 1 AS price, CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS timestamp FROM events)"


def _quotes(s, d):
    e = V.table(s, d, "events")
    return e.select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("symbol"), (F.col("value") - 1).alias("price"),
                    F.when(F.col("event_id") % 13 != 0, F.col("ts")).alias("timestamp"))


query("f11_valid_quote", "event_id is_valid is_stale", ctes=QT,
      sql="SELECT event_id, symbol IS NOT NULL AND coalesce(price > 0, false) AND timestamp IS NOT NULL AS is_valid, coalesce(timestamp < TIMESTAMP '2024-01-20' - INTERVAL 24 HOURS, false) AS is_stale FROM qt")(
    lambda s, d: RW.valid_quote(_quotes(s, d), "2024-01-20"))
AV = "av AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, CASE WHEN lang = 'fr' THEN NULL ELSE source END AS url, text AS content FROM documents)"
query("f12_valid_articles", "doc_id", ctes=AV, sql="SELECT doc_id FROM av WHERE length(coalesce(title, '')) > 0 AND length(coalesce(url, '')) > 0 AND NOT (length(coalesce(content, '')) < 50 AND length(coalesce(title, '')) < 20)")(
    lambda s, d: RW.valid_articles(V.table(s, d, "documents").select(
        "doc_id", first_line("text").alias("title"), F.when(F.col("lang") != "fr", F.col("source")).alias("url"), F.col("text").alias("content"))))
query("f13_is_fresh", "event_id fresh", ctes=QT, sql="SELECT event_id, coalesce(timestamp >= TIMESTAMP '2024-01-20' - INTERVAL 60 MINUTES, false) AS fresh FROM qt")(
    lambda s, d: _quotes(s, d).withColumn("fresh", RW.is_fresh(F.col("timestamp"), "2024-01-20")))
query("f14_quality_report", "is_valid | | rows null_close extreme_changes duplicate_keys missing_columns",
      ctes=BARS + f", r AS (SELECT *, {chg('close')} AS r FROM bars)",
      sql="SELECT false AS is_valid, count(*) AS rows, count_if(close IS NULL) AS null_close, count_if(abs(r) > 0.2) AS extreme_changes, 0 AS duplicate_keys, 0 AS missing_columns FROM r")(
    lambda s, d: RW.quality_report(V.bars(s, d), max_rows=V.hours_bound(s, d)))
query("f15_mask", "c_custkey masked short", sql="SELECT c_custkey, concat(left(c_name, 4), '***', right(c_name, 4)) AS masked, CASE WHEN length(c_mktsegment) <= 8 THEN '***' ELSE concat(left(c_mktsegment, 4), '***', right(c_mktsegment, 4)) END AS short FROM customer")(
    lambda s, d: V.table(s, d, "customer").select("c_custkey", X.mask(F.col("c_name")).alias("masked"), X.mask(F.col("c_mktsegment")).alias("short")))


@query("f17_adhoc_select", "o_orderpriority | total | n", dp=2, sql="SELECT o_orderpriority, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY 1")
def f17(s, d):
    V.table(s, d, "orders").createOrReplaceTempView("tidemark_orders")
    return RW.adhoc_select(s, "SELECT o_orderpriority, sum(o_totalprice) AS total, count(*) AS n FROM tidemark_orders GROUP BY 1")


# --- sources ------------------------------------------------------------------------
query("s01_load_ohlcv", "time symbol source | open high low close volume adj_close", dp=8, ctes=DAILY,
      sql="SELECT CAST(time AS TIMESTAMP) AS time, symbol, 'file' AS source, open, high, low, close, volume, close AS adj_close FROM daily WHERE time >= DATE '1997-01-01' AND time < DATE '1998-01-01' AND volume % 7 <> 0")(
    lambda s, d: TB.shape_ohlcv(V.daily(s, d).select(
        F.col("time").alias("Date"), "symbol", F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"),
        F.when(F.col("volume") % 7 != 0, F.col("close")).alias("Close"), F.col("volume").alias("Volume"), F.col("close").alias("Adj Close")), None, "file", "1997-01-01", "1998-01-01"))
query("s02_load_many", "symbol time | close volume", dp=8, ctes=DAILY,
      sql="SELECT symbol, time, close, volume FROM daily WHERE symbol = 'Brand#1' UNION ALL SELECT symbol, time, close, NULL FROM daily WHERE symbol = 'Brand#2'")(
    lambda s, d: TB.load_many([V.daily(s, d).where("symbol = 'Brand#1'"), V.daily(s, d).where("symbol = 'Brand#2'").drop("volume")]))
query("u01_union_feeds", "symbol time kind | value", dp=4, ctes=DAILY + "," + NEWS,
      sql="SELECT symbol, CAST(time AS TIMESTAMP) AS time, 'bar' AS kind, volume AS value FROM daily UNION ALL SELECT symbol, time, NULL, score FROM news")(
    lambda s, d: TB.union_feeds([V.daily(s, d).select("symbol", F.col("time").cast("timestamp").alias("time"), F.lit("bar").alias("kind"), F.col("volume").alias("value")),
                                 V.news(s, d).select("symbol", "time", F.col("score").alias("value"))]))


def _daily_payload(s, d):
    """One payload per brand and month: at most 31 entries each."""
    b = V.daily(s, d)
    entry = F.create_map(*[x for n, k in PL.DAILY_KEYS for x in (F.lit(k), {
        "open": F.col("open"), "high": F.col("high"), "low": F.col("low"), "close": F.col("close"), "adjusted_close": F.col("close"),
        "volume": F.col("volume").cast("long"), "dividend": F.lit(0), "split_coefficient": F.when(F.dayofmonth("time") == 13, "bad").otherwise("1.0"),
    }[n].cast("string"))])
    series = F.map_from_entries(F.collect_list(F.struct(F.col("time").cast("string"), entry)))
    return b.groupBy("symbol", F.trunc("time", "month").alias("m")).agg(
        F.to_json(F.struct(series.alias("Time Series (Daily)"))).alias("payload"))


query("s03_parse_daily_series", "symbol date | open high low close adjusted_close dividend split_coefficient | volume", dp=8, ctes=DAILY,
      sql="SELECT symbol, time AS date, open, high, low, close, close AS adjusted_close, 0 AS dividend, 1 AS split_coefficient, volume FROM daily WHERE day(time) <> 13")(
    lambda s, d: PL.parse_daily_series(_daily_payload(s, d)))
query("s04_parse_quote", "symbol | price previous_close change change_percent | volume", dp=4,
      sql="SELECT c_name AS symbol, c_acctbal AS price, 0 AS previous_close, c_custkey AS change, c_custkey / CAST(8 AS DOUBLE) AS change_percent, c_nationkey AS volume FROM customer WHERE c_custkey % 10 <> 3 AND c_custkey % 10 <> 4")(
    lambda s, d: PL.parse_quote(V.table(s, d, "customer").select(F.col("c_name").alias("symbol"), F.when(F.col("c_custkey") % 10 == 4, F.lit("{}")).otherwise(F.to_json(F.struct(F.create_map(
        F.lit("05. price"), F.when(F.col("c_custkey") % 10 == 3, "n/a").otherwise(F.col("c_acctbal").cast("string")), F.lit("06. volume"), F.col("c_nationkey").cast("string"),
        F.lit("09. change"), F.col("c_custkey").cast("string"), F.lit("10. change percent"), F.concat((F.col("c_custkey") / 8.0).cast("string"), F.lit("%"))).alias("Global Quote")))).alias("payload"))))
query("s05_parse_observations", "time series_id series_name | value", dp=8, ctes=DAILY,
      sql="SELECT time, symbol AS series_id, 'n' AS series_name, close AS value FROM daily WHERE day(time) <> 13")(
    lambda s, d: PL.parse_observations(V.daily(s, d).groupBy(F.col("symbol").alias("series_id"), F.trunc("time", "month").alias("m")).agg(
        F.to_json(F.struct(F.collect_list(F.struct(F.col("time").cast("string").alias("date"), F.when(F.dayofmonth("time") == 13, ".").otherwise(F.col("close").cast("string")).alias("value"))).alias("observations"))).alias("payload"))
        .withColumn("series_name", F.lit("n"))))
WORDS = ["the", "gold", "en", "le", "und", "is", "que", "der"]
KWL = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
CLEAN = r"trim(regexp_replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '[\s\x0B\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"


def clean_sql(c):
    return CLEAN.format(c)


def hit_list(text, words=WORDS):
    return "list_sort(list_filter([" + ", ".join(f"'{w}'" for w in words) + f"], lambda w: contains(lower({text}), w)))"


GLD = "CASE WHEN contains(lower({0}), 'gld') OR contains(lower({0}), 'iau') OR contains(lower({0}), 'gldm') OR contains(lower({0}), 'sgol') THEN 'GLD' WHEN contains(lower({0}), 'slv') OR contains(lower({0}), 'sivr') OR contains(lower({0}), 'agq') THEN 'SLV' WHEN {g} > {s} THEN 'GLD' WHEN {s} > {g} THEN 'SLV' WHEN {g} > 0 THEN 'GLD' END"


def count_sql(text, words):
    return "(" + " + ".join(f"CAST(contains(lower({text}), '{w.lower()}') AS INT)" for w in words) + ")"


def symbol_sql(text, gold=X.GOLD, silver=X.SILVER):
    return GLD.format(text, g=count_sql(text, gold), s=count_sql(text, silver))


query("s06_parse_articles", "article_id time title content source url author keywords symbol language",
      ctes="ar AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS description, lang AS snippet, source, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE '2024-02-03 04:05:06' END AS published_at FROM documents)",
      sql=f"""SELECT substr(md5(concat(title, source, coalesce(published_at, ''))), 1, 16) AS article_id, CASE WHEN published_at IS NULL THEN TIMESTAMP '2024-05-01' ELSE TIMESTAMP '2024-02-03 04:05:06' END AS time,
  {clean_sql('title')} AS title, {clean_sql("CASE WHEN description <> '' THEN description ELSE snippet END")} AS content, source, concat('u', doc_id) AS url, CAST(NULL AS VARCHAR) AS author,
  {hit_list("concat(title, ' ', description)")} AS keywords, {symbol_sql('title')} AS symbol, 'en' AS language FROM ar""")(
    lambda s, d: PL.parse_articles(V.table(s, d, "documents").select(F.to_json(F.struct(F.array(F.struct(
        first_line("text").alias("title"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text")).alias("description"), F.col("lang").alias("snippet"), "source",
        F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.when(F.col("doc_id") % 4 != 0, "2024-02-03 04:05:06").alias("published_at"))).alias("data"))).alias("payload")),
        "2024-05-01", keywords=WORDS))
query("s07_shape_feeds", "title content url source published_at image_url fetch_source",
      sql="""SELECT split_part(text, chr(10), 1) AS title, text AS content, concat('u', doc_id) AS url, coalesce(CASE WHEN doc_id % 5 <> 0 THEN source END, 'RSS Feed') AS source, CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-01-01' WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '2024-05-01' END AS published_at,
  CAST(NULL AS VARCHAR) AS image_url, 'RSS' AS fetch_source FROM documents WHERE contains(lower(concat(split_part(text, chr(10), 1), ' ', text)), 'the') OR contains(lower(concat(split_part(text, chr(10), 1), ' ', text)), 'und')
  UNION ALL SELECT regexp_extract(html, '<title>([^<]*)', 1), html, url, concat('Reddit/r/', page_id % 5), make_timestamp((1704067200 + page_id * 60) * 1000000), NULL, 'Reddit' FROM pages""")(
    lambda s, d: TB.union_feeds([
        PL.shape_rss(V.table(s, d, "documents").select(
            first_line("text").alias("title"), F.col("text").alias("summary"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("link"),
            F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("feed_title"), F.when(F.col("doc_id") % 2 == 0, F.lit("2024-01-01").cast("timestamp")).alias("published"),
            F.when(F.col("doc_id") % 3 == 0, F.lit("2024-01-02").cast("timestamp")).alias("updated")), "2024-05-01", ["the", "und"]),
        PL.shape_posts(V.table(s, d, "pages").select(F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.col("html").alias("selftext"), "url",
                                                     (F.col("page_id") % 5).cast("string").alias("subreddit"), (F.lit(1704067200) + F.col("page_id") * 60).alias("created_utc")))]))
query("s08_explode_rates", "metal timestamp source | price", ctes="rt AS (SELECT CAST(ts AS TIMESTAMP) AS timestamp, unnest(['gold', 'silver']) AS metal, unnest([value, value * 2]) AS rate FROM events)",
      sql="SELECT metal, timestamp, 'Metals-API' AS source, coalesce(1 / nullif(rate, 0), 0) AS price FROM rt")(
    lambda s, d: PL.explode_rates(V.table(s, d, "events").select(F.col("ts").alias("timestamp"), F.create_map(F.lit("XAU"), F.col("value"), F.lit("XAG"), F.col("value") * 2, F.lit("ABC"), F.lit(1.0)).alias("rates"))))
SRC = ["yfinance", "alphavantage", "finnhub", "polygon", "unknown"]
FB = "fb AS (SELECT concat('U', user_id) AS symbol, value - 10 AS price, CAST(ts AS TIMESTAMP) AS timestamp, event_id % 5 AS p, ['yfinance','alphavantage','finnhub','polygon','unknown'][CAST(event_id % 5 AS INT) + 1] AS source FROM events)"
query("s09_source_fallback", "symbol data_source timestamp | price", ctes=FB,
      sql="SELECT symbol, source AS data_source, timestamp, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p, timestamp DESC) AS k FROM fb WHERE price > 0 AND p < 4) z WHERE k = 1")(
    lambda s, d: TB.source_fallback(V.table(s, d, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), (F.col("value") - 10).alias("price"), F.col("ts").alias("timestamp"), pick(SRC, F.col("event_id") % 5).alias("source"))))
query("s10_kafka_decode", "topic key event_type | value",
      sql="SELECT 'precious-metals-prices' AS topic, CAST(user_id AS VARCHAR) AS key, event_type, value FROM events")(
    lambda s, d: K.decode(K.envelope(V.table(s, d, "events").select("user_id", "event_type", "value"), "prices", "user_id", "2024-01-01 00:00:00"), "event_type string, value double"))
query("s11_kafka_envelope", "topic key _key _timestamp event_type",
      sql="SELECT 'precious-metals-alerts' AS topic, CAST(user_id AS VARCHAR) AS key, CAST(user_id AS VARCHAR) AS _key, '2024-01-01T00:00:00' AS _timestamp, event_type FROM events")(
    lambda s, d: K.decode(K.envelope(V.table(s, d, "events").select("user_id", "event_type"), "alerts", "user_id", "2024-01-01 00:00:00"), "event_type string, _key string, _timestamp string"))


def _written(s, d, write, read):
    path = TB.scratch_path(s, "round-trip")
    write(path)
    return read(path)


query("s12_prediction_log", "model symbol | n", ctes=V.PREDICTIONS, sql="SELECT model, symbol, count(*) AS n FROM predictions GROUP BY 1, 2")(
    lambda s, d: _written(s, d, lambda p: TB.write_prediction_log(V.predictions(s, d).withColumn("time", F.lit("2024-01-01 10:00:00").cast("timestamp")), p),
                          lambda p: s.read.schema("model string, symbol string").json(p).groupBy("model", "symbol").agg(F.count(F.lit(1)).alias("n"))))
UPD = DAILY + ", base AS (SELECT *, 'old' AS source FROM daily WHERE time < DATE '1999-06-01'), delta AS (SELECT symbol, time, close + 1 AS close, open, high, low, volume * 2 AS volume, 'new' AS source FROM daily WHERE time >= DATE '1998-06-01')"


def _base(s, d):
    return V.daily(s, d).where("time < DATE '1999-06-01'").withColumn("source", F.lit("old"))


def _delta(s, d):
    b = V.daily(s, d).where("time >= DATE '1998-06-01'")
    return b.withColumns({"close": F.col("close") + 1, "volume": F.col("volume") * 2, "source": F.lit("new")})


def _arrivals(s, d):
    """Every row twice, the later one with another price."""
    rows = _delta(s, d).withColumn("arrival", F.lit(1))
    return rows.withColumns({"arrival": F.lit(2), "close": F.lit(0.0), "source": F.lit("again")}).unionByName(rows)


query("s13_upsert", "symbol time source | close open volume", dp=8, ctes=UPD,
      sql="SELECT symbol, time, coalesce(b.source, x.source) AS source, coalesce(x.close, b.close) AS close, coalesce(x.open, b.open) AS open, coalesce(x.volume, b.volume) AS volume FROM base b FULL OUTER JOIN delta x USING (symbol, time)")(
    lambda s, d: TB.upsert(_base(s, d), _delta(s, d)))
query("s14_insert_ignore", "symbol time source | close volume", dp=8, ctes=UPD,
      sql="SELECT symbol, time, source, close, volume FROM base UNION ALL SELECT symbol, time, source, close, volume FROM delta WHERE (symbol, time) NOT IN (SELECT (symbol, time) FROM base)")(
    lambda s, d: TB.insert_ignore(_base(s, d), _arrivals(s, d), ["symbol", "time"], ["arrival"]))
query("s15_save_new_articles", "doc_id url", ctes=NEWS + ", inc AS (SELECT doc_id, CASE WHEN language = 'fr' THEN NULL ELSE url END AS url FROM news)",
      sql="SELECT doc_id, url FROM inc WHERE url IS NULL OR url NOT IN (SELECT url FROM news WHERE label = 'positive')")(
    lambda s, d: TB.new_articles(V.news(s, d).select("doc_id", F.when(F.col("language") != "fr", F.col("url")).alias("url")), V.news(s, d).where("label = 'positive'")))
query("s16_bulk_write", "o_orderkey | o_totalprice", sql="SELECT o_orderkey, o_totalprice FROM orders")(
    lambda s, d: _written(s, d, lambda p: TB.write_table(V.table(s, d, "orders").select("o_orderkey", "o_totalprice"), p), lambda p: s.read.parquet(p)))


def _rules(s, d):
    c = V.table(s, d, "customer")
    kind = pick([A.BREAKOUT, A.PERCENT, A.DIVERGENCE, A.RSI], F.col("c_custkey") % 4)
    return c.select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("rule_id"), kind.alias("type"), F.col("c_name").alias("symbol"), (F.col("c_custkey") % 2 == 0).alias("enabled"),
                    F.when(kind == A.BREAKOUT, F.col("c_acctbal")).alias("breakout_price"))


query("s17_rules_table", "rule_id type symbol enabled direction | breakout_price",
      sql="SELECT concat('r', c_custkey) AS rule_id, ['PriceBreakoutRule','PercentChangeRule','CorrelationDivergenceRule','RSIAlertRule'][CAST(c_custkey % 4 AS INT) + 1] AS type, c_name AS symbol, c_custkey % 2 = 0 AS enabled, CAST(NULL AS VARCHAR) AS direction, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END AS breakout_price FROM customer")(
    lambda s, d: _written(s, d, lambda p: TB.save_rules(_rules(s, d), p), lambda p: TB.load_rules(s, p)))
query("s18_load_keywords", "kind word | | n", ctes="ln AS (SELECT concat(['+','!','# ','','  '][CAST(p_partkey % 5 AS INT) + 1], CASE WHEN p_partkey % 35 = 4 THEN '' ELSE p_name END) AS t FROM part)",
      sql="SELECT kind, word, count(*) AS n FROM (SELECT CASE WHEN t[1] = '+' THEN 'must' WHEN t[1] = '!' THEN 'exclude' ELSE 'general' END AS kind, lower(CASE WHEN t[1] IN ('+', '!') THEN substr(t, 2) ELSE t END) AS word FROM (SELECT trim(t) AS t FROM ln) a WHERE t <> '' AND t[1] <> '#') z GROUP BY 1, 2")(
    lambda s, d: TB.load_keywords(V.table(s, d, "part").select(F.concat(pick(["+", "!", "# ", "", "  "], F.col("p_partkey") % 5), F.when(F.col("p_partkey") % 35 == 4, "").otherwise(F.col("p_name"))).alias("value")))
    .groupBy("kind", "word").agg(F.count(F.lit(1)).alias("n")))
query("s19_partition_layout", "symbol chunk | volume | n", ctes=BARS, sql="SELECT symbol, CAST(time AS DATE) AS chunk, sum(volume) AS volume, count(*) AS n FROM bars GROUP BY 1, 2")(
    lambda s, d: _written(s, d, lambda p: TB.write_price_layout(V.bars(s, d), p), lambda p: s.read.parquet(p).groupBy("symbol", "chunk").agg(F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n"))))
query("s20_retention", "o_orderkey o_orderdate", sql="SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 2 YEARS")(
    lambda s, d: TB.retention(V.table(s, d, "orders"), TB.KEEP_YEARS["sentiment"], "o_orderdate"))

# --- sets ---------------------------------------------------------------------------
query("j14_exclude_existing", "c_custkey", sql="SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")(
    lambda s, d: TB.exclude_existing(V.table(s, d, "customer").select("c_custkey"), V.table(s, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]))
query("u03_intersect_keys", "symbol time", ctes=DAILY, sql="SELECT symbol, time FROM daily WHERE volume > 30 INTERSECT SELECT symbol, time FROM daily WHERE volume < 60")(
    lambda s, d: V.daily(s, d).where("volume > 30").select("symbol", "time").intersect(V.daily(s, d).where("volume < 60").select("symbol", "time")))
query("u04_except_keys", "url", ctes=NEWS, sql="SELECT url FROM news EXCEPT ALL SELECT url FROM news WHERE label = 'positive'")(
    lambda s, d: V.news(s, d).select("url").exceptAll(V.news(s, d).where("label = 'positive'").select("url")))
query("u05_distinct_keywords", "doc_id keywords", sql=f"SELECT doc_id, {hit_list('text')} AS keywords FROM documents")(
    lambda s, d: V.table(s, d, "documents").select("doc_id", X.extract_keywords(F.col("text"), WORDS).alias("keywords")))
query("k02_rank_by_abs_corr", "symbol | correlation | place", dp=4, ctes=DAILY + ", cc AS (SELECT a.symbol, round(corr(a.close, g.close), 4) AS correlation FROM daily a JOIN daily g ON a.time = g.time AND g.symbol = 'Brand#11' GROUP BY 1)",
      sql="SELECT symbol, correlation, row_number() OVER (ORDER BY abs(correlation) DESC, symbol) AS place FROM cc")(
    lambda s, d: P.corr_with(V.daily(s, d), "Brand#11").withColumn(
        "place", F.row_number().over(Window.orderBy(F.abs("correlation").desc(), "symbol"))))
query("k03_news_newest_first", "doc_id time", ctes=NEWS, sql="SELECT doc_id, time FROM news ORDER BY time DESC")(lambda s, d: RW.newest(V.news(s, d)))
query("k09_tail", "symbol time | close | back", ctes=BARS, sql="SELECT symbol, time, close, back FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS back FROM bars) z WHERE back <= 20")(
    lambda s, d: tail(V.bars(s, d), 20))

# --- text ---------------------------------------------------------------------------
query("t01_article_id", "doc_id article_id", sql="SELECT doc_id, substr(md5(concat(split_part(text, chr(10), 1), source, CAST(doc_id AS VARCHAR))), 1, 16) AS article_id FROM documents")(
    lambda s, d: V.table(s, d, "documents").select("doc_id", X.article_id(first_line("text"), F.col("source"), F.col("doc_id")).alias("article_id")))
query("t02_clean_text", "page_id clean", sql=f"SELECT page_id, {clean_sql('html')} AS clean FROM pages")(
    lambda s, d: V.table(s, d, "pages").select("page_id", X.clean_text(F.col("html")).alias("clean")))
query("t02_scoring_text", "doc_id scored", ctes=f"sq AS (SELECT doc_id, {clean_sql('text').replace("regexp_replace(text, '<[^>]+>', '', 'g')", 'text')} AS t FROM documents)",
      sql="SELECT doc_id, CASE WHEN length(t) > 1000 THEN concat(substring(t, 1, 1000), '...') ELSE t END AS scored FROM sq")(
    lambda s, d: V.table(s, d, "documents").select("doc_id", X.clean_for_scoring(F.col("text")).alias("scored")))


def any_sql(text, words):
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


query("t03_keyword_match", "doc_id matched", sql=f"SELECT doc_id, NOT {any_sql('text', ['ähn', 'worthless'])} AND {any_sql('text', ['the', 'und', 'le'])} AND {any_sql('text', ['ion', 'ung'])} AS matched FROM documents")(
    lambda s, d: V.table(s, d, "documents").select("doc_id", X.keyword_match(F.col("text"), ["the", "und", "le"], ["ion", "ung"], ["ähn", "worthless"]).alias("matched")))
query("t04_extract_keywords", "doc_id keywords", sql=f"SELECT doc_id, {hit_list('text', ['gold', 'silver', 'bullion', 'gain', 'the', 'safe haven'])} AS keywords FROM documents")(
    lambda s, d: V.table(s, d, "documents").select("doc_id", X.extract_keywords(F.col("text"), ["gold", "silver", "bullion", "gain", "the", "safe haven"]).alias("keywords")))
query("t05_determine_symbol", "doc_id symbol", sql="SELECT doc_id, " + symbol_sql("text", ["the", "of", "and"], ["le", "und", "en"]) + " AS symbol FROM documents")(
    lambda s, d: V.table(s, d, "documents").select("doc_id", X.determine_symbol(F.col("text"), ["the", "of", "and"], ["le", "und", "en"]).alias("symbol")))
UPW, DNW, ENW = ["ion", "ment", "the"], ["ung", "ere", "isch"], ["en", "que", "er", "an", "on", "un"]
LX = f"lx AS (SELECT doc_id, concat(title, ' ', content) AS t FROM news), lc AS (SELECT *, {count_sql('t', UPW)} AS up, {count_sql('t', DNW)} AS dn FROM lx)"
query("t06_lexicon_sentiment", "doc_id sentiment_label entities | sentiment_score confidence", ctes=NEWS + "," + LX,
      sql="SELECT doc_id, CASE WHEN up > dn THEN 'bullish' WHEN dn > up THEN 'bearish' ELSE 'neutral' END AS sentiment_label, list_slice(list_filter([" + ", ".join(f"CASE WHEN contains(lower(t), '{w}') THEN '{w.upper()}' END" for w in ENW) + "], lambda x: x IS NOT NULL), 1, 5) AS entities, CASE WHEN up > dn THEN least(0.8, 0.3 + up * 0.1) WHEN dn > up THEN greatest(-0.8, -0.3 - dn * 0.1) ELSE 0 END AS sentiment_score, 0.6 AS confidence FROM lc")(
    lambda s, d: X.lexicon_sentiment(V.news(s, d), bullish=UPW, bearish=DNW, entities=ENW))
query("t06_lexicon_sentiment_default", "doc_id sentiment_label | sentiment_score", ctes=NEWS + f", lx AS (SELECT doc_id, concat(title, ' ', content) AS t FROM news), lc AS (SELECT *, {count_sql('t', X.BULLISH)} AS up, {count_sql('t', X.BEARISH)} AS dn FROM lx)",
      sql="SELECT doc_id, CASE WHEN up > dn THEN 'bullish' WHEN dn > up THEN 'bearish' ELSE 'neutral' END AS sentiment_label, CASE WHEN up > dn THEN least(0.8, 0.3 + up * 0.1) WHEN dn > up THEN greatest(-0.8, -0.3 - dn * 0.1) ELSE 0 END AS sentiment_score FROM lc")(
    lambda s, d: X.lexicon_sentiment(V.news(s, d)))
query("t07_composite_index", "doc_id | idx", ctes=NEWS, sql="SELECT doc_id, greatest(0, least(100, ((score + 1) * 50 * 0.6 + p_pos * 100 * 0.4) * least(1.5, greatest(0.5, (doc_id % 25) / CAST(10 AS DOUBLE))))) AS idx FROM news")(
    lambda s, d: V.news(s, d).withColumn("idx", SE.composite_index(F.col("score"), F.col("p_pos"), F.col("doc_id") % 25)))
query("t08_hybrid_route", "doc_id needs_second", ctes=NEWS, sql="SELECT doc_id, greatest(p_pos, p_neg, p_neu) < CAST(0.6 AS DOUBLE) OR p_neu > CAST(0.4 AS DOUBLE) AS needs_second FROM news")(
    lambda s, d: V.news(s, d).withColumn("needs_second", X.needs_second_scorer(F.greatest("p_pos", "p_neg", "p_neu"), F.col("p_neu"))))
HY = NEWS + ", hy AS (SELECT doc_id, score AS s1, greatest(p_pos, p_neg, p_neu) AS c1, label AS l1, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 21) / CAST(10 AS DOUBLE) - 1 END AS s2, 0.6 AS c2 FROM news), hz AS (SELECT *, (s1 * c1 + s2 * c2 * 1.2) / (c1 + c2 * 1.2) AS x FROM hy)"
query("t09_hybrid_combine", "doc_id label source | score confidence first_weight second_weight", ctes=HY,
      sql="SELECT doc_id, CASE WHEN s2 IS NULL THEN l1 WHEN x > 0.15 THEN 'bullish' WHEN x < -0.15 THEN 'bearish' ELSE 'neutral' END AS label, CASE WHEN s2 IS NULL THEN 'first_only' ELSE 'hybrid' END AS source, coalesce(x, s1) AS score, CASE WHEN s2 IS NULL THEN c1 ELSE (c1 + c2) / 2 END AS confidence, CASE WHEN s2 IS NOT NULL THEN c1 / (c1 + c2 * 1.2) END AS first_weight, CASE WHEN s2 IS NOT NULL THEN c2 * 1.2 / (c1 + c2 * 1.2) END AS second_weight FROM hz")(
    lambda s, d: V.news(s, d).select("doc_id", *[c.alias(n) for n, c in X.combine_scores(
        F.col("score"), F.greatest("p_pos", "p_neg", "p_neu"), F.col("label"), F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 21) / 10.0 - 1), F.lit(0.6)).items()]))


def _replies(s, d):
    good = F.to_json(F.struct((F.col("value") / 100).alias("sentiment_score"), F.col("event_type").alias("sentiment_label"), F.array("event_type").alias("key_factors")))
    k = F.col("event_id") % 5
    return V.table(s, d, "events").withColumn("reply", F.when(k == 0, F.lit("not json")).when(k == 1, F.lit('{"confidence": "high"}')).when(k == 2, F.lit("{}")).otherwise(good))


query("t10_parse_scored_reply", "event_id sentiment_label market_impact reasoning key_factors time_horizon | sentiment_score confidence",
      sql="""SELECT event_id, CASE WHEN event_id % 5 > 2 THEN event_type ELSE 'neutral' END AS sentiment_label, CASE WHEN event_id % 5 < 2 THEN 'low' ELSE 'medium' END AS market_impact, CASE WHEN event_id % 5 < 2 THEN 'Error parsing response' ELSE '' END AS reasoning,
  CASE WHEN event_id % 5 > 2 THEN [event_type] ELSE CAST([] AS VARCHAR[]) END AS key_factors, 'short_term' AS time_horizon, CASE WHEN event_id % 5 > 2 THEN value / 100 ELSE 0 END AS sentiment_score, CASE WHEN event_id % 5 < 2 THEN 0.3 ELSE 0.5 END AS confidence FROM events""")(
    lambda s, d: _replies(s, d).select("event_id", X.parse_scored_reply(F.col("reply")).alias("r")).select("event_id", "r.*"))


def _wrapped(s, d):
    k, p = F.col("event_id") % 5, F.col("props")
    return V.table(s, d, "events").withColumn("t", F.when(k == 0, p).when(k == 1, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```\nbye"))).when(k == 2, F.concat(F.lit("text "), p, F.lit(" end")))
                                              .when(k == 3, F.lit("no json } {")).otherwise(F.concat(F.lit("```\n"), p, F.lit("\n```"))))


query("t11_robust_json", "event_id found", sql="SELECT event_id, CASE WHEN event_id % 5 = 3 THEN NULL ELSE props END AS found FROM events")(
    lambda s, d: _wrapped(s, d).select("event_id", X.robust_json(F.col("t")).alias("found")))
query("t12_probs_to_label", "doc_id label | score confidence", ctes=NEWS, sql="SELECT doc_id, CASE WHEN p_pos >= greatest(p_neg, p_neu) THEN 'positive' WHEN p_neg >= p_neu THEN 'negative' ELSE 'neutral' END AS label, p_pos - p_neg AS score, greatest(p_pos, p_neg, p_neu) AS confidence FROM news")(
    lambda s, d: V.news(s, d).select("doc_id", *[c.alias(n) for n, c in X.probs_to_label(F.col("p_pos"), F.col("p_neg"), F.col("p_neu")).items()]))
query("t13_combine_title_content", "doc_id combined", sql="SELECT doc_id, concat_ws(' ', nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), nullif(source, '')) AS combined FROM documents")(
    lambda s, d: V.table(s, d, "documents").select("doc_id", X.combine(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")), F.col("source")).alias("combined")))
query("t14_label_by_threshold", "doc_id label", ctes=NEWS, sql="SELECT doc_id, CASE WHEN score > CAST(0.2 AS DOUBLE) THEN 'positive' WHEN score < CAST(-0.2 AS DOUBLE) THEN 'negative' ELSE 'neutral' END AS label FROM news")(
    lambda s, d: V.news(s, d).select("doc_id", SE.label_by_threshold(F.col("score")).alias("label")))
query("t15_time_decay", "doc_id | weight", ctes=NEWS, sql="SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 0.5 ELSE exp(-floor((epoch(TIMESTAMP '2024-02-01 12:00:00') - epoch(time)) / 86400) / 30) END AS weight FROM news")(
    lambda s, d: V.news(s, d).select("doc_id", X.time_decay(F.when(F.col("doc_id") % 6 == 0, "soon").otherwise(F.date_format("time", "yyyy-MM-dd HH:mm:ss")), "2024-02-01 12:00:00").alias("weight")))
query("t26_doc_id", "page_id id", sql="SELECT page_id, md5(url) AS id FROM pages")(lambda s, d: V.table(s, d, "pages").select("page_id", X.doc_id(F.col("url")).alias("id")))
query("v02_url_dedup", "url doc_id source", ctes=NEWS, sql="SELECT url, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY doc_id) AS k FROM news) z WHERE k = 1")(
    lambda s, d: RW.url_dedup(V.news(s, d).select("url", "doc_id", "source"), ["doc_id"]))
