"""Input views over the given tables, as DataFrames and as SQL for the twins."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ordering import first_by, last_by


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


@functools.lru_cache(maxsize=64)
def _span_seconds(spark: SparkSession, sf_dir: str, name: str, col: str) -> float:
    """Length of a time column: one two-value aggregate over one column."""
    t = F.unix_micros(F.col(col).cast("timestamp"))
    lo, hi = table(spark, sf_dir, name).agg(F.min(t), F.max(t)).first()
    return 0.0 if lo is None else (hi - lo) / 1e6


def hours_bound(spark, sf_dir) -> int:
    """No symbol can have more hourly bars than the events span hours."""
    return math.ceil(_span_seconds(spark, sf_dir, "events", "ts") / 3600) + 1


def days_bound(spark, sf_dir) -> int:
    """No symbol can have more daily rows than the line items span days."""
    return math.ceil(_span_seconds(spark, sf_dir, "lineitem", "l_shipdate") / 86400) + 1


def ticks(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id",
        F.col("event_type").alias("symbol"),
        F.col("ts").alias("time"),
        (F.col("value") + 1.0).alias("price"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("volume"),
    )


TICKS = """ticks AS (SELECT event_id, event_type AS symbol, CAST(ts AS TIMESTAMP) AS time,
  value + 1.0 AS price, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS volume FROM events)"""


def bars(spark, d) -> DataFrame:
    """Hourly bars per symbol from the events."""
    return (
        ticks(spark, d)
        .groupBy("symbol", F.date_trunc("hour", "time").alias("time"))
        .agg(
            first_by("price", "time", "event_id").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            last_by("price", "time", "event_id").alias("close"),
            F.sum("volume").alias("volume"),
        )
    )


BARS = TICKS + """,
bars AS (SELECT symbol, date_trunc('hour', time) AS time,
  first(price ORDER BY time, event_id) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY time, event_id) AS close, sum(volume) AS volume
  FROM ticks GROUP BY symbol, date_trunc('hour', time))"""

# price depends on the last two, so rows that tie on all four have the same price
_TRADE_ORDER = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"]


def trades(spark, d) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    return (
        table(spark, d, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("p_brand").alias("symbol"),
            F.to_date("l_shipdate").alias("day"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").alias("qty"),
            F.col("l_extendedprice").alias("amount"),
            F.col("l_returnflag").alias("flag"),
            F.struct(*_TRADE_ORDER).alias("seq"),
        )
    )


def daily(spark, d) -> DataFrame:
    """Daily bars per brand from the line items; long histories."""
    return (
        trades(spark, d)
        .groupBy("symbol", F.col("day").alias("time"))
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.sum("qty").cast("double").alias("volume"),
        )
    )


_SEQ = ", ".join(_TRADE_ORDER)
TRADES = f"""trades AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS day,
  l_extendedprice / l_quantity AS price, l_quantity AS qty, l_extendedprice AS amount, l_returnflag AS flag, {_SEQ}
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
DAILY = TRADES + f""",
daily AS (SELECT symbol, day AS time, first(price ORDER BY {_SEQ}) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY {_SEQ}) AS close, CAST(sum(qty) AS DOUBLE) AS volume FROM trades GROUP BY symbol, day)"""


def flows(spark, d) -> DataFrame:
    t = trades(spark, d)
    signed = F.when(F.col("flag") == "R", -F.col("amount")).otherwise(F.col("amount"))
    return t.groupBy("symbol", F.col("day").alias("time")).agg(
        F.sum(signed).alias("net_flow"), F.sum("qty").cast("double").alias("volume")
    )


FLOWS = TRADES + """,
flows AS (SELECT symbol, day AS time, sum(CASE WHEN flag = 'R' THEN -amount ELSE amount END) AS net_flow,
  CAST(sum(qty) AS DOUBLE) AS volume FROM trades GROUP BY symbol, day)"""


def news(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    p_pos = (F.col("n_chars") % 7).cast("double") / 14
    p_neg = (F.col("doc_id") % 7).cast("double") / 14
    p_neu = F.lit(1.0) - p_pos - p_neg
    return docs.select(
        "doc_id",
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 600).alias("time"),
        F.concat(F.lit("S"), (F.col("doc_id") % 5).cast("string")).alias("symbol"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("content"),
        "source",
        F.col("lang").alias("language"),
        F.concat(F.lit("u/"), (F.col("doc_id") % 900).cast("string")).alias("url"),
        p_pos.alias("p_pos"),
        p_neg.alias("p_neg"),
        p_neu.alias("p_neu"),
        (p_pos - p_neg).alias("score"),
        F.when(p_pos - p_neg > 0.2, "positive")
        .when(p_pos - p_neg < -0.2, "negative")
        .otherwise("neutral")
        .alias("label"),
    )


NEWS = """news0 AS (SELECT doc_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 600) AS time,
  concat('S', CAST(doc_id % 5 AS VARCHAR)) AS symbol, split_part(text, chr(10), 1) AS title, text AS content, source,
  lang AS language, concat('u/', CAST(doc_id % 900 AS VARCHAR)) AS url,
  CAST(n_chars % 7 AS DOUBLE) / 14 AS p_pos, CAST(doc_id % 7 AS DOUBLE) / 14 AS p_neg FROM documents),
news AS (SELECT *, CAST(1 AS DOUBLE) - p_pos - p_neg AS p_neu, p_pos - p_neg AS score,
  CASE WHEN p_pos - p_neg > CAST(0.2 AS DOUBLE) THEN 'positive' WHEN p_pos - p_neg < CAST(-0.2 AS DOUBLE) THEN 'negative' ELSE 'neutral' END AS label
  FROM news0)"""


def calls(spark, d) -> DataFrame:
    """Model calls: one per conversation turn."""
    c = table(spark, d, "conversations")
    models = ["gpt-4o", "gpt-4o-mini", "gpt-4-turbo", "other-model"]
    chars = F.length("text").cast("long")
    return c.select(
        "conv_id",
        "turn",
        F.timestamp_seconds(
            F.lit(1704067200) + F.col("conv_id").cast("long") * 3600 + F.col("turn").cast("long") * 60
        ).alias("time"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("conv_id") % 3 + 1).cast("int"))
        .alias("provider"),
        F.element_at(F.array(*map(F.lit, models)), (F.col("conv_id") % 4 + 1).cast("int")).alias("model"),
        F.col("role").alias("task_type"),
        chars.alias("input_tokens"),
        F.floor(chars / 3.0).cast("long").alias("output_tokens"),
        (F.col("turn") % 5 == 0).alias("cached"),
        ((chars % 50) / 10.0).alias("latency_s"),
        "text",
    )


CALLS = """calls AS (SELECT conv_id, turn, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 3600 + turn * 60) AS time,
  ['a','b','c'][conv_id % 3 + 1] AS provider,
  ['gpt-4o','gpt-4o-mini','gpt-4-turbo','other-model'][conv_id % 4 + 1] AS model, role AS task_type,
  CAST(length(text) AS BIGINT) AS input_tokens, CAST(floor(length(text) / 3.0) AS BIGINT) AS output_tokens,
  turn % 5 = 0 AS cached, CAST(length(text) % 50 AS DOUBLE) / CAST(10 AS DOUBLE) AS latency_s, text FROM conversations)"""


def holders(spark, d) -> DataFrame:
    """Quarterly positions of customers per market segment."""
    cust = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return (
        table(spark, d, "orders")
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.col("c_mktsegment").alias("symbol"),
            F.col("c_name").alias("name"),
            F.date_trunc("quarter", "o_orderdate").cast("date").alias("report_date"),
        )
        .agg(F.sum("o_totalprice").alias("shares"))
    )


HOLDERS = """holders AS (SELECT c_mktsegment AS symbol, c_name AS name, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS report_date,
  sum(o_totalprice) AS shares FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY c_mktsegment, c_name, CAST(date_trunc('quarter', o_orderdate) AS DATE))"""


def requests(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id",
        F.col("ts").alias("time"),
        F.col("user_id").alias("client"),
        F.col("event_type").alias("endpoint"),
        (F.col("value") / 100.0).alias("latency_s"),
    )


REQUESTS = """requests AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS time, user_id AS client, event_type AS endpoint,
  value / CAST(100 AS DOUBLE) AS latency_s FROM events)"""


def predictions(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("model"),
        F.col("l_linestatus").alias("symbol"),
        F.col("l_extendedprice").alias("actual"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("predicted"),
    )


PREDICTIONS = """predictions AS (SELECT l_returnflag AS model, l_linestatus AS symbol, l_extendedprice AS actual,
  l_extendedprice * (1 - l_discount) AS predicted FROM lineitem)"""


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(
        "vec_id",
        F.col("embedding"),
        "label",
        F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 3600).alias("time"),
    )


VECTORS = """vectors AS (SELECT vec_id, embedding, label,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(vec_id * 3600) AS time FROM embeddings)"""
