"""OHLCV bars from ticks. All aggregates merge on the map side, so a busy symbol
sends one partial row per task and bucket, not its ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordering import first_by, last_by
from tidemark.functions.stats import attach, tail


def _bars(ticks: DataFrame, width: str, order, extra=()) -> DataFrame:
    return (
        ticks.groupBy("symbol", F.window("time", width).alias("_w"))
        .agg(
            first_by("price", *order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            last_by("price", *order).alias("close"),
            F.sum("volume").alias("volume"),
            *extra,
        )
        .withColumn("bucket", F.col("_w.start"))
        .drop("_w")
    )


def hourly(ticks: DataFrame, order=("time", "event_id")) -> DataFrame:
    return _bars(ticks, "1 hour", order)


def daily(ticks: DataFrame, order=("time", "event_id")) -> DataFrame:
    """Daily bars with mean and sample deviation of the tick price."""
    return _bars(ticks, "1 day", order,
                 (F.avg("price").alias("avg_price"), F.stddev_samp("price").alias("price_stddev")))


# --- levels -------------------------------------------------------------------

# Retracement and extension ratios, in order of preference on ties.
RETRACE = [("level_0", 0.0), ("level_236", 0.236), ("level_382", 0.382), ("level_500", 0.5),
           ("level_618", 0.618), ("level_100", 1.0)]
EXTEND = [("ext_1272", 0.272), ("ext_1618", 0.618), ("ext_2618", 1.618)]


def _range(df, col, by):
    return df.groupBy(*by).agg(F.max(col).alias("_hi"), F.min(col).alias("_lo"))


def _explode_levels(ranges, by, pairs):
    hi, span = F.col("_hi"), F.col("_hi") - F.col("_lo")
    items = [F.struct(F.lit(i).alias("pos"), F.lit(n).alias("level"), v(hi, span).alias("price"))
             for i, (n, v) in enumerate(pairs)]
    return ranges.select(*by, F.explode(F.array(*items)).alias("_l")).select(*by, "_l.*")


def fibonacci_levels(df: DataFrame, col: str = "close", by=("symbol",)) -> DataFrame:
    pairs = [(n, lambda hi, span, r=r: hi - span * r) for n, r in RETRACE]
    return _explode_levels(_range(df, col, by), by, pairs)


def fibonacci_extensions(df: DataFrame, col: str = "close", by=("symbol",)) -> DataFrame:
    pairs = [(n, lambda hi, span, r=r: hi + span * r) for n, r in EXTEND]
    return _explode_levels(_range(df, col, by), by, pairs)


def nearest_fibonacci(df: DataFrame, col: str = "close", by=("symbol",), time: str = "time") -> DataFrame:
    """The retracement level closest to the last price; the earlier level on ties."""
    last = df.groupBy(*by).agg(F.max_by(col, time).alias("_last"))
    levels = attach(fibonacci_levels(df, col, by), last, by)
    away = F.abs(F.col("price") - F.col("_last"))
    return (
        levels.groupBy(*by)
        .agg(F.min_by(F.struct("level", "price", away.alias("distance")), F.struct(away, F.col("pos"))).alias("_n"))
        .select(*by, "_n.*")
    )


def latest_per_symbol(df: DataFrame, cols, by=("symbol",), order=("time",)) -> DataFrame:
    newest = F.max_by(F.struct(*cols), F.struct(*order))
    return df.groupBy(*by).agg(newest.alias("_n")).select(*by, "_n.*")


def etf_holdings_stats(df: DataFrame, col: str = "holdings", by=("symbol",), order=("time",)) -> DataFrame:
    """Last value and changes over 1, 5 and 20 rows; shorter series use what they have."""
    last = tail(df, 21, by, order)

    def at(k):
        return F.min_by(col, F.when(F.col("back") <= k, -F.col("back")))

    now = F.max(F.when(F.col("back") == 1, F.col(col)))
    prev = F.max(F.when(F.col("back") == 2, F.col(col)))
    return last.groupBy(*by).agg(
        now.alias("current_holdings"), (now - prev).alias("change_1d"),
        (now - at(6)).alias("change_5d"), (now - at(21)).alias("change_20d"),
        F.when(now - at(6) > 0, "increasing").otherwise("decreasing").alias("trend"),
    )


def cot_positioning(df: DataFrame, by=("symbol",), order=("time",), **layout) -> DataFrame:
    """Net positions, their 5-row change and the crowd's state by quantiles."""
    from tidemark.functions.stats import quantiles

    net = df.withColumn("_c", F.col("commercial_long") - F.col("commercial_short")).withColumn(
        "_s", F.col("non_commercial_long") - F.col("non_commercial_short"))
    last = tail(net, 6, by, order)

    def at(col, k):
        return F.max(F.when(F.col("back") == k, F.col(col)))

    def oldest(col):
        return F.max_by(col, "back")

    got = last.groupBy(*by).agg(
        at("_c", 1).alias("commercial_net"), at("_s", 1).alias("speculative_net"),
        (at("_c", 1) - oldest("_c")).alias("commercial_net_change_5w"),
        (at("_s", 1) - oldest("_s")).alias("speculative_net_change_5w"),
        F.coalesce((at("_c", 1) - at("_c", 2) > 0) & (at("_s", 1) - at("_s", 2) < 0), F.lit(False))
        .alias("contrarian_signal"),
    )
    q = quantiles(net, "_s", {"q2": 0.2, "q4": 0.4, "q6": 0.6, "q8": 0.8}, by, **layout)
    x = F.col("speculative_net")
    return attach(got, q, by).withColumn(
        "sentiment",
        F.when(x > F.col("q8"), "extremely_bullish").when(x > F.col("q6"), "bullish")
        .when(x < F.col("q2"), "extremely_bearish").when(x < F.col("q4"), "bearish").otherwise("neutral"),
    ).drop("q2", "q4", "q6", "q8")


