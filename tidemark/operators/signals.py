"""Trading signals on every bar. Columns: symbol, time, strategy, signal, strength."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import series as S
from tidemark.operators import momentum
from tidemark.operators.base import series_operator
from tidemark.operators.trend import true_range
from tidemark.series import Series

# Vote of each signal.
SCORES = {"STRONG_SELL": -2, "SELL": -1, "HOLD": 0, "BUY": 1, "STRONG_BUY": 2}


def _capped(strength: Column) -> Column:
    return F.least(strength, F.lit(1.0))


@series_operator(lambda slow=30, atr=14, **_: max(slow, atr) + 1)
def trend_signal(s: Series, fast: int = 10, slow: int = 30, atr: int = 14, position: str | None = None) -> Series:
    """Two means decide the side; stop and target are 2 and 4 ranges away."""
    held = F.col(position) if position else F.lit(0.0)
    s = s.add(ma_fast=S.mean(s, "close", fast), ma_slow=S.mean(s, "close", slow), _x_tr=true_range(s))
    s = s.add(atr=S.mean(s, "_x_tr", atr))
    f, w, price = F.col("ma_fast"), F.col("ma_slow"), F.col("close")
    buy, sell = (f > w) & (held <= 0), (f < w) & (held >= 0)
    return s.add(
        strategy=F.lit("Trend Following"),
        signal=F.when(buy, "BUY").when(sell, "SELL").otherwise("HOLD"),
        strength=F.when(buy, _capped(S.ratio(f - w, w) * 10)).when(sell, _capped(S.ratio(w - f, w) * 10)).otherwise(0.0),
        stop_loss=price - 2 * F.col("atr"),
        take_profit=price + 4 * F.col("atr"),
    )


@series_operator(lambda n=20, rsi=14, **_: max(n, rsi) + 1)
def mean_reversion_signal(s: Series, n: int = 20, k: float = 2.0, rsi: int = 14) -> Series:
    """Price outside its band while the RSI confirms."""
    s, value = momentum.rsi_columns(s, rsi)
    mid, sd = S.mean(s, "close", n), S.std(s, "close", n)
    s = s.add(bb_upper=mid + sd * k, bb_lower=mid - sd * k, rsi=value)
    p, lo, hi, r = F.col("close"), F.col("bb_lower"), F.col("bb_upper"), F.col("rsi")
    buy, sell = (p < lo) & (r < 30), (p > hi) & (r > 70)
    return s.add(
        strategy=F.lit("Mean Reversion"),
        signal=F.when(buy, "BUY").when(sell, "SELL").otherwise("HOLD"),
        strength=F.when(buy, _capped(S.ratio(lo - p, lo) * 5 + (30 - r) / 30))
        .when(sell, _capped(S.ratio(p - hi, hi) * 5 + (r - 70) / 30)).otherwise(0.0),
    )


SIGNAL_COLUMNS = ["symbol", "time", "strategy", "signal", "strength", "close"]


def run_strategies(bars: DataFrame, strategies: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Union of user strategies: functions from bars to rows with SIGNAL_COLUMNS; ``position`` is the strategy's place."""
    out = None
    for i, fn in enumerate(strategies):
        part = fn(bars).select(*SIGNAL_COLUMNS, F.lit(i).alias("position"))
        out = part if out is None else out.unionByName(part)
    return out


def consensus(signals: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted vote of all strategies per symbol and time. The reasoning names them by ``position`` where the rows have
    one, then by name."""
    weights = weights or {}
    lookup = F.create_map(*[F.lit(x) for k, v in (weights or {"": 1.0}).items() for x in (k, float(v))])
    weight = F.coalesce(F.try_element_at(lookup, F.col("strategy")), F.lit(1.0))
    votes = F.create_map(*[F.lit(x) for k, v in SCORES.items() for x in (k, v)])
    scored = signals.withColumn("_w", weight).withColumn(
        "_v", F.coalesce("strength", F.lit(0.0)) * F.try_element_at(votes, F.col("signal")) * F.col("_w"))
    place = F.col("position") if "position" in signals.columns else F.lit(0)
    said = F.concat("strategy", F.lit(" ("), F.lower("signal"), F.lit(")"))
    active = F.when(F.col("signal") != "HOLD", F.struct(place.alias("i"), F.col("strategy").alias("s"), said.alias("t")))
    got = scored.groupBy("symbol", "time").agg(
        F.coalesce(S.ratio(F.sum("_v"), F.sum("_w")), F.lit(0.0)).alias("consensus_score"),
        F.array_sort(F.collect_list(active)).alias("_a"))
    x = F.col("consensus_score")
    return got.select(
        "symbol", "time", "consensus_score",
        F.when(x >= 1.5, "STRONG_BUY").when(x >= 0.5, "BUY").when(x <= -1.5, "STRONG_SELL").when(x <= -0.5, "SELL")
        .otherwise("HOLD").alias("signal"),
        F.least(F.abs(x) / 2, F.lit(1.0)).alias("strength"),
        F.when(F.size("_a") > 0, F.concat(
            F.lit("Consensus from "), F.size("_a").cast("string"), F.lit(" strategies: "), F.array_join(F.col("_a")["t"], "; ")))
        .otherwise("No clear signals from any strategy").alias("reasoning"))


def sentiment_signal(df: DataFrame, bullish: float = 0.3, bearish: float = -0.3, col: str = "sentiment_score"):
    x = F.col(col)
    return df.withColumn("direction", F.when(x > bullish, 1).when(x < bearish, -1).otherwise(0)).withColumn(
        "strength", F.abs(x))


def probability_signal(df: DataFrame, long: float = 0.6, short: float = 0.4, col: str = "probability") -> DataFrame:
    p = F.col(col)
    return df.withColumns({
        "direction": F.when(p > long, 1).when(p < short, -1).otherwise(0),
        "strength": F.when(p > long, _capped(p)).when(p < short, _capped(1 - p)).otherwise(0.5),
        "confidence": F.abs(p - 0.5) * 2})


@series_operator(lambda slow=50, **_: slow + 1)
def ma_signal(s: Series, fast: int = 20, slow: int = 50) -> Series:
    """Mean of the last ``fast`` bars against the mean of the visible bars, which are
    up to slow + 1; null before ``slow`` bars are there."""
    frame = s.rows(slow + 1)
    quick, wide = S.mean(s, "close", fast), F.avg("close").over(frame)
    ready = F.count("close").over(frame) >= slow
    return s.add(direction=F.when(ready, F.when(quick > wide, 1).when(quick < wide, -1).otherwise(0)))
