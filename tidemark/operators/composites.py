"""Several indicators of one table over one shared layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import series as S
from tidemark.functions.stats import attach
from tidemark.operators import bars, momentum, trend
from tidemark.operators.base import series_operator
from tidemark.series import Series


@series_operator(lambda **_: max(trend.macd.reach(), 50))
def technical_analysis(s: Series, col: str = "close") -> Series:
    """Means, RSI, MACD and bands of one price column."""
    s = trend.macd.on(s, col=col, extra=(12,))
    s = trend.bollinger.on(s, col=col)
    s, value = momentum.rsi_columns(s, 14, col)
    width = F.col("bb_upper") - F.col("bb_lower")
    return s.add(
        sma_20=S.mean(s, col, 20),
        sma_50=S.mean(s, col, 50),
        rsi=value,
        bb_width=width,
        bb_position=S.ratio(F.col(col) - F.col("bb_lower"), width),
    )


def with_fibonacci(df: DataFrame, col: str = "close", by=("symbol",)) -> DataFrame:
    """Retracement levels and extensions of each key's whole price range, one column each (level_236, ext_1618, ...)."""
    span = F.col("_hi") - F.col("_lo")
    wide = attach(df, bars._range(df, col, by), by)
    return wide.withColumns({n: F.col("_hi") - span * r for n, r in bars.RETRACE} | {n: F.col("_hi") + span * r for n, r in bars.EXTEND}).drop("_hi", "_lo")


@series_operator(lambda **_: 51)
def price_indicators(s: Series) -> Series:
    s = s.add(returns=S.change(s, "close"))
    s = trend.bollinger.on(s)
    s, value = momentum.rsi_columns(s, 14)
    return s.add(
        ma_5=S.mean(s, "close", 5),
        ma_20=S.mean(s, "close", 20),
        ma_50=S.mean(s, "close", 50),
        volatility_20=S.std(s, "returns", 20),
        rsi_14=value,
    )


def with_state_labels(df: DataFrame) -> DataFrame:
    """Names for the states of rsi, macd and the band position (T16)."""
    rsi, pos = F.col("rsi"), F.col("bb_position")
    out = df.withColumn(
        "rsi_signal",
        F.when(rsi > 70, "OVERBOUGHT").when(rsi < 30, "OVERSOLD").when(rsi.isNotNull(), "NEUTRAL"),
    )
    if "macd" in df.columns:
        out = out.withColumn(
            "macd_signal_label",
            F.when(F.col("macd") > F.col("macd_signal"), "BULLISH").otherwise("BEARISH"),
        )
    return out.withColumn(
        "bollinger_signal",
        F.when(pos > 1, "ABOVE_UPPER_BAND")
        .when(pos < 0, "BELOW_LOWER_BAND")
        .when(pos > 0.8, "NEAR_UPPER_BAND")
        .when(pos < 0.2, "NEAR_LOWER_BAND")
        .when(pos.isNotNull(), "MIDDLE_RANGE"),
    )
