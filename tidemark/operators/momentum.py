"""Momentum indicators per symbol."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import series as S
from tidemark.operators.base import series_operator
from tidemark.series import Series


def rsi_columns(s: Series, n: int, col: str = "close", eps: float = 0.0) -> tuple[Series, Column]:
    """Series with gains and losses added, and the RSI over n rows.

    The first row counts as no gain and no loss, so row n already has a value.
    With ``eps`` 0 a frame without losses gives 100, one without moves null.
    """
    if "_x_gain" not in s.df.columns:
        delta = F.col(col) - S.lag(s, col)
        s = s.add(
            _x_gain=F.when(delta > 0, delta).otherwise(0.0),
            _x_loss=F.when(delta < 0, -delta).otherwise(0.0),
        )
    gain, loss = S.mean(s, "_x_gain", n), S.mean(s, "_x_loss", n)
    if eps:
        return s, 100 - 100 / (1 + gain / (loss + eps))
    return s, F.when(loss > 0, 100 - S.ratio(F.lit(100.0), 1 + S.ratio(gain, loss))).when(
        gain > 0, F.lit(100.0)
    )


@series_operator(lambda n=14, **_: n + 1)
def rsi(s: Series, n: int = 14, col: str = "close", out: str = "rsi") -> Series:
    s, value = rsi_columns(s, n, col)
    return s.add(**{out: value})


@series_operator(lambda k=14, d=3, **_: k + d)
def stochastic(s: Series, k: int = 14, d: int = 3, eps: float = 0.0) -> Series:
    low, high = S.lowest(s, "low", k), S.highest(s, "high", k)
    s = s.add(stoch_k=S.ratio((F.col("close") - low) * 100, high - low + eps))
    return s.add(stoch_d=S.mean(s, "stoch_k", d))


@series_operator(lambda n=20, **_: n)
def cci(s: Series, n: int = 20) -> Series:
    s = s.add(_x_tp=(F.col("high") + F.col("low") + F.col("close")) / 3)
    s = s.add(_x_list=F.collect_list("_x_tp").over(s.rows(n)), _x_mean=S.mean(s, "_x_tp", n))
    away = F.aggregate(
        "_x_list", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("_x_mean"))
    )
    return s.add(cci=S.ratio(F.col("_x_tp") - F.col("_x_mean"), away / n * 0.015))


@series_operator(lambda n=14, **_: n)
def williams_r(s: Series, n: int = 14) -> Series:
    high, low = S.highest(s, "high", n), S.lowest(s, "low", n)
    return s.add(williams_r=S.ratio((high - F.col("close")) * -100, high - low))


@series_operator(lambda n=12, **_: n)
def roc(s: Series, n: int = 12, col: str = "close") -> Series:
    old = S.lag(s, col, n)
    return s.add(roc=S.ratio((F.col(col) - old) * 100, old))


@series_operator(lambda n=10, **_: n)
def momentum(s: Series, n: int = 10, col: str = "close") -> Series:
    return s.add(momentum=F.col(col) - S.lag(s, col, n))
