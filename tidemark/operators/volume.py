"""Volume indicators per symbol."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import series as S
from tidemark.operators.base import series_operator
from tidemark.series import Series


def _typical():
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def _multiplier():
    high, low, close = F.col("high"), F.col("low"), F.col("close")
    return F.coalesce(S.ratio((close - low) - (high - close), high - low), F.lit(0.0))


@series_operator(1)
def obv(s: Series) -> Series:
    """Running volume signed by the close's direction; starts at the first volume."""
    prev, first = S.lag(s, "close"), F.lag(F.lit(1)).over(s.w).isNull()
    step = F.when(first, F.col("volume")).otherwise(
        F.coalesce(F.signum(F.col("close") - prev) * F.col("volume"), F.lit(0.0))
    )
    return S.running(s.add(_x_step=step), obv=("sum", F.col("_x_step")))


@series_operator(lambda n=14, **_: n + 1)
def mfi(s: Series, n: int = 14) -> Series:
    s = s.add(_x_tp=_typical())
    up = F.col("_x_tp") - S.lag(s, "_x_tp")
    flow = F.col("_x_tp") * F.col("volume")
    s = s.add(
        _x_pos=F.when(up > 0, flow).otherwise(0.0), _x_neg=F.when(up < 0, flow).otherwise(0.0)
    )
    pos, neg = S.total(s, "_x_pos", n), S.total(s, "_x_neg", n)
    value = F.when(neg > 0, 100 - S.ratio(F.lit(100.0), 1 + S.ratio(pos, neg)))
    return s.add(mfi=value.when(pos > 0, F.lit(100.0)))


@series_operator(0)
def vwap(s: Series) -> Series:
    """Volume-weighted price from the first row of the series on."""
    s = S.running(
        s, _x_pv=("sum", _typical() * F.col("volume")), _x_v=("sum", F.col("volume"))
    )
    return s.add(vwap=S.ratio("_x_pv", "_x_v"))


@series_operator(lambda n=20, **_: n)
def cmf(s: Series, n: int = 20) -> Series:
    s = s.add(_x_mv=_multiplier() * F.col("volume"))
    return s.add(cmf=S.ratio(S.total(s, "_x_mv", n), S.total(s, "volume", n)))


@series_operator(0)
def acc_dist(s: Series) -> Series:
    return S.running(s, acc_dist=("sum", _multiplier() * F.col("volume")))
