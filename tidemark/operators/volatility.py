"""Volatility indicators per symbol."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark import series as S
from tidemark.operators.base import series_operator
from tidemark.operators.trend import true_range
from tidemark.series import Series

YEAR = math.sqrt(252)


@series_operator(lambda n=14, **_: n + 1)
def atr(s: Series, n: int = 14, out: str = "atr") -> Series:
    s = s.add(_x_tr=true_range(s))
    return s.add(**{out: S.mean(s, "_x_tr", n)})


@series_operator(lambda span=20, n=10, **_: max(S.ewm_reach(S.span_alpha(span)), n + 1))
def keltner(s: Series, span: int = 20, n: int = 10, k: float = 2.0) -> Series:
    s = atr.on(s, n=n, out="_x_atr")
    s = S.ewm_columns(s, kc_middle=("close", S.span_alpha(span), False)).flush()
    mid, width = F.col("kc_middle"), F.col("_x_atr") * k
    return s.add(kc_upper=mid + width, kc_lower=mid - width)


@series_operator(lambda n=20, **_: n)
def rolling_std(s: Series, n: int = 20, col: str = "close") -> Series:
    return s.add(rolling_std=S.std(s, col, n))


@series_operator(lambda n=30, **_: n + 1)
def hist_vol(s: Series, n: int = 30, annual: bool = True) -> Series:
    s = s.add(_x_log=F.ln(S.ratio(F.col("close"), S.lag(s, "close"))))
    return s.add(hist_vol=S.std(s, "_x_log", n) * (YEAR if annual else 1.0))


@series_operator(lambda n=20, **_: n)
def donchian(s: Series, n: int = 20) -> Series:
    high, low = S.highest(s, "high", n), S.lowest(s, "low", n)
    return s.add(dc_upper=high, dc_lower=low, dc_middle=(high + low) / 2)
