"""Trend indicators per symbol."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import series as S
from tidemark.operators.base import series_operator
from tidemark.series import Series


@series_operator(lambda n=20, **_: n)
def sma(s: Series, n: int = 20, col: str = "close", out: str = "sma") -> Series:
    return s.add(**{out: S.mean(s, col, n)})


@series_operator(lambda span=12, **_: S.ewm_reach(S.span_alpha(span)))
def ema(s: Series, span: int = 12, col: str = "close", out: str = "ema") -> Series:
    return S.ewm_columns(s, **{out: (col, S.span_alpha(span), False)})


@series_operator(lambda n=10, **_: n)
def wma(s: Series, n: int = 10, col: str = "close", out: str = "wma") -> Series:
    """Linearly weighted mean; the newest row weighs n."""
    weighted = sum((S.lag(s, col, n - i) if i < n else F.col(col)) * i for i in range(1, n + 1))
    return s.add(**{out: weighted / (n * (n + 1) / 2)})


@series_operator(lambda n=20, **_: 2 * S.ewm_reach(S.span_alpha(n)))
def dema(s: Series, n: int = 20, col: str = "close", out: str = "dema") -> Series:
    a = S.span_alpha(n)
    s = S.ewm_columns(s, _x1=(col, a, False), _x2=("_x1", a, False)).flush()
    return s.add(**{out: 2 * F.col("_x1") - F.col("_x2")})


def _macd_reach(slow=26, signal=9, **_):
    return S.ewm_reach(S.span_alpha(slow)) + S.ewm_reach(S.span_alpha(signal))


@series_operator(_macd_reach)
def macd(s: Series, fast: int = 12, slow: int = 26, signal: int = 9, col: str = "close",
         adjust: bool = False, extra: tuple[int, ...] = ()) -> Series:
    """macd, macd_signal, macd_hist and ``ema_<span>`` for each span in ``extra``."""

    def fn(pdf):
        def mean(x, span):
            return x.ewm(span=span, adjust=adjust).mean()

        line = mean(pdf[col], fast) - mean(pdf[col], slow)
        sig = mean(line, signal)
        made = {"macd": line, "macd_signal": sig, "macd_hist": line - sig}
        return made | {f"ema_{n}": mean(pdf[col], n) for n in extra}

    names = ["macd", "macd_signal", "macd_hist", *[f"ema_{n}" for n in extra]]
    return s.later(fn, [(k, "double") for k in names])


@series_operator(lambda n=20, **_: n)
def bollinger(s: Series, n: int = 20, k: float = 2.0, col: str = "close") -> Series:
    mid, sd = S.mean(s, col, n), S.std(s, col, n)
    return s.add(bb_upper=mid + sd * k, bb_middle=mid, bb_lower=mid - sd * k)


def parabolic_sar(df, step: float = 0.02, limit: float = 0.2, by=("symbol",), order=("time",),
                  **layout):
    """Stop-and-reverse line. The next value needs the last state of four numbers,
    which forgets its start after a few reversals."""

    def advance(state, high, low, close):
        if state is None:
            return (close, high, step, True), (close,)
        sar, peak, rate, rising = state
        sar = sar + rate * (peak - sar)
        broke, extreme = (low < sar, low) if rising else (high > sar, high)
        if broke:
            return (peak, extreme, step, not rising), (peak,)
        reach = high if rising else low
        if (reach > peak) if rising else (reach < peak):
            peak, rate = reach, min(rate + step, limit)
        return (sar, peak, rate, rising), (sar,)

    return S.scan(df, by, order, lambda: None, advance, ["high", "low", "close"], [("sar", "double")], **layout)


def true_range(s: Series):
    """Row maximum that skips nulls, so the first row is high - low."""
    prev = S.lag(s, "close")
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )


@series_operator(lambda n=14, **_: 2 * n + 1)
def adx(s: Series, n: int = 14) -> Series:
    """Directional index with plain means as smoothing."""
    up = F.col("high") - S.lag(s, "high")
    down = S.lag(s, "low") - F.col("low")
    s = s.add(
        _x_tr=true_range(s),
        _x_up=F.when((up > down) & (up > 0), up).otherwise(0.0),
        _x_down=F.when((down > up) & (down > 0), down).otherwise(0.0),
    )
    tr = S.mean(s, "_x_tr", n)
    s = s.add(
        plus_di=S.ratio(S.mean(s, "_x_up", n) * 100, tr),
        minus_di=S.ratio(S.mean(s, "_x_down", n) * 100, tr),
    )
    gap, both = F.col("plus_di") - F.col("minus_di"), F.col("plus_di") + F.col("minus_di")
    s = s.add(_x_dx=S.ratio(F.abs(gap) * 100, both))
    return s.add(adx=S.mean(s, "_x_dx", n))


@series_operator(lambda span_b=52, shift=26, **_: span_b + shift, ahead=lambda shift=26, **_: shift)
def ichimoku(s: Series, conv: int = 9, base: int = 26, span_b: int = 52, shift: int = 26) -> Series:
    def mid(n):
        return (S.highest(s, "high", n) + S.lowest(s, "low", n)) / 2

    s = s.add(conversion=mid(conv), base=mid(base), _x_b=mid(span_b))
    return s.add(
        span_a=S.lag(s, (F.col("conversion") + F.col("base")) / 2, shift),
        span_b=S.lag(s, "_x_b", shift),
        lagging=S.lead(s, "close", shift),
    )
