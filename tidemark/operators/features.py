"""Feature columns for models: price, technical, volatility, calendar, direction."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import series as S
from tidemark.functions.stats import above_running_median, attach
from tidemark.operators import momentum, trend, volatility
from tidemark.operators.base import series_operator
from tidemark.operators.volatility import YEAR
from tidemark.series import Series

EPS = 1e-10


@series_operator(lambda **_: max(S.ewm_reach(S.span_alpha(26)), 50))
def price_features(s: Series) -> Series:
    close = F.col("close")
    s = S.ewm_columns(s, ema_12=("close", S.span_alpha(12), True), ema_26=("close", S.span_alpha(26), True))
    s = s.add(
        **{f"close_lag_{n}": S.lag(s, "close", n) for n in (1, 2, 3, 5, 10, 20)},
        **{f"returns_{n}d": S.change(s, "close", n) for n in (1, 5, 20)},
        **{f"ma_{n}": S.mean(s, "close", n) for n in (5, 10, 20, 50)},
        log_returns=F.ln(S.ratio(close, S.lag(s, "close"))),
        momentum_5d=close - S.lag(s, "close", 5),
        momentum_20d=close - S.lag(s, "close", 20),
        daily_range=F.col("high") - F.col("low"),
    )
    return s.add(
        **{f"ma_{n}_ratio": S.ratio("close", f"ma_{n}") for n in (5, 10, 20, 50)},
        daily_range_pct=S.ratio("daily_range", "close"),
    )


@series_operator(lambda **_: trend.macd.reach())
def technical_features(s: Series) -> Series:
    close = F.col("close")
    s = trend.macd.on(s, adjust=True)
    for n in (7, 14, 21):
        s, value = momentum.rsi_columns(s, n, eps=EPS)
        s = s.add(**{f"rsi_{n}": value})
    mid, sd = S.mean(s, "close", 20), S.std(s, "close", 20)
    s = s.add(bb_upper_20=mid + 2 * sd, bb_lower_20=mid - 2 * sd, _x_mid=mid)
    width = F.col("bb_upper_20") - F.col("bb_lower_20")
    s = volatility.atr.on(s, out="atr_14")
    s = momentum.stochastic.on(s, eps=EPS)
    return s.add(
        bb_width_20=S.ratio(width, F.col("_x_mid")),
        bb_position_20=(close - F.col("bb_lower_20")) / (width + EPS),
        atr_ratio=S.ratio("atr_14", "close"),
        **{f"roc_{n}": S.change(s, "close", n) * 100 for n in (5, 10, 20)},
    )


@series_operator(lambda **_: max(S.ewm_reach(S.span_alpha(20)), 62))
def volatility_features(s: Series) -> Series:
    s = s.add(_x_r=S.change(s, "close"), _x_hl=F.pow(F.ln(S.ratio("high", "low")), 2))
    s = s.add(squared_returns=F.col("_x_r") * F.col("_x_r"),
              **{f"volatility_{n}d": S.std(s, "_x_r", n) * YEAR for n in (5, 10, 20, 60)})
    s = s.add(
        volatility_ratio_5_20=F.col("volatility_5d") / (F.col("volatility_20d") + EPS),
        parkinson_vol=F.sqrt(S.mean(s, "_x_hl", 20) / (4 * math.log(2))) * YEAR,
    )
    s = S.ewm_columns(s, ewm_variance=("squared_returns", S.span_alpha(20), True))
    return above_running_median(s, "volatility_20d", "high_volatility_regime")


@series_operator(lambda span=20, **_: S.ewm_reach(S.span_alpha(span)) + 1)
def ewm_variance(s: Series, span: int = 20) -> Series:
    s = s.add(_x_r=S.change(s, "close"))
    s = s.add(_x_sq=F.col("_x_r") * F.col("_x_r"))
    return S.ewm_columns(s, ewm_variance=("_x_sq", S.span_alpha(span), True))


@series_operator(lambda **_: 22)
def volatility_regime(s: Series) -> Series:
    s = s.add(_x_r=S.change(s, "close"))
    s = s.add(volatility_20d=S.std(s, "_x_r", 20) * YEAR)
    return above_running_median(s, "volatility_20d", "high_volatility_regime")


def calendar_features(df: DataFrame, col: str = "time") -> DataFrame:
    day = F.to_date(col)
    dow, month = F.weekday(day), F.month(day)
    turn = 2 * math.pi
    last = F.last_day(day)

    def flag(c):
        return F.when(c, 1).otherwise(0)

    return df.withColumns({
        "day_of_week": dow,
        "day_of_month": F.dayofmonth(day),
        "week_of_year": F.weekofyear(day),
        "month": month,
        "quarter": F.quarter(day),
        "is_monday": flag(dow == 0),
        "is_friday": flag(dow == 4),
        "is_month_start": flag(F.dayofmonth(day) == 1),
        "is_month_end": flag(day == last),
        "is_quarter_end": flag((day == last) & (month % 3 == 0)),
        "day_sin": F.sin(dow * turn / 7),
        "day_cos": F.cos(dow * turn / 7),
        "month_sin": F.sin(month * turn / 12),
        "month_cos": F.cos(month * turn / 12),
    })


@series_operator(0, ahead=lambda h=1, **_: h)
def training_target(s: Series, h: int = 1, col: str = "close", drop: bool = True,
                    features: tuple[str, ...] = ()) -> Series:
    """Return over the next h rows, the price then and its direction."""
    s = s.add(target_price=S.lead(s, col, h))
    s = s.add(target=S.ratio("target_price", col) - 1)
    s = s.add(target_direction=F.when(F.col("target") > 0, 1).otherwise(0))
    return s.with_df(s.df.dropna(subset=["target", *features])) if drop else s


@series_operator(lambda **_: max(S.ewm_reach(S.span_alpha(26)), 61))
def direction_features(s: Series, drop: bool = True) -> Series:
    close = F.col("close")
    s = s.add(**{f"returns_{n}d": S.change(s, "close", n) for n in (1, 5, 20)})
    s, rsi = momentum.rsi_columns(s, 14)
    mid, sd = S.mean(s, "close", 20), S.std(s, "close", 20)
    made = {f"returns_{n}d": F.col(f"returns_{n}d") for n in (1, 5, 20)}
    made |= {f"sma_{n}": S.ratio(S.mean(s, "close", n), close) - 1 for n in (5, 20, 60)}
    made |= {f"volatility_{n}d": S.std(s, "returns_1d", n) for n in (5, 20)}
    made |= {
        "rsi": rsi,
        "bb_position": S.ratio(close - (mid - 2 * sd), 4 * sd),
        "volume_ratio": S.ratio(F.col("volume"), S.mean(s, "volume", 20)),
        "volume_change": S.change(s, "volume"),
        "hl_ratio": S.ratio(F.col("high") - F.col("low"), close),
        "momentum_10": S.change(s, "close", 10),
        "momentum_20": S.change(s, "close", 20),
    }
    s = s.add(**made)
    s = S.ewm_columns(s, _x_f=("close", S.span_alpha(12), True), _x_s=("close", S.span_alpha(26), True)).flush()
    s = s.add(macd=S.ratio(F.col("_x_f") - F.col("_x_s"), close))
    return s.with_df(s.df.dropna(subset=[*made, "macd"])) if drop else s


DIRECTION_COLUMNS = [
    "returns_1d", "returns_5d", "returns_20d", "sma_5", "sma_20", "sma_60", "volatility_5d",
    "volatility_20d", "rsi", "macd", "bb_position", "volume_ratio", "volume_change", "hl_ratio",
    "momentum_10", "momentum_20",
]


@series_operator(0, ahead=lambda h=1, **_: h)
def direction_label(s: Series, h: int = 1, threshold: float = 0.0) -> Series:
    gain = S.ratio(S.lead(s, "close", h), F.col("close")) - 1
    return s.add(label=F.when(gain > threshold, 1).otherwise(0))


def align(features: DataFrame, labels: DataFrame, keys=("symbol", "time")) -> DataFrame:
    """Rows whose key is in both frames."""
    return features.join(labels, list(keys), "inner")


@series_operator(lambda length=10, **_: length)
def sequences(s: Series, length: int = 10, cols: tuple[str, ...] = ("close",)) -> Series:
    """The feature rows of the ``length`` rows before the current one, oldest first."""
    frame = s.w.rowsBetween(-length, -1)
    s = s.add(sequence=F.collect_list(F.array(*cols)).over(frame))
    return s.with_df(s.df.where(F.size("sequence") == length))


def zscore_scale(df: DataFrame, cols, by=("symbol",), inverse: bool = False, stats: DataFrame | None = None):
    """Scale by mean and population deviation + 1e-8 of the key."""
    if stats is None:
        stats = df.groupBy(*by).agg(
            *[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    out = attach(df, stats, by)
    for c in cols:
        m, sd = F.col(f"_m_{c}"), F.col(f"_s_{c}") + 1e-8
        out = out.withColumn(f"{c}_orig" if inverse else f"{c}_z",
                             F.col(f"{c}_z") * sd + m if inverse else (F.col(c) - m) / sd)
    return out.drop(*[f"{p}{c}" for c in cols for p in ("_m_", "_s_")])


def minmax_scale(df: DataFrame, cols, by=("symbol",)) -> DataFrame:
    stats = df.groupBy(*by).agg(
        *[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols])
    out = attach(df, stats, by)
    for c in cols:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        out = out.withColumn(f"{c}_scaled", S.ratio(F.col(c) - lo, hi - lo))
    return out.drop(*[f"{p}{c}" for c in cols for p in ("_lo_", "_hi_")])


# --- joins of side tables -----------------------------------------------------


def _daily_mean(side: DataFrame, cols, keys, time: str) -> DataFrame:
    return side.withColumn("date", F.to_date(time)).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def join_sentiment(prices: DataFrame, sentiment: DataFrame, cols=None, keys=("date",), time: str = "time"):
    """Left-join daily means of the sentiment columns; ratios default to 0.5, the rest to 0."""
    named = ("bullish_ratio", "bearish_ratio", "heat_index", "news_volume")
    cols = cols or [c for c in sentiment.columns if "sentiment" in c.lower() or c in named]
    daily = _daily_mean(sentiment, cols, keys, time)
    out = attach(prices.withColumn("date", F.to_date(time)), daily, keys)
    return out.fillna({c: 0.5 if "ratio" in c else 0.0 for c in cols})


def join_flows(prices: DataFrame, flows: DataFrame, cols=None, keys=("date",), time: str = "time"):
    """Left-join daily means of the flow columns; missing values become 0."""
    cols = cols or [c for c in flows.columns if "flow" in c.lower() or c in ("aum", "shares_outstanding")]
    daily = _daily_mean(flows, cols, keys, time)
    out = attach(prices.withColumn("date", F.to_date(time)), daily, keys)
    return out.fillna({c: 0.0 for c in cols})


def ffill(df: DataFrame, cols, by=("symbol",), order=("time",), **layout) -> DataFrame:
    """Last non-null value up to the current row."""
    s = S.open_series(df, by, order, **layout)
    s = S.running(s, **{f"_f_{c}": ("last", F.col(c)) for c in cols})
    return s.add(**{c: F.col(f"_f_{c}") for c in cols}).close(*[f"_f_{c}" for c in cols])


def join_macro(prices: DataFrame, macro: DataFrame, cols=None, time: str = "time", by=("symbol",),
               order=("time",), max_rows: int | None = None, block_rows: int | None = None) -> DataFrame:
    """Fill the macro table forward, join it on the exact date, fill forward again."""
    cols = cols or [c for c in macro.columns if c not in ("time", "date")]
    dated = macro if "date" in macro.columns else macro.withColumn("date", F.to_date(time))
    filled = ffill(dated.withColumn("_all", F.lit(0)), cols, ("_all",), ("date",), block_rows=block_rows)
    out = attach(prices.withColumn("date", F.to_date(time)), filled.select("date", *cols), ["date"])
    return ffill(out, cols, by, order, max_rows=max_rows, block_rows=block_rows)


def all_features(prices: DataFrame, sentiment=None, flows=None, macro=None, **layout) -> DataFrame:
    """Price, technical, volatility and calendar features plus the given side tables."""
    reach = max(op.reach() for op in (price_features, technical_features, volatility_features))
    s = S.open_series(prices, back=reach, **layout)
    for op in (price_features, technical_features, volatility_features):
        s = op.on(s)
    out = s.close()
    out = calendar_features(out.drop(*[c for c in out.columns if c.startswith("_x")]))
    if sentiment is not None:
        out = join_sentiment(out, sentiment)
    if flows is not None:
        out = join_flows(out, flows)
    if macro is not None:
        out = join_macro(out, macro, max_rows=layout.get("max_rows"), block_rows=layout.get("block_rows"))
    return out
