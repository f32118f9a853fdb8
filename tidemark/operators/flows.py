"""Fund-flow estimates, macro series and sentiment series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import series as S
from tidemark.functions.stats import attach, tail
from tidemark.operators.base import series_operator
from tidemark.series import Series

# ETF names, types and expense ratios.
ETF_INFO = [
    ("GLD", "SPDR Gold Shares", "gold", 0.40),
    ("IAU", "iShares Gold Trust", "gold", 0.25),
    ("GLDM", "SPDR Gold MiniShares", "gold", 0.10),
    ("SGOL", "Aberdeen Physical Gold", "gold", 0.17),
    ("SLV", "iShares Silver Trust", "silver", 0.50),
    ("SIVR", "Aberdeen Physical Silver", "silver", 0.30),
    ("AGQ", "ProShares Ultra Silver", "silver", 0.95),
]


def estimate_flows(df: DataFrame, by=("symbol",), **layout) -> DataFrame:
    """Signed excess dollar volume, its 5- and 20-row sums and an outlier flag."""
    s = S.open_series(df, by, back=41, **layout)
    s = s.add(dollar_volume=F.col("close") * F.col("volume"), _r=S.change(s, "close"),
              _vr=S.ratio(F.col("volume"), S.mean(s, "volume", 20)))
    s = s.add(net_flow=F.coalesce(
        F.col("dollar_volume") * F.signum("_r") * (F.col("_vr") - 1), F.lit(0.0)))
    s = s.add(flow_change_5d=S.total(s, "net_flow", 5), flow_change_20d=S.total(s, "net_flow", 20))
    out = s.close("_r", "_vr")
    stats = out.groupBy(*by).agg(F.avg("net_flow").alias("_m"), F.stddev_samp("net_flow").alias("_s"))
    out = attach(out, stats, by)
    away = F.abs(F.col("net_flow") - F.col("_m")) > 2 * F.col("_s")
    return out.withColumn("is_anomaly", F.coalesce(away, F.lit(False))).drop("_m", "_s")


def shares_history(df: DataFrame, shares: float | None = None, by=("symbol",)) -> DataFrame:
    """Volume relative to its mean over the whole series, and a constant share count."""
    stats = df.groupBy(*by).agg(F.avg("volume").alias("_m"))
    return (
        attach(df, stats, by)
        .withColumn("volume_ratio", S.ratio("volume", "_m"))
        .withColumn("shares_outstanding", F.lit(shares).cast("double"))
        .drop("_m")
    )


def latest_flow_snapshot(flows: DataFrame, info: DataFrame, by: str = "symbol") -> DataFrame:
    """Newest flow row per ETF joined to its name and type."""
    cols = ["net_flow", "flow_change_5d", "flow_change_20d", "is_anomaly", "close", "time"]
    newest = flows.groupBy(by).agg(F.max_by(F.struct(*cols), "time").alias("_l")).select(by, "_l.*")
    return newest.join(info, by).withColumnsRenamed(
        {"net_flow": "latest_flow", "close": "last_price", "time": "last_updated"})


def flow_summary(df: DataFrame, asof, days: int = 30, by: str = "symbol", time: str = "time") -> DataFrame:
    recent = df.where(F.col(time) >= F.date_sub(F.lit(asof), days))
    flow = F.coalesce("net_flow", F.lit(0.0))
    return recent.groupBy(by).agg(
        F.sum(flow).alias("total_flow_30d"),
        S.ratio(F.sum(flow), F.count(F.lit(1))).alias("avg_daily_flow"),
        F.count(F.lit(1)).alias("flow_count"),
        F.max_by("net_flow", time).alias("last_flow"),
    )


def pivot_flows(df: DataFrame, symbols: list[str], last_dates: int = 20, time: str = "time") -> DataFrame:
    """time x symbol sums of the newest dates. The symbols are given, so no extra job."""
    dates = df.select(time).distinct().orderBy(F.col(time).desc()).limit(last_dates)
    recent = df.join(dates, time, "left_semi")
    return recent.groupBy(time).pivot("symbol", symbols).agg(F.sum("net_flow"))


def pivot_macro(df: DataFrame, series: list[str], time: str = "time") -> DataFrame:
    return df.groupBy(time).pivot("series_name", series).agg(F.first("value", ignorenulls=True))


@series_operator(lambda n=12, **_: n)
def macro_derived(s: Series, n: int = 12, cpi: str = "cpi", long: str | None = None, short: str | None = None):
    """Change of the price index over n rows in percent; optional yield spread."""
    s = s.add(cpi_yoy=S.change(s, cpi, n) * 100)
    return s.add(yield_curve_spread=F.col(long) - F.col(short)) if long and short else s


@series_operator(lambda long=20, **_: long + 1)
def sentiment_momentum(s: Series, short: int = 5, long: int = 20, col: str = "sentiment") -> Series:
    s = s.add(ma_short=S.mean(s, col, short), ma_long=S.mean(s, col, long), roc=S.change(s, col, short))
    s = s.add(momentum=F.col("ma_short") - F.col("ma_long"))
    return s.add(acceleration=F.col("momentum") - S.lag(s, "momentum"))


def sentiment_anomalies(df: DataFrame, z: float = 2.0, col: str = "sentiment", volume: str | None = "volume",
                        by=("symbol",), **layout) -> DataFrame:
    """Flags for unusual level, unusual change and high volume with an extreme level."""
    s = S.open_series(df, by, back=1, **layout)
    out = s.add(change=F.abs(F.col(col) - S.lag(s, col))).close()
    names = [c for c in (col, "change", volume) if c]
    stats = out.groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in names], *[F.stddev_samp(c).alias(f"_s_{c}") for c in names])
    out = attach(out, stats, by)

    def zscore(c):
        return (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-6)

    def known(c):
        return F.coalesce(c, F.lit(False))

    out = out.withColumn("z_score", zscore(col))
    out = out.withColumn("is_anomaly_zscore", known(F.abs("z_score") > z)).withColumn(
        "is_anomaly_change", known(F.col("change") > F.col("_m_change") + 2 * F.col("_s_change")))
    loud = F.lit(False)
    if volume:
        out = out.withColumn("volume_zscore", zscore(volume))
        loud = known((F.abs("z_score") > 1.5) & (F.col("volume_zscore") > 1.5))
    out = out.withColumn("is_anomaly_volume", loud)
    out = out.withColumn("is_anomaly", F.col("is_anomaly_zscore") | F.col("is_anomaly_change")
                         | F.col("is_anomaly_volume"))
    return out.drop(*[f"{p}{c}" for c in names for p in ("_m_", "_s_")])


@series_operator(lambda n=10, **_: n + 1)
def sentiment_divergence(s: Series, n: int = 10, sentiment: str = "sentiment", price: str = "price") -> Series:
    s = s.add(sentiment_ma=S.mean(s, sentiment, n), price_ma=S.mean(s, price, n))
    s = s.add(sentiment_trend=F.col("sentiment_ma") - S.lag(s, "sentiment_ma"),
              price_trend=F.col("price_ma") - S.lag(s, "price_ma"))
    ds, dp = F.col("sentiment_trend"), F.col("price_trend")
    no = F.lit(False)
    return s.add(
        bullish_divergence=F.coalesce((dp < 0) & (ds > 0), no),
        bearish_divergence=F.coalesce((dp > 0) & (ds < 0), no),
        divergence_strength=F.abs(F.coalesce(ds, F.lit(0.0)) - F.coalesce(dp, F.lit(0.0)) * 0.01),
    )


def trend_forecast(df: DataFrame, n: int = 30, ahead: int = 7, col: str = "close", by=("symbol",),
                   order=("time",)) -> DataFrame:
    """Mean of the last n rows plus their fitted slope times 1..ahead."""
    last = tail(df, n, by, order).withColumn("_x", (F.lit(n) - F.col("back")).cast("double"))
    fit = last.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(col).alias("_ma"),
        S.ratio(F.covar_pop("_x", col), F.var_pop("_x")).alias("_slope"))
    return (
        fit.where(F.col("_n") == n)
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(ahead))))
        .select(*by, "step", (F.col("_ma") + F.col("_slope") * F.col("step")).alias("forecast"))
    )


@series_operator(0)
def drawdown(s: Series, col: str = "returns") -> Series:
    """Running product of 1 + return, its running maximum and the distance below it."""
    s = S.compounded(s, "cumulative", F.col(col), "_x")
    s = S.running(s, _x_peak=("max", F.col("cumulative")))
    return s.add(drawdown=S.ratio(F.col("cumulative") - F.col("_x_peak"), F.col("_x_peak")))


def max_drawdown(df: DataFrame, by=("symbol",), **kw) -> DataFrame:
    return drawdown(df, by=by, **kw).groupBy(*by).agg(F.min("drawdown").alias("max_drawdown"))
