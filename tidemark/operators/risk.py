"""Value at risk, simulation and stress scenarios."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import series as S
from tidemark.functions.stats import moments, with_quantiles

# Scenario, probability, shocks.
SCENARIOS = [
    ("2008_financial_crisis", 0.01, {"gold_return": 0.05, "stocks_return": -0.40, "vix_change": 3.0, "credit_spread": 0.06}),
    ("fed_hawkish_shock", 0.05, {"gold_return": -0.15, "stocks_return": -0.20, "dxy_return": 0.10, "bond_yield_change": 0.02}),
    ("geopolitical_crisis", 0.03, {"gold_return": 0.20, "stocks_return": -0.25, "oil_return": 0.50, "vix_change": 2.5}),
    ("inflation_surge", 0.04, {"gold_return": 0.15, "stocks_return": -0.15, "inflation_change": 0.05, "bond_yield_change": 0.03}),
    ("liquidity_crisis", 0.02, {"gold_return": -0.10, "stocks_return": -0.35, "credit_spread": 0.08, "volume_shock": -0.70}),
    ("china_slowdown", 0.03, {"gold_return": -0.08, "copper_return": -0.30, "mining_stocks": -0.40, "emfx_return": -0.20}),
]


def historical_var(df: DataFrame, level: float = 0.95, col: str = "returns", by=("symbol",), **layout) -> DataFrame:
    """Interpolated percentile of the returns and the mean of the returns at or below it."""
    rows = with_quantiles(df.select(*by, col), col, {"var": 1 - level}, by, **layout)
    return rows.groupBy(*by).agg(F.max("var").alias("var"), F.avg(F.when(F.col(col) <= F.col("var"), F.col(col))).alias("cvar"))


def _moments(df, col, by):
    m = moments(col)
    return df.where(F.col(col).isNotNull()).groupBy(*by).agg(*[v.alias(f"_{k}") for k, v in m.items()])


def parametric_var(df: DataFrame, level: float = 0.95, distribution: str = "normal", col: str = "returns",
                   by=("symbol",)) -> DataFrame:
    """VaR from mean and deviation under a normal, Student t or adjusted normal law.

    The adjustment subtracts 3 from an excess kurtosis, as defined.
    """
    m = _moments(df, col, by)
    mu, sd = F.col("_mean"), F.col("_std")
    z = NormalDist().inv_cdf(1 - level)
    if distribution == "normal":
        var = mu + sd * z
        out = m.select(*by, var.alias("var"), (mu - sd * (NormalDist().pdf(z) / (1 - level))).alias("cvar"))
    elif distribution == "t_student":
        dof = F.greatest(F.lit(6.0) / F.greatest("_kurt", F.lit(0.1)) + 4, F.lit(5.0))
        m = m.withColumn("dof", dof)
        m = m.withColumn("_t", t_quantile(1 - level, F.col("dof")))
        var = mu + F.col("_t") * sd * F.sqrt((F.col("dof") - 2) / F.col("dof"))
        out = m.select(*by, "dof", var.alias("var"), (var * 1.2).alias("cvar"))
    elif distribution == "skewed_t":
        shift = F.col("_skew") * ((z * z - 1) / 6) + (F.col("_kurt") - 3) * ((z ** 3 - 3 * z) / 24)
        var = mu + (shift + z) * sd
        out = m.select(*by, var.alias("var"), (var * 1.15).alias("cvar"))
    else:
        raise ValueError(f"unknown distribution {distribution}")
    return out


def _t_cdf(t: float, dof: float) -> float:
    """Student t distribution function by integrating the density after t = sqrt(v) tan(a)."""
    steps = 2000
    top = math.atan(abs(t) / math.sqrt(dof))
    h = top / steps
    y = np.cos(np.linspace(0.0, top, steps + 1)) ** (dof - 1)
    total = y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()
    scale = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(math.pi)
    half = scale * total * h / 3
    return 0.5 + half if t >= 0 else 0.5 - half


def t_quantile(p: float, dof: Column) -> Column:
    """Quantile of the Student t law; meant for one row per group."""

    def solve(v):
        if not v == v:
            return None
        lo, hi = -1e3, 1e3
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if _t_cdf(mid, v) < p else (lo, mid)
        return (lo + hi) / 2

    def batch(v: pd.Series) -> pd.Series:
        return v.map(solve)

    return F.pandas_udf(batch, "double")(dof)


def _with_normals(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Add n standard normals z0.. that depend only on (draw, seed), whatever the
    partitioning: digest, four uniforms per digest, two normals per four uniforms.

    Each stage is its own projection because the next one reads it several times.
    """
    digests = range(math.ceil(n / 2))
    out = df.withColumns({
        f"_d{k}": F.md5(F.concat_ws("|", F.col("draw").cast("string"), F.lit(str(seed)), F.lit(str(k))))
        for k in digests})
    out = out.withColumns({
        f"_u{k}_{i}": (F.conv(F.substring(f"_d{k}", 1 + 8 * i, 8), 16, 10).cast("double") + 0.5) / float(2 ** 32)
        for k in digests for i in range(4)})
    return out.select(*df.columns, *[
        (F.sqrt(F.ln(f"_u{j // 2}_{2 * (j % 2)}") * -2) * F.cos(F.col(f"_u{j // 2}_{2 * (j % 2) + 1}") * (2 * math.pi)))
        .alias(f"z{j}") for j in range(n)])


def _tail(draw: Column, normals: int, n: int, level: float, seed: int, spark) -> DataFrame:
    """One row over n standard draws: least, percentile, mean of the draws at or below it, and their share.

    Every key uses the same draws, scaled by its deviation and shifted by its mean, and scaling keeps their order. So the
    figures of the standard draws give those of every key; no key has draws of its own.
    """
    ids = spark.range(n).withColumnRenamed("id", "draw")
    standard = _with_normals(ids, normals, seed).select(F.lit(0).alias("_one"), draw.alias("z"))
    rows = with_quantiles(standard, "z", {"q": 1 - level}, ("_one",), max_rows=n)
    low = F.col("z") <= F.col("q")
    return rows.agg(F.min("z").alias("_least"), F.max("q").alias("_q"), F.avg(F.when(low, F.col("z"))).alias("_low"),
                    S.ratio(F.count_if(low), F.count(F.lit(1))).alias("_share"))


def _scaled(df: DataFrame, tail: DataFrame, col: str, by) -> DataFrame:
    """Mean and deviation per key beside the one row of ``tail``."""
    stats = df.where(F.col(col).isNotNull()).groupBy(*by).agg(F.avg(col).alias("_m"), F.stddev_samp(col).alias("_s"))
    row = tail.select(F.struct("*").alias("_t")).scalar()
    return stats.withColumn("_t", row).select(*by, "_m", "_s", "_t.*")


def monte_carlo_var(df: DataFrame, level: float = 0.95, n: int = 10000, horizon: int = 1, seed: int = 42,
                    col: str = "returns", by=("symbol",)) -> DataFrame:
    """Percentile and tail mean of n normal draws per key; null for a key of one row."""
    rows = _scaled(df, _tail(F.col("z0"), 1, n, level, seed, df.sparkSession), col, by)
    mean, width = F.col("_m") * horizon, F.col("_s") * math.sqrt(horizon)
    return rows.select(*by, (mean + width * F.col("_q")).alias("var"), (mean + width * F.col("_low")).alias("cvar"))


def monte_carlo_stress(df: DataFrame, level: float = 0.99, n: int = 10000, dof: int = 5, seed: int = 42,
                       col: str = "returns", by=("symbol",)) -> DataFrame:
    """Worst draw, percentile, shortfall and tail share of n Student t draws per key; all draws of a key without spread
    are its mean, so all are in its tail. Null for a key of one row."""
    chi = F.pow("z1", 2)
    for j in range(2, dof + 1):
        chi = chi + F.pow(f"z{j}", 2)
    t = F.col("z0") / F.sqrt(chi / dof)
    rows = _scaled(df, _tail(t, dof + 1, n, level, seed, df.sparkSession), col, by)

    def at(figure: str) -> Column:
        return F.col("_m") + F.col("_s") * F.col(figure)

    return rows.select(
        *by, at("_least").alias("worst_case"), at("_q").alias("worst_percentile"), at("_low").alias("expected_shortfall"),
        F.when(F.col("_s") == 0, 1.0).when(F.col("_s").isNotNull(), F.col("_share")).alias("extreme_loss_probability"))


def compare_var_methods(df: DataFrame, level: float = 0.95, by=("symbol",), **kw) -> DataFrame:
    parts = {
        "Historical": historical_var(df, level, by=by),
        "Parametric Normal": parametric_var(df, level, "normal", by=by),
        "Parametric t-Student": parametric_var(df, level, "t_student", by=by),
        "Monte Carlo": monte_carlo_var(df, level, by=by, **kw),
    }
    out = None
    for name, part in parts.items():
        part = part.select(*by, F.lit(name).alias("method"), "var", "cvar", (F.col("var") * 100).alias("var_pct"),
                           (F.col("cvar") * 100).alias("cvar_pct"))
        out = part if out is None else out.unionByName(part)
    return out


# --- scenarios -----------------------------------------------------------------


def shock(asset: Column, shocks: Column) -> Column:
    """The price shock of an asset under a map of scenario parameters."""
    low, up = F.lower(asset), F.upper(asset)

    def of(name):
        return F.try_element_at(shocks, F.lit(name))

    stocks = F.coalesce(of("stocks_return"), F.lit(0.0))
    return (
        F.when(F.contains(low, F.lit("gold")) | up.isin("GLD", "XAUUSD"), F.coalesce(of("gold_return"), F.lit(0.0)))
        .when(up.isin("SPY", "QQQ", "DIA"), stocks)
        .when(F.contains(low, F.lit("mining")) | up.isin("GDX", "GDXJ"), F.coalesce(of("mining_stocks"), stocks * 1.5))
        .otherwise(stocks * 0.8)
    )


def scenario_column(scenarios=SCENARIOS) -> Column:
    """The scenarios as one literal array; exploding it needs no join."""
    def shocks(d):
        return F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, float(v))])

    return F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(p).alias("probability"), shocks(d).alias("shocks"))
                     for n, p, d in scenarios])


def scenario_analysis(holdings: DataFrame, scenarios=SCENARIOS, by=("portfolio",)) -> DataFrame:
    """Portfolio value before and after every scenario, biggest loss share first.

    ``holdings`` has asset, quantity and price. Aggregates merge on the map side.
    """
    rows = holdings.withColumn("_s", F.explode(scenario_column(scenarios))).select(*holdings.columns, "_s.*")
    value = F.col("quantity") * F.coalesce("price", F.lit(0.0))
    out = rows.groupBy(*by, "scenario").agg(
        F.max("probability").alias("probability"), F.sum(value).alias("current_value"),
        F.sum(value * (1 + shock(F.col("asset"), F.col("shocks")))).alias("shocked_value"))
    loss = F.col("shocked_value") - F.col("current_value")
    return out.withColumns({
        "loss": loss,
        "loss_pct": F.when(F.col("current_value") > 0, S.ratio(loss, F.col("current_value"))).otherwise(0.0),
        "expected_loss": loss * F.col("probability")}).orderBy(*by, "loss_pct")


def worst_scenario(results: DataFrame, by=("portfolio",)) -> DataFrame:
    cols = F.struct(F.col("scenario").alias("worst_scenario"), F.col("loss").alias("expected_loss"),
                    F.col("loss_pct").alias("expected_loss_pct"), "probability",
                    F.col("expected_loss").alias("risk_weighted_loss"))
    return results.groupBy(*by).agg(F.min_by(cols, F.struct("loss_pct", "scenario")).alias("_w")).select(*by, "_w.*")
