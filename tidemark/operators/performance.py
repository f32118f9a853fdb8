"""Signal backtests, parameter sweeps and performance figures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import series as S
from tidemark.functions.stats import attach, numbered
from tidemark.operators.volatility import YEAR

EPS = 1e-10


def signal_backtest(df: DataFrame, signal: str = "direction", slippage: float = 0.001, commission: float = 0.001,
                    allow_short: bool = False, by=("symbol",), order=("time",), close: str = "close",
                    **layout) -> DataFrame:
    """Position from the last non-hold signal, next bar's return minus turnover cost, equity.

    ``signal`` is 1, -1, 0 or null; 0 and null keep the position. A bar's signal
    acts from the next bar on.
    """
    s = S.open_series(df, by, order, back=4, **layout)
    acted = F.when(F.col(signal) != 0, F.col(signal).cast("double"))
    s = S.reopen(S.running(s, _held=("last", acted)), back=4)
    target = F.coalesce("_held", F.lit(0.0))
    s = s.add(target=target if allow_short else F.greatest(target, F.lit(0.0)))
    s = s.add(position=F.coalesce(S.lag(s, "target"), F.lit(0.0)))
    s = s.add(turnover=F.abs(F.col("position") - F.coalesce(S.lag(s, "position"), F.lit(0.0))),
              bar_return=F.coalesce(S.change(s, close), F.lit(0.0)))
    cost = slippage + commission
    s = s.add(strategy_return=F.col("position") * F.col("bar_return") - F.col("turnover") * cost)
    s = S.compounded(s, "equity", F.col("strategy_return"), "_e")
    return s.close("_held", "_e_log", "_e_neg", "_e_zero", "target")


def performance_metrics(curve: DataFrame, trades: DataFrame | None = None, initial: float = 1.0,
                        risk_free: float = 0.02, by=("symbol",), order=("time",), equity: str = "equity",
                        **layout) -> DataFrame:
    """Return, risk and ratio figures per strategy; ``trades`` has pnl and holding_period."""
    s = S.open_series(curve, by, order, back=1, **layout)
    s = S.running(s.add(_r=S.change(s, equity)), _peak=("max", F.col(equity)))
    rows = s.add(_dd=S.ratio(F.col(equity) - F.col("_peak"), F.col("_peak"))).close()
    got = rows.groupBy(*by).agg(
        F.max_by(equity, order[0]).alias("_end"),
        F.datediff(F.max(order[0]), F.min(order[0])).alias("_days"),
        F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s"), F.min("_dd").alias("_dd"),
        F.stddev_samp(F.when(F.col("_r") < 0, F.col("_r"))).alias("_down"))
    got = got.withColumn("total_return", (F.col("_end") / initial - 1) * 100)
    got = got.withColumn("annual_return", (F.pow(
        1 + F.col("total_return") / 100, F.lit(365.0) / F.greatest("_days", F.lit(1))) - 1) * 100)
    got = got.withColumn("max_drawdown", F.abs("_dd") * 100).withColumns({
        "volatility": F.col("_s") * YEAR * 100,
        "sharpe_ratio": (F.col("_m") - risk_free / 252) * YEAR / (F.col("_s") + EPS),
        "calmar_ratio": F.col("annual_return") / (F.col("max_drawdown") + EPS),
        "sortino_ratio": (F.col("annual_return") / 100 - risk_free) / (F.col("_down") * YEAR + EPS)})
    names = ("win_rate", "profit_factor", "avg_trade_pnl", "avg_holding_period", "total_trades")
    if trades is None:
        got = got.withColumns({n: F.lit(0.0) for n in names})
    else:
        win, n = F.col("pnl") > 0, F.count(F.lit(1))
        stats = trades.groupBy(*by).agg(
            (S.ratio(F.count_if(win), n) * 100).alias("win_rate"),
            (F.coalesce(F.sum(F.when(win, F.col("pnl"))), F.lit(0.0))
             / (F.abs(F.coalesce(F.sum(F.when(~win, F.col("pnl"))), F.lit(0.0))) + EPS)).alias("profit_factor"),
            F.avg("pnl").alias("avg_trade_pnl"), F.avg("holding_period").alias("avg_holding_period"),
            n.cast("double").alias("total_trades"))
        got = attach(got, stats, by).fillna(0.0, list(names))
    return got.drop("_end", "_days", "_m", "_s", "_dd", "_down")


def paired_win_rate(trades: DataFrame, by=("symbol",), order=("time", "trade_id"), **layout) -> DataFrame:
    """Share of pairs, k-th buy with k-th sell, whose proceeds exceed the cost."""
    rows = numbered(trades.where(F.col("action").isin("BUY", "SELL")), [*by, "action"], order, "_k", **layout)
    pair = rows.groupBy(*by, "_k").agg(
        F.max(F.when(F.col("action") == "BUY", F.col("amount"))).alias("_cost"),
        F.max(F.when(F.col("action") == "SELL", F.col("amount"))).alias("_got"))
    full = pair.where(F.col("_cost").isNotNull() & F.col("_got").isNotNull())
    return full.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_trades"),
        S.ratio(F.count_if(F.col("_got") > F.col("_cost")), F.count(F.lit(1))).alias("win_rate"))


def simple_report(curve: DataFrame, trades: DataFrame, initial: float = 1.0, by=("symbol",), order=("time",),
                  equity: str = "equity", **layout) -> DataFrame:
    s = S.open_series(curve, by, order, back=1, **layout)
    s = S.running(s.add(_r=S.change(s, equity)), _peak=("max", F.col(equity)))
    rows = s.add(_dd=S.ratio(F.col(equity) - F.col("_peak"), F.col("_peak"))).close()
    n = F.count(F.lit(1))
    got = rows.groupBy(*by).agg(
        F.max_by(equity, order[0]).alias("final_equity"), n.alias("_n"), F.avg("_r").alias("_m"),
        F.stddev_samp("_r").alias("_s"), F.min("_dd").alias("max_drawdown"))
    got = got.withColumn("total_return", F.col("final_equity") / initial - 1)
    got = got.withColumn("annual_return", F.pow(1 + F.col("total_return"), F.lit(252.0) / F.col("_n")) - 1)
    got = got.withColumn("sharpe_ratio", F.when(F.col("_s") > 0, S.ratio("_m", "_s") * math.sqrt(252)).otherwise(0.0))
    out = attach(got, paired_win_rate(trades, by), by).fillna(0, ["total_trades", "win_rate"])
    return out.drop("_n", "_m", "_s")


def formatted_report(metrics: DataFrame, curve: DataFrame, by=("symbol",), order=("time",), equity: str = "equity"):
    """The figures as text next to start, end, peak and trough of the curve."""
    ends = curve.groupBy(*by).agg(
        F.min_by(equity, order[0]).alias("start_equity"), F.max_by(equity, order[0]).alias("end_equity"),
        F.max(equity).alias("peak"), F.min(equity).alias("trough"))
    styles = {"total_return": "%.2f%%", "annual_return": "%.2f%%", "sharpe_ratio": "%.2f", "max_drawdown": "%.2f%%",
              "win_rate": "%.1f%%", "volatility": "%.2f%%", "calmar_ratio": "%.2f", "sortino_ratio": "%.2f",
              "profit_factor": "%.2f", "avg_trade_pnl": "$%.2f", "avg_holding_period": "%.1f days"}
    texts = [F.format_string(v, F.col(k)).alias(f"{k}_text") for k, v in styles.items()]
    return attach(metrics.select(*by, *texts), ends, by)


def ma_sweep(df: DataFrame, fasts=(5, 10, 15, 20), slows=(20, 30, 40, 50, 60), by=("symbol",), order=("time",),
             max_rows: int | None = None, block_rows: int | None = None, **kw) -> DataFrame:
    """Backtest of every fast < slow pair of means; one row per key and pair.

    Each mean is computed once per bar; the pairs are exploded afterwards, so the
    sweep multiplies narrow rows and not the windows over them.
    """
    s = S.open_series(df, by, order, back=max(slows), max_rows=max_rows, block_rows=block_rows)
    s = s.add(**{f"_ma{n}": S.mean(s, "close", n) for n in sorted({*fasts, *slows})})
    pairs = F.array(*[
        F.struct(F.lit(a).alias("fast"), F.lit(b).alias("slow"),
                 F.signum(F.col(f"_ma{a}") - F.col(f"_ma{b}")).alias("direction"))
        for a in fasts for b in slows if a < b])
    rows = s.close().select(*by, *order, "close", F.explode(pairs).alias("_p")).select(*by, *order, "close", "_p.*")
    keys = [*by, "fast", "slow"]
    curve = signal_backtest(rows, by=keys, order=order, max_rows=max_rows, block_rows=block_rows, **kw)
    m = performance_metrics(curve, by=keys, order=order, max_rows=max_rows, block_rows=block_rows)
    trades = curve.groupBy(*keys).agg(F.sum(F.when(F.col("turnover") > 0, 1).otherwise(0)).alias("trades"))
    return attach(m.select(*keys, "sharpe_ratio", "total_return", "max_drawdown"), trades, keys)


def best_and_worst(results: DataFrame, metric: str = "sharpe_ratio", params=("fast", "slow"), by=("symbol",)):
    """Parameters of the highest and lowest metric; the first pair on ties."""
    p = F.struct(*params)
    best = F.min_by(p, F.struct(-F.col(metric), *params))
    worst = F.min_by(p, F.struct(F.col(metric), *params))
    got = results.where(F.col(metric).isNotNull()).groupBy(*by).agg(
        best.alias("_b"), worst.alias("_w"), F.max(metric).alias("best_metric"), F.min(metric).alias("worst_metric"),
        F.count(F.lit(1)).alias("n_combinations"))
    return got.select(*by, *[F.col(f"_b.{c}").alias(f"best_{c}") for c in params],
                      *[F.col(f"_w.{c}").alias(f"worst_{c}") for c in params], "best_metric", "worst_metric",
                      "n_combinations")


def pivot_grid(results: DataFrame, rows: str, cols: str, values, metric: str) -> DataFrame:
    return results.groupBy(rows).pivot(cols, list(values)).agg(F.avg(metric))


def walk_forward_splits(df: DataFrame, n_splits: int = 5, test: int = 20, gap: int = 0, method: str = "expanding",
                        by=("symbol",), order=("time",), **layout) -> DataFrame:
    """Rows with their fold and role; row ranges are counted back from the end of each key."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = attach(numbered(df, by, order, "row", **layout), sizes, by)
    n, at = F.col("_n"), F.col("row") - 1
    floor = n - n_splits * (test + gap)
    folds = []
    for i in range(n_splits):
        stop = n - i * (test + gap)
        start = stop - test
        train_end = start - gap
        train_start = F.lit(0).cast("long") if method == "expanding" else F.greatest(F.lit(0).cast("long"), start - floor)
        ok = train_end > train_start
        role = F.when(ok & (at >= train_start) & (at < train_end), "train").when(ok & (at >= start) & (at < stop), "test")
        folds.append(F.struct(F.lit(n_splits - 1 - i).alias("fold"), role.alias("role")))
    out = rows.withColumn("_f", F.explode(F.array(*folds))).select(*rows.columns, "_f.*")
    return out.where(F.col("role").isNotNull()).drop("_n")


def chrono_split(df: DataFrame, test_share: float = 0.2, by=("symbol",), order=("time",), **layout) -> DataFrame:
    """The last share of every key is the test set; nothing is shuffled."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = attach(numbered(df, by, order, "row", **layout), sizes, by)
    cut = F.col("_n") - F.ceil(F.col("_n") * test_share)
    return rows.withColumn("is_test", F.col("row") > cut).drop("_n")


def ensemble_combine(df: DataFrame, predictions: dict[str, str], losses: dict[str, float]) -> DataFrame:
    """Predictions weighted by inverse validation loss; confidence from their spread."""
    inv = {k: 1 / (v + 1e-6) for k, v in losses.items()}
    total = sum(inv.values())
    cols = {k: F.col(c) for k, c in predictions.items()}
    combined = sum((c * (inv[k] / total) for k, c in cols.items()), F.lit(0.0))
    mean = sum(cols.values(), F.lit(0.0)) / len(cols)
    spread = F.sqrt(sum(((c - mean) * (c - mean) for c in cols.values()), F.lit(0.0)) / len(cols))
    return df.withColumn("prediction", combined).withColumn("confidence", F.greatest(F.lit(0.0), 1 - spread * 10))


def forecast_direction(df: DataFrame, ret: str = "predicted_return", spread: str = "uncertainty", price: str = "price"):
    r = F.col(ret)
    return df.withColumns({
        "direction": F.when(r > 0.005, "up").when(r < -0.005, "down").otherwise("neutral"),
        "predicted_price": F.col(price) * (1 + r),
        "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col(spread) * 10))})
