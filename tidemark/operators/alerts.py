"""Flow alerts per symbol and rule alerts on quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import series as S
from tidemark.functions.stats import tail
from tidemark.operators.pairs import vector_pairs
from tidemark.session import cut_lineage

ALERT = ["alert_type", "severity", "symbol", "title", "description", "value", "threshold"]


def _alert(when: Column, kind, severity, title: Column, text: Column, value: Column, threshold: Column, symbol: Column | str = "symbol") -> Column:
    """The alert as a struct, null where ``when`` does not hold."""
    fields = [kind, severity, F.col(symbol) if isinstance(symbol, str) else symbol, title, text, value.cast("double"), threshold.cast("double")]
    return F.when(when, F.struct(*[(f if isinstance(f, Column) else F.lit(f)).alias(n) for n, f in zip(ALERT, fields)]))


def _raise(per: DataFrame, *alerts: Column) -> DataFrame:
    return per.select(F.inline(F.array_compact(F.array(*alerts))))


def _scored(p: str, col: str, n: int) -> list[Column]:
    """Row count, last value, mean and deviation of the newest n rows; ``back`` numbers rows from the newest."""
    x = F.when(F.col("back") <= n, F.col(col))
    return [F.count_if(F.col("back") <= n).alias(f"{p}n"), F.avg(x).alias(f"{p}m"), F.stddev_samp(x).alias(f"{p}s"),
            F.max(F.when(F.col("back") == 1, F.col(col))).alias(f"{p}v")]


def _zscore(p: str, n: int) -> Column:
    """How far the last value is from the mean; null without n rows that differ."""
    return F.when((F.col(f"{p}n") >= n) & (F.col(f"{p}s") > 0), S.ratio(F.col(f"{p}v") - F.col(f"{p}m"), F.col(f"{p}s")))


def _large(p: str, z: float, n: int) -> Column:
    v, score = F.col(f"{p}v"), _zscore(p, n)
    inflow, size = v > 0, F.abs(score)
    word = F.when(inflow, "Inflow").otherwise("Outflow")
    return _alert(
        size > z, F.when(inflow, "large_inflow").otherwise("large_outflow"),
        F.when(size > 4, "critical").when(size > 3, "high").otherwise("medium"),
        F.concat(F.lit("Large "), word, F.lit(" Detected - "), "symbol"),
        F.format_string("%s experienced a %.1fσ %s of $%.1fM", F.col("symbol"), size, F.lower(word), F.abs(v) / 1e6),
        v, F.col(f"{p}m") + z * F.col(f"{p}s"))


def large_flows(df: DataFrame, z: float = 2.0, n: int = 60, col: str = "net_flow") -> DataFrame:
    return _raise(tail(df, n).groupBy("symbol").agg(*_scored("_f", col, n)), _large("_f", z, n))


def _unusual(p: str, z: float, n: int) -> Column:
    v, score = F.col(f"{p}v"), _zscore(p, n)
    return _alert(
        score > z, "unusual_volume", F.when(score > 3.5, "high").otherwise("medium"),
        F.concat(F.lit("Unusual Volume - "), "symbol"),
        F.format_string("%s trading volume is %.1fx normal (%.1fM shares)", F.col("symbol"), score, v / 1e6),
        v, F.col(f"{p}m") + z * F.col(f"{p}s"))


def volume_anomalies(df: DataFrame, z: float = 2.5, n: int = 20, col: str = "volume") -> DataFrame:
    return _raise(tail(df, n).groupBy("symbol").agg(*_scored("_u", col, n)), _unusual("_u", z, n))


def _sides(n: int, col: str) -> list[Column]:
    back, x = F.col("back"), F.col(col)
    return [F.count_if(back <= 2 * n).alias("_rn"), F.sum(F.when(back <= n, x)).alias("_rnew"),
            F.coalesce(F.sum(F.when((back > n) & (back <= 2 * n), x)), F.lit(0.0)).alias("_rold")]


def _reversal(n: int, share: float, floor: float) -> Column:
    new, old = F.col("_rnew"), F.col("_rold")
    down, up = (old > 0) & (new < -old * share), (old < 0) & (new > F.abs(old) * share)
    text = F.when(down, F.format_string("%s reversed from $%.1fM inflows to $%.1fM outflows", F.col("symbol"), old / 1e6, new / 1e6)).otherwise(
        F.format_string("%s reversed from $%.1fM outflows to $%.1fM inflows", F.col("symbol"), F.abs(old) / 1e6, new / 1e6))
    return _alert((F.col("_rn") >= n + 1) & (F.abs(old) >= floor) & (down | up), "flow_reversal", "high",
                  F.concat(F.lit("Flow Reversal - "), "symbol"), text, new, old)


def flow_reversals(df: DataFrame, n: int = 5, share: float = 0.5, floor: float = 1e6, col: str = "net_flow"):
    """Sum of the last n rows against the n rows before them, opposite in sign."""
    return _raise(tail(df, 2 * n).groupBy("symbol").agg(*_sides(n, col)), _reversal(n, share, floor))


def _recent(df: DataFrame, n: int, days: int, col: str, time: str, *more: Column) -> DataFrame:
    """One row per symbol from one scan: ``_days``, the flows of its newest ``days`` dates, and aggregates ``more`` of its
    newest n rows. Only rows of a symbol's newest ``max(n, days)`` dates are sent, which hold both."""
    w = Window.partitionBy("symbol").orderBy(F.col(time).desc())
    near = df.withColumn("_date", F.dense_rank().over(w)).where(F.col("_date") <= max(n, days))
    day = F.sum(col).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    near = near.withColumns({"back": F.row_number().over(w), "_day": day})
    return near.groupBy("symbol").agg(
        F.collect_set(F.when(F.col("_date") <= days, F.struct(F.col(time).alias("time"), F.col("_day").alias("flow")))).alias("_days"), *more)


def _correlated(recent: DataFrame, n: int, limit: float, floor: float) -> DataFrame:
    """Pairs of symbols from rows of ``_recent``. The newest n dates of all are among the newest n of each symbol; symbols
    below the floor are gone before pairs are made."""
    flows = recent.select("symbol", F.inline("_days"))
    last = flows.select("time").distinct().orderBy(F.col("time").desc()).limit(n)
    last = last.withColumn("_k", F.row_number().over(Window.orderBy(F.col("time").desc())))
    placed = flows.join(F.broadcast(last), "time")  # n rows
    vectors = placed.groupBy("symbol").agg(
        F.array(*[F.max(F.when(F.col("_k") == k, F.col("flow"))) for k in range(1, n + 1)]).alias("_v"),
        F.sum(F.when(F.col("_k") <= 5, F.col("flow"))).alias("_f"))
    got = vector_pairs(vectors.where(F.abs("_f") > floor).select("symbol", "_v"), limit)
    c = F.col("correlation")
    way = F.when(c > 0, "same direction").otherwise("opposite direction")
    return _raise(got, _alert(
        F.lit(True), "correlated_flow", "medium", F.concat(F.lit("Correlated Flows - "), "a", F.lit(" & "), "b"),
        F.format_string("%s and %s showing %.0f%% correlation (%s)", F.col("a"), F.col("b"), c * 100, way),
        c, F.lit(limit), F.concat("a", F.lit("/"), "b")))


def correlated_flows(df: DataFrame, n: int = 20, limit: float = 0.8, floor: float = 10e6, col: str = "net_flow",
                     time: str = "time") -> DataFrame:
    """Pairs of symbols whose flows of the newest n dates move together."""
    return _correlated(cut_lineage(_recent(df, n, n, col, time)), n, limit, floor)


def run_all(flows: DataFrame, prices: DataFrame | None = None, **kw) -> DataFrame:
    """All detections in one alert table, from one scan of the flows: one row per symbol is kept, and every detection
    reads it. Prices that are the flows themselves cost no second scan."""
    shared = prices is flows
    more = [*_scored("_f", "net_flow", 60), *_sides(5, "net_flow"), *(_scored("_u", "volume", 20) if shared else [])]
    recent = cut_lineage(_recent(flows, 60, 20, "net_flow", "time", *more))
    found = [_large("_f", 2.0, 60), _reversal(5, 0.5, kw.get("reversal_floor", 1e6)), *([_unusual("_u", 2.5, 20)] if shared else [])]
    out = _raise(recent, *found).unionByName(_correlated(recent, 20, 0.8, kw.get("pair_floor", 10e6)))
    return out if shared or prices is None else out.unionByName(volume_anomalies(prices))


# --- alert table ------------------------------------------------------------------


def unread(alerts: DataFrame, severity: str | None = None) -> DataFrame:
    out = alerts.where(~F.col("is_read"))
    if severity is not None:
        out = out.where(F.col("severity") == severity)
    return out.orderBy(F.col("time").desc())


def history(alerts: DataFrame, asof, hours: int = 24, symbol: str | None = None) -> DataFrame:
    out = alerts.where(F.col("time") >= F.lit(asof).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"))
    return out if symbol is None else out.where(F.col("symbol") == symbol)


def active(alerts: DataFrame, asof) -> DataFrame:
    return history(alerts, asof, 1)


def mark_read(alerts: DataFrame, ids: DataFrame, key: str = "alert_id") -> DataFrame:
    """Alerts with ``is_read`` set for the given ids."""
    done = ids.select(key).distinct().withColumn("_done", F.lit(True))
    return alerts.join(done, key, "left").withColumn(
        "is_read", F.col("is_read") | F.coalesce("_done", F.lit(False))).drop("_done")


# --- rules on quotes ----------------------------------------------------------------

RULE_SCHEMA = ("rule_id string, type string, symbol string, enabled boolean, breakout_price double, "
               "direction string, threshold_percent double, min_correlation double, divergence_threshold double, "
               "oversold_threshold double, overbought_threshold double")
# Rule type names and their cooldowns in minutes.
BREAKOUT, PERCENT, DIVERGENCE, RSI = ("PriceBreakoutRule", "PercentChangeRule", "CorrelationDivergenceRule", "RSIAlertRule")
COOLDOWN_MINUTES = {BREAKOUT: 60, PERCENT: 60, DIVERGENCE: 180, RSI: 60}


def _or(name: str, default) -> Column:
    return F.coalesce(name, F.lit(default))


def breakout_hit() -> Column:
    up = _or("direction", "above")
    return ((up == "above") & (F.col("price") >= F.col("breakout_price"))) | (
        (up == "below") & (F.col("price") <= F.col("breakout_price")))


def percent_hit() -> Column:
    x, limit, way = F.col("change_percent"), F.abs("threshold_percent"), _or("direction", "both")
    return ((way == "up") & (x >= limit)) | ((way == "down") & (x <= -limit)) | ((way == "both") & (F.abs(x) >= limit))


def divergence_hit() -> Column:
    a, b = _or("change_percent", 0.0), _or("gold_change_percent", 0.0)
    return ((F.col("gold_correlation") >= _or("min_correlation", 0.7))
            & (F.abs(a - b) >= _or("divergence_threshold", 5.0)) & (F.signum(a) * F.signum(b) < 0))


def rsi_state() -> Column:
    return F.when(F.col("rsi") <= _or("oversold_threshold", 30.0), "RSI_OVERSOLD").when(
        F.col("rsi") >= _or("overbought_threshold", 70.0), "RSI_OVERBOUGHT")


def rules_on_quotes(rules: DataFrame, quotes: DataFrame, gold: str = "GLD", correlation: DataFrame | None = None):
    """Enabled rules joined to the quotes of their symbol, with the reference
    symbol's change and the correlation attached."""
    change = quotes.where(F.col("symbol") == gold).agg(F.max("change_percent").alias("g"))
    out = rules.where("enabled").join(quotes, "symbol")
    out = out.withColumn("gold_change_percent", change.scalar())
    if correlation is None:
        return out if "gold_correlation" in out.columns else out.withColumn("gold_correlation", F.lit(None).cast("double"))
    return out.join(correlation.select("symbol", F.col("correlation").alias("gold_correlation")), "symbol", "left")


def check_rules(joined: DataFrame) -> DataFrame:
    """Rows whose rule fires, with alert type, severity and message."""
    kind, x = F.col("type"), F.col("change_percent")
    fired = (
        F.when((kind == BREAKOUT) & breakout_hit(), "PRICE_BREAKOUT")
        .when((kind == PERCENT) & percent_hit(), "PERCENT_CHANGE")
        .when((kind == DIVERGENCE) & divergence_hit(), "CORRELATION_DIVERGENCE")
        .when(kind == RSI, rsi_state())
    )
    high = (kind == PERCENT) & (F.abs(x) >= F.abs("threshold_percent") * 1.5)
    message = (
        F.when(kind == BREAKOUT, F.format_string("%s price %s $%.2f", F.col("symbol"), F.when(
            _or("direction", "above") == "above", "above").otherwise("below"), F.col("breakout_price")))
        .when(kind == PERCENT, F.format_string("%s %s %.2f%%", F.col("symbol"), F.when(x > 0, "up").otherwise("down"), F.abs(x)))
        .when(kind == DIVERGENCE, F.concat("symbol", F.lit(" diverges from gold")))
        .otherwise(F.format_string("%s RSI=%.1f", F.col("symbol"), F.col("rsi")))
    )
    return joined.withColumn("alert_type", fired).where(F.col("alert_type").isNotNull()).withColumn(
        "severity", F.when(high, "HIGH").otherwise("MEDIUM")).withColumn("message", message)
