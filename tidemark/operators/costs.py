"""Cost accounting of model calls and API budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import series as S
from tidemark.functions.stats import attach

# Price per million input and output tokens; cost per API call.
PRICES = [("gpt-4o", 2.50, 10.00), ("gpt-4o-mini", 0.15, 0.60), ("gpt-4-turbo", 10.00, 30.00),
          ("gpt-3.5-turbo", 0.50, 1.50)]
COST_PER_CALL = {"deepseek": 0.002, "news_api": 0.001, "openai": 0.003, "default": 0.001}


def price_table(spark) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, input_price double, output_price double")


def with_cost(calls: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Token counts times the model's price per million; unknown models cost 0.

    The default price table is a literal of four rows, hence its broadcast; a table of the caller is joined as Spark sees fit.
    """
    prices = F.broadcast(price_table(calls.sparkSession)) if prices is None else prices
    cost = (F.col("input_tokens") / F.lit(1e6)) * F.col("input_price") + (
        F.col("output_tokens") / F.lit(1e6)) * F.col("output_price")
    return calls.join(prices, "model", "left").withColumn("cost", F.coalesce(cost, F.lit(0.0))).drop(
        "input_price", "output_price")


def _since(df: DataFrame, asof, days: int) -> DataFrame:
    return df.where(F.col("time") >= F.lit(asof).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def _paid(df: DataFrame) -> DataFrame:
    return df.where(~F.col("cached"))


def period_cost(calls: DataFrame, unit: str, at) -> DataFrame:
    """Cost of the paid calls in the day or month of ``at``; one row, 0 when none."""
    start = F.date_trunc(unit, F.lit(at).cast("timestamp"))
    stop = start + F.expr(f"INTERVAL 1 {unit.upper()}")
    picked = _paid(calls).where((F.col("time") >= start) & (F.col("time") < stop))
    return picked.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))


def daily_cost(calls, day):
    return period_cost(calls, "day", day)


def monthly_cost(calls, month):
    return period_cost(calls, "month", month)


def cost_by(calls: DataFrame, key: str, asof, days: int = 30) -> DataFrame:
    got = _paid(_since(calls, asof, days)).groupBy(key).agg(F.sum("cost").alias("total_cost"))
    return got.orderBy(F.col("total_cost").desc())


def usage_stats(calls: DataFrame, asof, days: int = 7) -> DataFrame:
    n, hit = F.count(F.lit(1)), F.count_if(F.col("cached"))
    return _since(calls, asof, days).agg(
        n.alias("total_calls"), hit.alias("cached_calls"),
        F.coalesce(S.ratio(hit, n), F.lit(0.0)).alias("cache_hit_rate"),
        F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.avg("latency_s"), F.lit(0.0)).alias("avg_latency"))


def cost_trend(calls: DataFrame, asof, days: int = 30) -> DataFrame:
    return (
        _paid(_since(calls, asof, days)).groupBy(F.to_date("time").alias("date"))
        .agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
             F.sum("cost").alias("cost"))
        .orderBy("date")
    )


def cost_report(calls: DataFrame, asof, days: int = 30) -> DataFrame:
    """Cost and percent of the total per provider and task, and daily mean/max/min."""
    total = _since(calls, asof, days).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("_all"))

    def part(key):
        return cost_by(calls, key, asof, days).select(
            F.lit(key).alias("section"), F.col(key).alias("name"), F.col("total_cost").alias("cost"))

    day = cost_trend(calls, asof, days).agg(
        F.avg("cost").alias("mean"), F.max("cost").alias("max"), F.min("cost").alias("min"))
    trend = day.unpivot([], ["mean", "max", "min"], "name", "cost").select(
        F.lit("daily").alias("section"), "name", "cost")
    rows = part("provider").unionByName(part("task_type")).unionByName(trend)
    share = F.when(F.col("section") != "daily", F.coalesce(S.ratio(F.col("cost") * 100, total.scalar()), F.lit(0.0)))
    return rows.withColumn("share_pct", share)


def budget_alerts(calls: DataFrame, at, daily_limit: float = 10.0, monthly_limit: float = 200.0) -> DataFrame:
    day = daily_cost(calls, at).select(F.lit("daily").alias("period"), "cost", F.lit(daily_limit).alias("budget"))
    month = monthly_cost(calls, at).select(F.lit("monthly").alias("period"), "cost", F.lit(monthly_limit).alias("budget"))
    return day.unionByName(month).withColumn("over_budget", F.col("cost") > F.col("budget"))


def provider_usage(calls: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return calls.groupBy("provider").agg(
        n.alias("requests"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
        F.sum("cost").alias("cost"), S.ratio(F.count_if(F.col("cached")), n).alias("cache_hit_rate"),
        S.ratio(F.sum("cost"), n).alias("avg_cost_per_request"))


def top_expensive(calls: DataFrame, asof, n: int = 10, days: int = 7, ties=("conv_id", "turn")) -> DataFrame:
    return _paid(_since(calls, asof, days)).orderBy(F.col("cost").desc(), *ties).limit(n)


def unit_cost(api):
    costs = F.create_map(*[F.lit(x) for k, v in COST_PER_CALL.items() if k != "default" for x in (k, v)])
    return F.coalesce(F.try_element_at(costs, api), F.lit(COST_PER_CALL["default"]))


def api_budget(usage: DataFrame, daily_budget: float = 10.0, alert_at: float = 0.8) -> DataFrame:
    """Per day and API: calls and cost, with the day's spend against the budget.

    ``usage`` has time, api and optionally calls and actual_cost.
    """
    calls = F.coalesce("calls", F.lit(1)) if "calls" in usage.columns else F.lit(1)
    known = F.col("actual_cost") if "actual_cost" in usage.columns else F.lit(None).cast("double")
    cost = F.when(known != 0, known).otherwise(unit_cost(F.col("api")) * calls)
    per_api = usage.groupBy(F.to_date("time").alias("date"), "api").agg(F.sum(calls).alias("calls"), F.sum(cost).alias("cost"))
    per_day = per_api.groupBy("date").agg(F.sum("cost").alias("total_spent"))
    out = attach(per_api, per_day, ["date"])
    spent = F.col("total_spent")
    return out.withColumns({
        "remaining": F.round(F.lit(daily_budget) - spent, 4), "usage_pct": F.round(spent / daily_budget * 100, 1),
        "alert": spent > daily_budget * alert_at, "exceeded": spent > daily_budget})


def budget_running(usage: DataFrame, daily_budget: float = 10.0, order=("time", "event_id"), **layout) -> DataFrame:
    """Spend of the day before each call and whether the call still fits."""
    df = usage.withColumn("date", F.to_date("time")).withColumn("_x_cost", unit_cost(F.col("api")))
    s = S.running(S.open_series(df, ("date",), order, **layout), _x_upto=("sum", F.col("_x_cost")))
    out = s.close().withColumn("spent_before", F.col("_x_upto") - F.col("_x_cost"))
    return out.withColumn("within_budget", F.col("_x_upto") <= daily_budget).drop("_x_cost", "_x_upto")
