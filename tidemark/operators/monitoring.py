"""Summaries over request, error, prediction and health tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import series as S
from tidemark.functions.stats import attach, quantiles

# Histogram edges in seconds.
EDGES = {
    "fetch": [0.1, 0.5, 1, 2, 5, 10, 30],
    "prediction": [0.01, 0.05, 0.1, 0.25, 0.5, 1],
    "api": [0.01, 0.05, 0.1, 0.25, 0.5, 1, 2.5],
    "db": [0.001, 0.01, 0.05, 0.1, 0.5, 1],
}


def error_stats(errors: DataFrame, keep: int = 1000, top: int = 10, kind: str = "type",
                order=("time", "event_id")) -> DataFrame:
    """Most frequent types among the newest ``keep`` errors."""
    newest = errors.orderBy(*[F.col(c).desc() for c in order]).limit(keep)
    counts = newest.groupBy(kind).count()
    total = newest.agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("count").desc(), kind).limit(top).withColumn("total", total.scalar())


def latency_histogram(df: DataFrame, edges, value: str = "latency_s", by=("endpoint",)) -> DataFrame:
    """Cumulative counts per edge: one pass, one row per key, then one row per edge."""
    wide = df.groupBy(*by).agg(F.array(*[F.count_if(F.col(value) <= float(e)) for e in edges]).alias("_c"),
                               F.count(value).alias("total"))
    pairs = F.arrays_zip(F.array(*[F.lit(float(e)) for e in edges]).alias("le"), F.col("_c").alias("cumulative"))
    return wide.select(*by, "total", F.explode(pairs).alias("_p")).select(*by, "total", "_p.*")


def histogram_quantile(hist: DataFrame, q: float, by=("endpoint",)) -> DataFrame:
    """Quantile from cumulative buckets by linear interpolation inside the bucket."""
    w = Window.partitionBy(*by).orderBy("le")
    rows = hist.withColumns({"_low": F.coalesce(F.lag("le").over(w), F.lit(0.0)),
                             "_before": F.coalesce(F.lag("cumulative").over(w), F.lit(0))})
    want = F.col("total") * q
    value = F.col("_low") + (F.col("le") - F.col("_low")) * S.ratio(
        want - F.col("_before"), F.col("cumulative") - F.col("_before"))
    hit = (F.col("cumulative") >= want) & (F.col("_before") < want)
    top = F.max("le")
    return rows.groupBy(*by).agg(F.coalesce(F.max(F.when(hit, value)), top).alias("quantile"))


def latency_quantiles(df: DataFrame, width: str = "5 minutes", seconds: float = 300.0, value: str = "latency_s",
                      by=("endpoint",), **layout) -> DataFrame:
    """Exact p50 and p95 and the request rate per window and key."""
    rows = df.withColumn("bucket", F.window("time", width)["start"])
    keys = [*by, "bucket"]
    rate = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"))
    q = quantiles(rows, value, {"p50": 0.5, "p95": 0.95}, keys, **layout)
    return attach(rate, q, keys).withColumn("rate", F.col("requests") / F.lit(seconds))


def slow_queries(df: DataFrame, over: float = 1.0, n: int = 10, value: str = "latency_s",
                 order=("time", "event_id")) -> DataFrame:
    return df.where(F.col(value) > over).orderBy(*[F.col(c).desc() for c in order]).limit(n)


def prediction_errors(df: DataFrame, by=("model", "symbol"), limit: float = 0.05) -> DataFrame:
    e = F.abs(F.col("actual") - F.col("predicted"))
    return df.where(F.col("actual").isNotNull()).groupBy(*by).agg(
        F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(e).alias("max_error"),
        F.count(F.lit(1)).alias("prediction_count"), F.count_if(e > limit).alias("high_errors"))


# Metric -> (threshold, status above it).
HEALTH = {"cpu": (80.0, "critical"), "memory": (80.0, "critical"), "disk": (90.0, "warning")}


def rolling_health(df: DataFrame, n: int = 100, by=("metric",), order=("time", "event_id"), **layout) -> DataFrame:
    """Mean of the newest n samples at every row and the state of the current one."""
    s = S.open_series(df, by, order, back=n, **layout)
    out = s.add(average=F.avg("value").over(s.rows(n))).close()
    status = F.lit("ok")
    for m, (limit, name) in HEALTH.items():
        above = F.col("value") > limit if name == "critical" else F.col("value") >= limit
        status = F.when((F.col("metric") == m) & above, name).otherwise(status)
    return out.withColumn("status", status)


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).count()


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).count()


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall and F1 per class and the overall accuracy."""
    cells = confusion(df, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0)
    per = (
        cells.select(F.explode(F.array(
            F.struct(F.col("label").alias("class"), F.col("count").alias("support"), F.lit(0).cast("long").alias("called"), hit.alias("hits")),
            F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"), F.col("count").alias("called"), F.lit(0).cast("long").alias("hits")),
        )).alias("_r")).select("_r.*")
        .groupBy("class").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hits").alias("hits"))
    )
    right = cells.agg(S.ratio(F.sum(hit), F.sum("count")).alias("a"))
    p = F.coalesce(S.ratio("hits", "called"), F.lit(0.0))
    r = F.coalesce(S.ratio("hits", "support"), F.lit(0.0))
    return per.select("class", "support", p.alias("precision"), r.alias("recall"),
                      F.coalesce(S.ratio(2 * p * r, p + r), F.lit(0.0)).alias("f1")).withColumn("accuracy", right.scalar())
