"""Sentiment aggregates over scored articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import series as S
from tidemark.functions.stats import attach, tail


def _when(c, v) -> Column:
    return F.count_if(F.col(c) == v)


def daily_summary(news: DataFrame) -> DataFrame:
    """Per day and symbol: count, mean, deviation and label counts."""
    return (
        news.where(F.col("symbol").isNotNull())
        .groupBy(F.date_trunc("day", "time").alias("bucket"), "symbol")
        .agg(
            F.count(F.lit(1)).alias("news_count"), F.avg("score").alias("avg_sentiment"),
            F.stddev_samp("score").alias("sentiment_stddev"),
            _when("label", "positive").alias("positive_count"), _when("label", "negative").alias("negative_count"),
            _when("label", "neutral").alias("neutral_count"),
        )
    )


def daily_metrics(news: DataFrame, by=("symbol",), **layout) -> DataFrame:
    """Daily index, ratios, changes and heat per symbol.

    The bearish ratio subtracts a mean probability from a count ratio, as defined.
    """
    n = F.count("score").cast("double")
    daily = news.groupBy(*by, F.to_date("time").alias("date")).agg(
        F.avg("score").alias("avg_sentiment"), F.stddev_samp("score").alias("sentiment_std"),
        F.min("score").alias("min_sentiment"), F.max("score").alias("max_sentiment"),
        F.count("score").alias("news_volume"), F.avg("p_pos").alias("avg_positive"),
        F.avg("p_neg").alias("avg_negative"), F.avg("p_neu").alias("avg_neutral"),
        _when("label", "positive").alias("positive_count"),
        S.ratio(_when("label", "positive"), n).alias("bullish_ratio"),
    )
    s = S.open_series(daily, by, ("date",), back=5, **layout)
    out = s.add(
        sentiment_index=(F.col("avg_sentiment") + 1) * 50,
        bearish_ratio=1 - F.col("bullish_ratio") - F.col("avg_neutral"),
        sentiment_change_1d=F.col("avg_sentiment") - S.lag(s, "avg_sentiment"),
        sentiment_change_5d=F.col("avg_sentiment") - S.lag(s, "avg_sentiment", 5),
        _heat=F.col("news_volume") * (1 - F.col("avg_neutral")),
    ).close()
    ends = out.groupBy(*by).agg(F.min("_heat").alias("_lo"), F.max("_heat").alias("_hi"))
    heat = (F.col("_heat") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-6) * 100
    return attach(out, ends, by).withColumn("heat_index", heat).drop("_heat", "_lo", "_hi")


def summary(rows: DataFrame, by=("symbol",)) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(
        n.alias("count"), F.avg("score").alias("avg_score"), F.stddev_pop("score").alias("std_score"),
        F.min("score").alias("min_score"), F.max("score").alias("max_score"),
        *[_when("label", v).alias(f"{v}_count") for v in ("positive", "negative", "neutral")],
        S.ratio(_when("label", "positive"), n).alias("bullish_ratio"),
        S.ratio(_when("label", "negative"), n).alias("bearish_ratio"),
        F.avg("confidence").alias("avg_confidence"),
        ((F.avg("score") + 1) * 50).alias("sentiment_index"),
    )


# Interval name -> (truncation unit, step, days from the bucket's start to its label).
INTERVALS = {"1H": ("hour", "INTERVAL 1 HOUR", 0), "1D": ("day", "INTERVAL 1 DAY", 0),
             "1W": ("week", "INTERVAL 7 DAYS", 6)}


def by_interval(news: DataFrame, interval: str = "1D", by=("symbol",)) -> DataFrame:
    """Statistics per interval with a row for every empty interval in between.

    Weeks run Monday to Sunday and carry the Sunday's date.
    """
    unit, step, shift = INTERVALS[interval]
    got = news.groupBy(*by, F.date_trunc(unit, "time").alias("_b")).agg(
        F.avg("score").alias("score_mean"), F.stddev_samp("score").alias("score_std"),
        F.min("score").alias("score_min"), F.max("score").alias("score_max"),
        F.count("score").alias("score_count"), _when("label", "positive").alias("positive_count"),
    )
    ends = got.groupBy(*by).agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi"))
    calendar = ends.select(*by, F.explode(F.sequence("_lo", "_hi", F.expr(step))).alias("_b"))
    return (
        attach(calendar, got, [*by, "_b"])
        .fillna(0, ["score_count", "positive_count"])
        .withColumn("sentiment_index", (F.col("score_mean") + 1) * 50)
        .withColumn("interval_type", F.lit("daily" if interval == "1D" else "hourly"))
        .withColumn("time", F.col("_b") + F.expr(f"INTERVAL {shift} DAYS"))
        .drop("_b")
    )


def label_by_threshold(score: Column, t: float = 0.2) -> Column:
    return F.when(score > t, "positive").when(score < -t, "negative").otherwise("neutral")


def composite_index(avg: Column, bullish: Column, volume: Column, reference: float = 10) -> Column:
    """Index 0-100 from mean score, bullish share and volume confidence."""
    confidence = F.least(F.lit(1.5), F.greatest(F.lit(0.5), volume / F.lit(float(reference))))
    value = ((avg + 1) * 50 * 0.6 + bullish * 100 * 0.4) * confidence
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))


def dashboard(news: DataFrame, asof, by=("symbol",), order=("time",)) -> DataFrame:
    """State of each symbol from its last 24 hours, or its last 10 rows if none."""
    asof = F.lit(asof).cast("timestamp")

    def stats(df, p):
        n = F.count(F.lit(1))
        return df.groupBy(*by).agg(
            n.alias(f"{p}n"), F.avg("score").alias(f"{p}avg"),
            S.ratio(_when("label", "positive"), n).alias(f"{p}bull"),
            S.ratio(_when("label", "negative"), n).alias(f"{p}bear"))

    recent = stats(news.where(F.col(order[0]) >= asof - F.expr("INTERVAL 24 HOURS")), "r_")
    last = tail(news, 10, by, order)
    got = last.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
    placed = attach(last, got, by)
    trend = placed.groupBy(*by).agg(
        F.max("_m").alias("_m"),
        F.avg(F.when(F.col("back") <= 5, F.col("score"))).alias("_new"),
        F.avg(F.when((F.col("back") > F.col("_m") - 5) & (F.col("back") <= F.col("_m")), F.col("score"))).alias("_old"))
    out = attach(attach(trend, stats(last, "t_"), by), recent, by)

    def pick(c):
        return F.coalesce(f"r_{c}", f"t_{c}")

    return out.select(*by, *dashboard_columns(pick("n"), pick("avg"), pick("bull"), pick("bear"), F.col("_m"), F.col("_new"), F.col("_old")))


def dashboard_columns(n: Column, avg: Column, bullish: Column, bearish: Column, held: Column, newer: Column, older: Column) -> list[Column]:
    """The figures of a dashboard row. The trend compares the mean scores of the newest and the oldest five of the last ten
    rows; with fewer than five rows ``held`` it is stable."""
    change = newer - older
    trend = F.when(held < 5, "stable").when(change > 0.05, "improving").when(change < -0.05, "declining").otherwise("stable")
    return [avg.alias("current_sentiment"), label_by_threshold(avg).alias("sentiment_label"), trend.alias("trend"),
            n.alias("news_volume_24h"), bullish.alias("bullish_ratio"), bearish.alias("bearish_ratio"),
            composite_index(avg, bullish, n).alias("heat_index")]


STEP, SPAN = 300, 86_400  # seconds between two dashboards, and of the news that one of them shows
LAST = 10


def live_dashboards(news: DataFrame, every: int = STEP, span: int = SPAN, by=("symbol",), order=("time",), **layout) -> DataFrame:
    """The dashboard of each key at the end of every step, ``until``, from the news before it.

    A key is shown from its first news on at each step with news in the last ``span`` seconds, and at the first step
    without any: from there its last ten rows hold until the next news. Rows are added up per step; a step owns the ends
    up to the next step with news, so nothing is copied to the windows it falls into, and the sliding sums see two rows per
    step with news, however many news or ends a key has. Rows without a time are left out; null scores count in volumes only.
    """
    by, order = list(by), list(order)
    width = span // every
    news = news.where(F.col(order[0]).isNotNull())
    s = S.open_series(news, by, order, back=LAST, **layout)
    s = s.add(_last=F.collect_list(F.struct("score", "label")).over(s.rows(LAST)))
    step = F.floor(F.unix_micros(F.col(order[0]).cast("timestamp")) / (every * 1_000_000)).cast("long")
    steps = s.close().groupBy(*by, step.alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), F.count("score").alias("_s"), F.sum("score").alias("_x"),
        F.count_if(F.col("label") == "positive").alias("_p"), F.count_if(F.col("label") == "negative").alias("_q"),
        F.max_by("_last", F.struct(*order)).alias("_last"))
    def share(name):
        return F.size(F.filter("_last", lambda r: r["label"] == name))

    def mean(rows):
        return F.aggregate(rows, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("n")),
                           lambda a, r: F.struct((a["x"] + F.coalesce(r["score"], F.lit(0.0))).alias("x"),
                                                 (a["n"] + F.when(r["score"].isNull(), 0.0).otherwise(1.0)).alias("n")),
                           lambda a: S.ratio(a["x"], a["n"]))

    held = F.size("_last")
    later = F.lead("_b").over(Window.partitionBy(*by).orderBy("_b"))
    own = F.struct(F.least(F.coalesce(later, F.col("_b") + width + 1), F.col("_b") + width + 1).alias("to"), held.alias("held"), mean(F.col("_last")).alias("avg"),
                   share("positive").alias("p"), share("negative").alias("q"),
                   mean(F.slice("_last", F.greatest(held - 4, F.lit(1)), 5)).alias("newer"), mean(F.slice("_last", 1, 5)).alias("older"))
    sums = ("_n", "_s", "_x", "_p", "_q")
    steps = steps.select(*by, "_b", *sums, own.alias("_own"))
    # figures change where a step comes in and where it leaves the span; between two such ends they stand
    nothing = [F.lit(None).cast(steps.schema[c].dataType).alias(c) for c in (*sums, "_own")]
    points = steps.select(*by, (F.col("_b") + 1).alias("_u"), *sums, "_own").unionByName(steps.select(*by, (F.col("_b") + width + 1).alias("_u"), *nothing))
    points = points.groupBy(*by, "_u").agg(*[F.max(c).alias(c) for c in (*sums, "_own")])
    w = Window.partitionBy(*by).orderBy("_u")
    inside = w.rangeBetween(-(width - 1), 0)
    points = points.withColumns({f"{c}w": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums} | {
        "_own": F.last("_own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.lead("_u").over(w)})
    live = F.col("_nw") > 0

    def pick(wide, last):
        return F.when(live, F.col(wide)).otherwise(F.col(last))

    n = pick("_nw", "_own.held").cast("long")
    figures = points.select(
        *by, "_u", F.least(F.coalesce(F.col("_next") - 1, F.col("_own.to")), F.col("_own.to")).alias("_stop"),
        *dashboard_columns(n, F.when(live, S.ratio("_xw", "_sw")).otherwise(F.col("_own.avg")), S.ratio(pick("_pw", "_own.p"), n),
                           S.ratio(pick("_qw", "_own.q"), n), F.col("_own.held"), F.col("_own.newer"), F.col("_own.older")))
    # few keys lie in few tasks; the ends are made in as many as there are
    spread = figures.repartition(int(news.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "_u")
    ends = spread.withColumn("_u", F.explode(F.sequence("_u", "_stop"))).withColumn("until", F.timestamp_seconds(F.col("_u") * every))
    return ends.select(*by, "until", *[c for c in figures.columns if c not in (*by, "_u", "_stop")])


def score_dashboard(scores: DataFrame, symbols: DataFrame, asof, days: int = 30, by: str = "symbol") -> DataFrame:
    """Latest score against the mean of the newest seven; neutral for symbols without rows."""
    recent = scores.where(F.col("time") >= F.lit(asof).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
    seven = tail(recent, 7, (by,), ("time",))

    def now(c):
        return F.max(F.when(F.col("back") == 1, F.col(c)))

    got = seven.groupBy(by).agg(
        now("avg_sentiment").alias("_now"), F.avg("avg_sentiment").alias("_avg"),
        F.sum(F.coalesce("news_count", F.lit(0))).alias("_n"), now("positive_ratio").alias("positive_ratio"),
        now("negative_ratio").alias("negative_ratio"))
    out = attach(symbols.select(by).distinct(), got, [by])
    cur, avg = F.col("_now"), F.col("_avg")
    return out.select(
        by, F.coalesce(cur, F.lit(0.0)).alias("current_sentiment"), F.coalesce(avg, F.lit(0.0)).alias("avg_7d"),
        F.when(cur.isNull(), "neutral").when(cur > avg + 0.1, "improving").when(cur < avg - 0.1, "declining")
        .otherwise("stable").alias("trend"),
        F.coalesce("_n", F.lit(0)).alias("news_count"), "positive_ratio", "negative_ratio")


def sentiment_index(rows: DataFrame, score: str = "score", volume: str | None = None, by=("symbol",)) -> DataFrame:
    """Mean score on the 0-100 scale; with volumes the mean of plain and weighted mean."""
    plain = F.avg(score)
    if volume:
        weighted = S.ratio(F.sum(F.col(score) * F.col(volume)), F.sum(volume))
        plain = (plain + weighted) / 2
    return rows.groupBy(*by).agg(F.coalesce((plain + 1) * 50, F.lit(50.0)).alias("sentiment_index"))


def outer_align(sentiment: DataFrame, prices: DataFrame, keys=("symbol", "time")) -> DataFrame:
    return sentiment.join(prices, list(keys), "full_outer")
