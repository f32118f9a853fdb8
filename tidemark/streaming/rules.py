"""The stateful rules and their declarative twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import series as S
from tidemark.operators.base import series_operator
from tidemark.series import Series, join_null_safe
from tidemark.session import cut_lineage
from tidemark.streaming.stateful import Rule


def price_features(n: int = 20) -> Rule:
    """Return, short mean, deviation, momentum and, with n prices, the long mean and side."""

    def step(buffer, price):
        buffer = (buffer + [float(price)])[-n:]
        if len(buffer) < 2:
            return buffer, None
        p = np.array(buffer)
        short = float(p[-5:].mean())
        wide = len(p) >= 5
        flat = p.min() == p.max()  # means of equal prices differ by their rounding only
        full = float(p.mean()) if len(p) >= n else None
        side = None if full is None else ("bullish" if short > full and not flat else "bearish")
        return buffer, ((p[-1] / p[-2] - 1) * 100, short, float(p.std()) if wide and not flat else 0.0,
                        float(p[-1] - p[0]) if wide else 0.0, full, side)

    return Rule(list, step, ("price",), (
        ("returns", "double"), ("ma_short", "double"), ("volatility", "double"), ("momentum", "double"),
        ("ma_long", "double"), ("signal", "string")))


@series_operator(lambda n=20, **_: n)
def price_features_table(s: Series, n: int = 20) -> Series:
    """The same values from row frames."""
    frame, short = s.rows(n), s.rows(5)
    s = s.add(_x_n=F.count("price").over(frame), returns=S.change(s, "price") * 100,
              ma_short=F.avg("price").over(short), _x_mean=F.avg("price").over(frame),
              _x_sd=F.stddev_pop("price").over(frame), _x_first=F.first("price").over(frame),
              _x_flat=F.min("price").over(frame) == F.max("price").over(frame))
    wide, full = F.col("_x_n") >= 5, F.col("_x_n") >= n
    s = s.add(
        volatility=F.when(wide & ~F.col("_x_flat"), F.col("_x_sd")).otherwise(0.0),
        momentum=F.when(wide, F.col("price") - F.col("_x_first")).otherwise(0.0),
        ma_long=F.when(full, F.col("_x_mean")),
        signal=F.when(full, F.when((F.col("ma_short") > F.col("_x_mean")) & ~F.col("_x_flat"), "bullish").otherwise("bearish")))
    return s.with_df(s.df.where("_x_n >= 2"))


def sentiment_ewma(decay: float = 0.95) -> Rule:
    def step(state, x):
        x = float(x)
        state = [x, 1] if state is None else [decay * state[0] + (1 - decay) * x, state[1] + 1]
        return state, (state[0], state[1])

    return Rule(lambda: None, step, ("score",), (("current_sentiment", "double"), ("message_count", "long")))


def sentiment_ewma_table(df: DataFrame, decay: float = 0.95, by=("symbol",), order=("time",), **layout) -> DataFrame:
    """The same values as an exponential mean with weight 1 - decay."""
    s = S.open_series(df, by, order, back=S.ewm_reach(1 - decay), **layout)
    s = S.running(s, message_count=("count", F.col("score")))
    return S.ewm_columns(s, current_sentiment=("score", 1 - decay, False)).close()


def cooldown(seconds: float) -> Rule:
    """Lets an alert through when the period since the last one let through is over."""

    def step(last, t):
        t = float(t)
        if last is not None and t - last < seconds:
            return last, None
        return t, (True,)

    return Rule(lambda: None, step, ("epoch",), (("fired", "boolean"),))


def cooldown_by_period() -> Rule:
    """The cooldown with the period of each row's rule and type, in whole microseconds."""

    def step(last, at, period):
        at = int(at)
        if last is not None and at - last < int(period):
            return last, None
        return at, (True,)

    return Rule(lambda: None, step, ("at", "period"), (("fired", "boolean"),))


def with_periods(alerts: DataFrame, periods: dict[str, float], kind: str = "alert_type", time: str = "time") -> DataFrame:
    """Adds ``at`` and ``period`` in microseconds; ``periods`` gives the seconds of each kind, others are not held back."""
    each = F.create_map(*[F.lit(x) for k, sec in periods.items() for x in (k, int(sec * 1_000_000))])
    return alerts.withColumns({"at": F.unix_micros(time), "period": F.coalesce(F.try_element_at(each, F.col(kind)), F.lit(0)).cast("long")})


def _allowed_next(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, at, nxt): for every moment of a key the first one at least its period later; (by, at) is unique in ``rows``.

    Rows lie in stretches of one period, so the next row is in the stretch behind, found by one
    running pass per (key, stretch), or is the first row of a later one.
    """
    rows = rows.withColumn("b", F.expr("(at - pmod(at, period)) div period"))  # whole numbers, also before 1970
    firsts = rows.groupBy(*by, "b").agg(F.min("at").alias("head"))
    here = rows.select(*by, "b", F.col("at").alias("x"), F.lit(1).alias("k"), "at")
    asking = rows.select(*by, (F.col("b") + 1).alias("b"), (F.col("at") + F.col("period")).alias("x"), F.lit(0).alias("k"), "at")
    back = Window.partitionBy(*by, "b").orderBy(F.desc("x"), F.desc("k"), F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    found = here.unionByName(asking).withColumn("near", F.last(F.when(F.col("k") == 1, F.col("at")), ignorenulls=True).over(back)).where("k = 0")
    # the stretches of a key, one row each: where the next one behind b + 1 begins
    spans = firsts.select(*by, "b", "head").unionByName(firsts.select(*by, (F.col("b") + 1).alias("b"), F.lit(None).cast(firsts.schema["head"].dataType).alias("head")))
    spans = spans.groupBy(*by, "b").agg(F.min("head").alias("head"))
    later = Window.partitionBy(*by).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("far", F.last("head", ignorenulls=True).over(later)).select(*by, "b", "far")
    return join_null_safe(found, spans, [*by, "b"]).select(*by, "at", F.coalesce("near", "far").alias("nxt"))


def cooldown_table(alerts: DataFrame, by, order=("time", "event_id")) -> DataFrame:
    """Alerts let through when the period since the last one let through is over (columns ``at`` and ``period`` as of
    ``with_periods``; one period per key; ``order`` starts with the time that ``at`` is made of).

    Alerts of one moment wait for the same one, and only the first of them can be let through, so a moment of a key becomes
    one row before the first shuffle. Every moment points to the first one at least a period later, and those let through
    are on the way from a key's first one. Jumps are composed, so the way is found in as many rounds as its length has
    binary digits, however many rows one key has.
    """
    by, order = list(by), list(order)
    held = F.col("period") > 0
    row = F.struct(*[c for c in alerts.columns if c not in (*by, "at", "period")])
    moments = cut_lineage(alerts.where(held).groupBy(*by, "at", "period").agg(F.min_by(row, F.struct(*order)).alias("_row")))
    jumps = cut_lineage(_allowed_next(moments.drop("_row"), by))
    on = cut_lineage(jumps.groupBy(*by).agg(F.min("at").alias("at")))
    # only moments that some moment points to can be reached
    reach = jumps.where("nxt is not null").select(*by, F.col("nxt").alias("at")).unionByName(on).distinct()
    jumps = cut_lineage(join_null_safe(jumps, reach.withColumn("_in", F.lit(True)), [*by, "at"]).where("_in").drop("_in"))
    while True:
        new = cut_lineage(join_null_safe(on, jumps, [*by, "at"]).where("nxt is not null").select(*by, F.col("nxt").alias("at")))
        if new.isEmpty():
            break
        on = cut_lineage(on.unionByName(new))
        further = jumps.select(*by, F.col("at").alias("nxt"), F.col("nxt").alias("far"))
        jumps = cut_lineage(join_null_safe(jumps, further, [*by, "nxt"]).select(*by, "at", F.col("far").alias("nxt")))
    through = join_null_safe(moments, on.withColumn("fired", F.lit(True)), [*by, "at"]).where("fired")
    through = through.select("*", "_row.*").select(*alerts.columns, "fired")
    return through.unionByName(alerts.where(~held).withColumn("fired", F.lit(True)))


def rate_limit(per_window: int = 60, window: float = 60.0, per_period: int = 1000, period: float = 3600.0) -> Rule:
    """Decision per request; only allowed requests use up quota. The long period
    starts again with the first request after it has expired."""

    def step(state, t):
        t = float(t)
        times = [x for x in state["times"] if x > t - window]
        used, reset = state["used"], state["reset"]
        if reset is None or t > reset:
            used, reset = 0, t + period
        ok = len(times) < per_window and used < per_period
        left = max(0, per_window - len(times))
        if ok:
            times, used = times + [t], used + 1
        return {"times": times, "used": used, "reset": reset}, (ok, left)

    return Rule(lambda: {"times": [], "used": 0, "reset": None}, step, ("epoch",),
                (("allowed", "boolean"), ("remaining", "long")))


def requests_in_window(df: DataFrame, seconds: int = 60, by=("client",), time: str = "time") -> DataFrame:
    """Plain count of the key's requests in the last seconds, without quota use.

    Rows go to their stretch of ``seconds`` and to the next one, which is all a
    frame can reach: a busy client spreads over its stretches.
    """
    span = seconds * 1_000_000
    at = F.unix_micros(time)
    home = F.floor(at / span)
    rows = df.withColumn("_home", home).withColumn("_part", F.explode(F.array(F.col("_home"), F.col("_home") + 1)))
    w = Window.partitionBy(*by, "_part").orderBy(at).rangeBetween(-(span - 1), 0)
    counted = rows.withColumn("recent", F.count(F.lit(1)).over(w))
    return counted.where(F.col("_part") == F.col("_home")).drop("_home", "_part")


def first_of_key(order: str = "time") -> Rule:
    """Passes the first row of a key. On a stream the first in the declared order of the rows that come together."""

    def step(seen, _):
        return True, (None if seen else ())

    return Rule(lambda: False, step, (order,), ())
