"""The live dashboard: table, stream and a plain rule over hot keys, quiet days, ties and nulls."""

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import sentiment as SE
from tidemark.streaming import flows as SF
from tidemark.streaming.dashboard import live_dashboard

START = datetime(2024, 1, 1)
SCHEMA = "news_id long, symbol string, time timestamp, score double, label string"


def news():
    rng, rows = random.Random(5), []

    def add(symbol, seconds):
        score = None if rng.random() < 0.2 else rng.uniform(-1, 1)
        label = None if score is None else "positive" if score > 0.2 else "negative" if score < -0.2 else "neutral"
        rows.append((len(rows), symbol, None if seconds is None else START + timedelta(seconds=seconds), score, label))

    for i in range(400):  # a hot key: many rows in one step, several at the same time
        add("HOT", 36_000 + rng.randrange(1_200) // 7 * 7)
    for day in (0, 3, 4, 9):  # quiet days between few rows
        for _ in range(4):
            add("B", day * 86_400 + rng.randrange(20_000))
    add("C", 86_400)
    add(None, 90_000)
    add("B", None)
    add("Z", 12 * 86_400)  # moves the watermark past all others
    return rows


def plain(rows, symbol, until):
    """The dashboard of a symbol at one time, from the rows before it."""
    mine = sorted((r for r in rows if r[1] == symbol and r[2] is not None and r[2] < until), key=lambda r: (r[2], r[0]))
    last = mine[-10:]
    wide = [r for r in mine if r[2] >= until - timedelta(days=1)] or last

    def mean(x):
        x = [r[3] for r in x if r[3] is not None]
        return sum(x) / len(x) if x else None

    new, old = mean(last[-5:]), mean(last[:5])
    trend = "stable"
    if len(last) >= 5 and new is not None and old is not None and abs(new - old) > 0.05:
        trend = "improving" if new > old else "declining"
    n = len(wide)
    return (n, mean(wide), trend, sum(r[4] == "positive" for r in wide) / n, sum(r[4] == "negative" for r in wide) / n)


def ends(rows):
    step = timedelta(minutes=5)
    return {(r[1], START + ((r[2] - START) // step + k) * step) for r in rows if r[2] is not None for k in range(1, 290)}


def held(df):
    return {(r["symbol"], r["until"]): (r["news_volume_24h"], r["current_sentiment"], r["trend"], r["bullish_ratio"], r["bearish_ratio"]) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert (g[0], g[2]) == (w[0], w[2]), (k, g, w)
        for a, b in ((g[1], w[1]), (g[3], w[3]), (g[4], w[4])):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9), (k, g, w)


def test_table_and_stream_give_the_plain_rule(spark):
    rows = news()
    want = {k: plain(rows, *k) for k in ends(rows)}
    df = spark.createDataFrame(rows, SCHEMA)
    table = SE.live_dashboards(df, order=("time", "news_id"))
    same(held(table), want)
    same(held(SE.live_dashboards(df, order=("time", "news_id"), block_rows=48)), want)
    come = SF.arrivals(df.where(F.col("time").isNotNull()), F.unix_seconds("time"), parts=3)
    stream = SF.file_stream(spark, come.folder, df.schema)
    got = held(SF.replay(live_dashboard(stream, tie=F.col("news_id"), delay="7 minutes"), name="dash", come=come))
    last = START + timedelta(days=12) - timedelta(minutes=7)
    same(got, {k: v for k, v in want.items() if k[1] <= last})


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert SE.live_dashboards(none, order=("time", "news_id")).count() == 0


def test_state_holds_sums_only():
    """A million rows of one step leave at most ten of them."""
    from tidemark.streaming.dashboard import _summed

    n = 50_000
    pdf = pd.DataFrame({"symbol": ["A"] * n, "time": pd.Timestamp(START), "step": [7] * n, "at": range(n), "tie": [0] * n,
                        "score": [0.5] * n, "label": [1] * n})
    out = list(_summed(["symbol"])(iter([pdf] * 20)))
    assert sum(len(x) for x in out) == 20
    assert all(len(x["last"].iloc[0]) == 10 and x["n"].iloc[0] == n for x in out)


def test_a_key_has_one_timer_and_an_entry_per_day():
    """1,000 steps of a key in one micro-batch: calls of the state follow the days, not the steps."""
    from tests.test_streams import Store
    from tidemark.streaming.dashboard import DashboardProcessor

    values, timers = {}, set()

    class Value:
        def __init__(self, name):
            self.name = name

        def exists(self):
            return self.name in values

        def get(self):
            return values[self.name]

        def update(self, v):
            values[self.name] = v

        def clear(self):
            values.pop(self.name, None)

    store = Store()
    store.getValueState = lambda name, schema: Value(name)
    store.registerTimer, store.deleteTimer = timers.add, timers.discard
    p = DashboardProcessor(["symbol"], 300, 86_400)
    p.init(store)
    steps = list(range(288_000, 289_000))
    last = [[{"at": s * 300_000_000, "tie": 0, "score": 0.5, "label": 1}] for s in steps]
    pdf = pd.DataFrame({"step": steps, "n": 1, "s": 1, "x": 0.5, "p": 1, "q": 0, "last": last})
    assert list(p.handleInputRows(("A",), iter([pdf]), None)) == []
    assert timers == {288_001 * 300_000} and len(store.maps["waiting"]) == 4

    class Mark:
        def __init__(self, step):
            self.ms = step * 300_000

        def getCurrentWatermarkInMs(self):
            return self.ms

    timers.clear()  # Spark takes a timer that has fired away
    early = pd.concat(p.handleExpiredTimer(("A",), Mark(288_500), None))
    assert len(early) == 500 and timers == {288_501 * 300_000} and len(store.maps["waiting"]) == 3
    timers.clear()
    rest = pd.concat(p.handleExpiredTimer(("A",), Mark(300_000), None))
    assert len(rest) == 500 + 288 and rest["n"].max() == 288 and rest["n"].iloc[-1] == 10 and not store.maps["waiting"]
