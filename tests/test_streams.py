"""Streams over several micro-batches give the rows of the table version."""

import uuid
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_layout import walk
from tidemark.sources import kafka as K
from tidemark.streaming import flows as SF
from tidemark.streaming import rules as SR
from tidemark.streaming.stateful import Rule, RuleProcessor, apply_stream, apply_table

ORDER = ["time", "event_id"]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    pdf = walk({"HOT": 300, "B": 40, "C": 3}, seed=11).sort_values("time").reset_index(drop=True)
    pdf["event_id"] = range(len(pdf))
    pdf["price"], pdf["score"] = pdf["close"], (pdf["close"] - 100) / 50
    pdf["epoch"] = pdf["time"].astype("int64") / 1e9
    folder = str(tmp_path_factory.mktemp("ev") / uuid.uuid4().hex)
    step = len(pdf) // 4 + 1
    for i in range(4):
        spark.createDataFrame(pdf.iloc[i * step:(i + 1) * step]).coalesce(1).write.mode("append").parquet(folder)
    return folder


def table(spark, folder):
    return spark.read.parquet(folder)


def stream(spark, folder):
    return SF.file_stream(spark, folder, table(spark, folder).schema, files=1)


def equal(a, b, keys):
    a, b = (x.toPandas().sort_values(keys).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a[sorted(a.columns)], b[sorted(a.columns)], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("rule", [SR.price_features(), SR.sentiment_ewma(), SR.cooldown(6 * 3600), SR.rate_limit(2, 86400, 5, 4 * 86400)],
                         ids=["features", "ewma", "cooldown", "rate"])
def test_rule_stream_equals_table(spark, events, rule):
    args = (rule, ["symbol"], ["event_id", "symbol"], ORDER)
    equal(SF.replay(apply_stream(stream(spark, events), *args)), apply_table(table(spark, events), *args), ["event_id"])


def test_declarative_twins(spark, events):
    t = table(spark, events)
    rule = apply_table(t, SR.price_features(), ["symbol"], ["event_id", "symbol"], ORDER)
    for kw in ({"max_rows": 300}, {"block_rows": 40}):
        twin = SR.price_features_table(t, order=tuple(ORDER), **kw).select(rule.columns)
        equal(rule, twin, ["event_id"])
    ewma = apply_table(t, SR.sentiment_ewma(), ["symbol"], ["event_id", "symbol"], ORDER)
    equal(ewma, SR.sentiment_ewma_table(t, order=tuple(ORDER), block_rows=60).select(ewma.columns), ["event_id"])


def test_bars_leave_out_the_open_windows(spark, events):
    t = table(spark, events)
    got = SF.replay(SF.bars_stream(stream(spark, events)))
    cut = t.agg((F.max("time") - F.expr("INTERVAL 3 HOURS")).alias("c")).first()["c"]
    from tidemark.operators.bars import hourly

    want = hourly(t).where(F.col("bucket") + F.expr("INTERVAL 1 HOUR") <= F.lit(cut)).select(got.columns)
    equal(got, want, ["symbol", "bucket"])


def test_upsert_stream_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "table")
    batch = SF.upsert_batch(path)
    one = spark.createDataFrame([("A", "2024-01-01 10:00:00", 1.0, "x"), ("A", "2024-01-02 10:00:00", 2.0, "x")],
                                "symbol string, time string, close double, source string").withColumn("time", F.to_timestamp("time"))
    two = spark.createDataFrame([("A", "2024-01-02 10:00:00", 9.0, "y"), ("B", "2024-01-02 10:00:00", 5.0, "y")],
                                "symbol string, time string, close double, source string").withColumn("time", F.to_timestamp("time"))
    batch(one, 0)
    batch(two, 1)
    batch(two, 1)  # replay
    rows = sorted((r["symbol"], str(r["time"]), r["close"], r["source"]) for r in spark.read.parquet(path).collect())
    assert rows == [("A", "2024-01-01 10:00:00", 1.0, "x"), ("A", "2024-01-02 10:00:00", 9.0, "x"), ("B", "2024-01-02 10:00:00", 5.0, "y")]


def test_dedupe_and_router(spark, events):
    got = SF.replay(SF.dedupe_stream(stream(spark, events), ["symbol"], delay="100 days"))
    assert got.count() == 3
    seen = []
    fn = SF.router({"prices": lambda r: r.select("key", F.upper("key").alias("value"))}, lambda df: seen.append(df.count()))
    fn(K.envelope(table(spark, events).select("symbol", "price"), "prices", "symbol", "2024-01-01 00:00:00"), 0)
    assert seen == [343]


def test_topic_names():
    assert K.physical("prices") == "precious-metals-prices"
    assert K.physical("other") == "other"


def test_arrivals_keep_every_row_and_send_late_ones_on(spark, events):
    t = table(spark, events)
    at = F.unix_seconds("time")
    plain, late = SF.arrivals(t, at), SF.arrivals(t, at, late=F.col("event_id") % 3 == 0, by=1e5)
    for come in (plain, late):
        ids = sorted(r["event_id"] for part in come.parts for r in part.select("event_id").collect())
        assert len(come.parts) == 4 and ids == list(range(343))
    ends = [[part.agg(F.min(at).alias("a"), F.max(at).alias("b")).first() for part in come.parts] for come in (plain, late)]
    assert all(x["b"] < y["a"] for x, y in zip(ends[0], ends[0][1:]))
    assert any(x["b"] > y["a"] for x, y in zip(ends[1], ends[1][1:]))
    assert sum(p.count() for p in SF.arrivals(t.where("false"), at).parts) == 0


def test_first_rows_do_not_depend_on_the_parts(spark, events):
    t = table(spark, events)
    for parts in (1, 4):
        come = SF.arrivals(t, F.unix_seconds("time"), parts)
        got = SF.replay(SF.dedupe_stream(SF.file_stream(spark, come.folder, t.schema), ["symbol"]), come=come)
        assert got.count() == 3


def test_update_mode_is_refused(spark, events):
    with pytest.raises(ValueError, match="update"):
        SF.replay(SF.live_quotes(stream(spark, events)), "update")


def test_upsert_keeps_each_day_of_a_batch(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = spark.createDataFrame([("A", "2024-01-01 10:00:00", 1.0), ("A", "2024-01-01 11:00:00", 2.0), ("A", "2024-01-02 10:00:00", 3.0)],
                                 "symbol string, time string, close double").withColumn("time", F.to_timestamp("time"))
    SF.upsert_batch(path, keys=("symbol",))(rows, 0)
    assert sorted((str(r["date"]), r["close"]) for r in spark.read.parquet(path).collect()) == [("2024-01-01", 2.0), ("2024-01-02", 3.0)]


class Store:
    """State of one key in memory, with the calls that the processor makes."""

    def __init__(self):
        self.maps, self.value, self.timers = {}, None, []

    def getValueState(self, name, schema):
        store = self

        class Value:
            exists = staticmethod(lambda: store.value is not None)
            get = staticmethod(lambda: store.value)

            def update(self, v):
                store.value = v

        return Value()

    def getMapState(self, name, key, value):
        held = self.maps.setdefault(name, {})

        class Map:
            keys = staticmethod(lambda: iter(list(held)))
            containsKey = staticmethod(lambda k: k in held)
            getValue = staticmethod(lambda k: held[k])
            removeKey = staticmethod(lambda k: held.pop(k))
            updateValue = staticmethod(lambda k, v: held.__setitem__(k, v))

        return Map()

    def registerTimer(self, ms):
        self.timers.append(ms)


def in_order():
    """Emits a row's number if it is not older than all before."""
    return Rule(lambda: [0, -1.0], lambda s, t: ([s[0] + 1, max(s[1], float(t))], (s[0] + 1, float(t) >= s[1])), ("epoch",), (("number", "long"), ("ordered", "boolean")))


def shuffled(n, seed=3, size=10_000, days=10):
    at = pd.Series(range(n)) * (days * 86400 / n)
    pdf = pd.DataFrame({"event_id": range(n), "symbol": "HOT", "epoch": at, "time": pd.Timestamp("2024-01-01") + pd.to_timedelta(at, unit="s")})
    pdf = pdf.sample(frac=1, random_state=seed)
    return [pdf.iloc[i : i + size] for i in range(0, n, size)]


def test_a_million_rows_of_a_key_in_bounded_memory(monkeypatch):
    seen = []
    plain = RuleProcessor._run
    monkeypatch.setattr(RuleProcessor, "_run", lambda self, pdf: seen.append(len(pdf)) or plain(self, pdf))
    p, store = RuleProcessor(in_order(), ["event_id"], ORDER), Store()
    p.init(store)
    out = pd.concat(p.handleInputRows("HOT", iter(shuffled(1_000_000)), None))
    assert len(out) == 1_000_000 and out["ordered"].all() and list(out["event_id"]) == list(range(1_000_000))
    assert max(seen) <= 5_000 and not store.maps["held"] and not store.maps["runs"]


def test_timed_rows_wait_for_the_watermark():
    p, store = RuleProcessor(in_order(), ["event_id"], ORDER, timed=True), Store()
    p.init(store)
    first, *rest = shuffled(60_000, size=20_000, days=5)
    assert list(p.handleInputRows("HOT", iter([first]), None)) == [] and len(store.timers) == 120

    class Mark:
        def __init__(self, hours):
            self.ms = (1704067200 + hours * 3600) * 1000

        def getCurrentWatermarkInMs(self):
            return self.ms

    early = pd.concat(p.handleExpiredTimer("HOT", Mark(10), None))
    assert (early["event_id"] < 5_000).all()
    assert list(p.handleExpiredTimer("HOT", Mark(10), None)) == []
    later = [x[x["epoch"] >= 36_000] for x in rest]  # what is older would be dropped before it gets here
    assert list(p.handleInputRows("HOT", iter(later), None)) == []
    done = pd.concat(p.handleExpiredTimer("HOT", Mark(120), None))
    assert done["ordered"].all() and list(done["event_id"]) == list(range(5_000, 60_000)) and not store.maps["held"]


def test_hot_key_in_a_stream(spark, tmp_path):
    """One key with 300,000 rows in one micro-batch, out of order."""
    whole = pd.concat(shuffled(300_000))
    spark.createDataFrame(whole).coalesce(1).write.parquet(f"{tmp_path}/in")
    frame = table(spark, f"{tmp_path}/in")
    got = SF.replay(apply_stream(SF.file_stream(spark, f"{tmp_path}/in", frame.schema), in_order(), ["symbol"], ["event_id"], ORDER))
    row = got.agg(F.count("*").alias("n"), F.min("ordered").alias("ordered"), F.max(F.abs(F.col("number") - 1 - F.col("event_id"))).alias("off")).first()
    assert row["n"] == 300_000 and row["ordered"] and row["off"] == 0


def test_late_rows_find_their_place(spark, events):
    """A third of the rows comes one part late; with a delay the stream still equals the table."""
    t = table(spark, events).select("event_id", "symbol", "time", "price", "score", "epoch")
    for rule in (SR.price_features(), SR.sentiment_ewma()):
        come = SF.arrivals(t, F.col("epoch"), late=F.col("event_id") % 3 == 0, by=5 * 3600.0)
        stream_ = SF.file_stream(spark, come.folder, t.schema)
        got = SF.replay(apply_stream(stream_, rule, ["symbol"], ["event_id", "symbol"], ORDER, delay="2 days"), come=come)
        newest = t.agg(F.max("epoch")).first()[0]
        upto = (newest - 2 * 86400) // 3600 * 3600
        want = apply_table(t, rule, ["symbol"], ["event_id", "symbol"], ORDER).join(t.where(F.col("epoch") < upto).select("event_id"), "event_id")
        equal(got, want.select(got.columns), ["event_id"])
        assert got.count() > 50


@pytest.mark.parametrize("seconds", [0, 1, 300, 3600, 10800])
def test_cooldown_by_jumps(spark, seconds):
    import random

    rng = random.Random(seconds)
    rows = [(i, k, datetime(2024, 1, 1) + timedelta(microseconds=rng.randrange(3_000) * 10_000_000 + rng.choice([0, 0, 1]))) for i in range(900) for k in [rng.choice(["HOT"] * 8 + ["B", None])]]
    frame = spark.createDataFrame(rows, "event_id long, symbol string, time timestamp").withColumn("alert_type", F.lit("x")).repartition(5)
    got = SR.cooldown_table(SR.with_periods(frame, {"x": seconds}), ["symbol", "alert_type"])
    want, last = set(), {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or t - last[k] >= timedelta(seconds=seconds):
            last[k] = t
            want.add(i)
    assert sorted(r["event_id"] for r in got.collect()) == sorted(want)
    assert SR.cooldown_table(SR.with_periods(frame.limit(0), {"x": 5}), ["symbol"]).count() == 0


def test_alerts_of_one_moment_are_one_row(spark, monkeypatch):
    """Copies of a moment add nothing to the jumps, and only the first of them is let through."""
    met, jumps = [], SR._allowed_next
    monkeypatch.setattr(SR, "_allowed_next", lambda rows, by: met.append(rows.count()) or jumps(rows, by))
    rows = [(c * 50 + i, "A", datetime(2024, 1, 1) + timedelta(seconds=10 * i)) for i in range(50) for c in range(40)]
    rows += [(7, "B", datetime(2024, 1, 1))] * 2 + [(5, None, datetime(2024, 1, 1))]
    frame = spark.createDataFrame(rows, "event_id long, symbol string, time timestamp").withColumn("alert_type", F.lit("x"))
    alerts = SR.with_periods(frame, {"x": 25})
    got = SR.cooldown_table(alerts, ["symbol", "alert_type"])
    assert met == [52]
    assert got.columns == [*alerts.columns, "fired"]
    assert sorted(r["event_id"] for r in got.where("symbol = 'A'").collect()) == list(range(0, 50, 3))
    assert [r["event_id"] for r in got.where("symbol = 'B' OR symbol IS NULL").orderBy("event_id").collect()] == [5, 7]


def test_equal_prices_are_no_trend(spark):
    """Means of 5 and of 20 equal prices differ by their rounding only: no side, no deviation."""
    rows = [(i, p, datetime(2024, 1, 1) + timedelta(minutes=i), price) for p in range(40) for i, price in enumerate([76.13 + 0.37 * p] * 30)]
    t = spark.createDataFrame(rows, "event_id long, symbol long, time timestamp, price double")
    rule = apply_table(t, SR.price_features(), ["symbol"], ["event_id", "symbol"], ORDER)
    for got in (rule, SR.price_features_table(t, order=tuple(ORDER)), SR.price_features_table(t, order=tuple(ORDER), block_rows=25)):
        seen = {(r["signal"], r["volatility"]) for r in got.select("signal", "volatility").collect()}
        assert seen == {(None, 0.0), ("bearish", 0.0)}


def test_keys_of_a_bucket_come_together(spark, tmp_path):
    """Thousands of keys with few rows: a call and few state entries per bucket, each key with its own state."""
    p, store = RuleProcessor(SR.rate_limit(2, 1e9, 9, 1e9), ["event_id", "client"], ORDER), Store()
    p.init(store)
    n = 4_000
    for part in range(2):
        pdf = pd.DataFrame({"event_id": range(2 * n), "client": [i % n for i in range(2 * n)], "epoch": [float(part)] * (2 * n), "time": pd.Timestamp("2024-01-01")})
        pdf["rule_key"], pdf["rule_slot"] = pdf["client"].astype(str), (pdf["client"] % 16).astype("int32")
        out = pd.concat(p.handleInputRows("bucket", iter([pdf]), None))
        assert len(out) == 2 * n and out["allowed"].all() == (part == 0) and len(store.maps["states"]) == 16
    rows = [(i, i % 700 if i % 11 else None, datetime(2024, 1, 1) + timedelta(seconds=i // 3)) for i in range(4_200)]
    t = spark.createDataFrame(rows, "event_id long, client long, time timestamp")
    come = SF.arrivals(t, F.unix_seconds("time"), 2)
    got = SF.replay(apply_stream(SF.file_stream(spark, come.folder, t.schema), SR.first_of_key(), ["client"], ["event_id", "client"], ORDER), come=come)
    first = {}
    for i, client, _ in rows:
        first.setdefault(client, i)
    assert sorted(r["event_id"] for r in got.collect()) == sorted(first.values())


def test_a_rule_holds_its_columns_only(spark, events, monkeypatch):
    from tidemark import series as S
    from tidemark.streaming import stateful as ST

    seen, plain, opened = [], ST.scan, S.open_series
    monkeypatch.setattr(ST, "scan", lambda df, *a, **k: seen.append(df.columns) or plain(df, *a, **k))
    monkeypatch.setattr(S, "open_series", lambda *a, **k: seen.append(k["block_rows"]) or opened(*a, **k))
    t = table(spark, events)
    got = apply_table(t, SR.cooldown(6 * 3600), ["symbol"], ["event_id", "symbol"], ORDER)
    assert sorted(seen[0]) == ["epoch", "event_id", "symbol", "time"] and seen[1] == S.SCAN_ROWS < S.BLOCK_ROWS
    small = apply_table(t, SR.cooldown(6 * 3600), ["symbol"], ["event_id", "symbol"], ORDER, block_rows=40)
    equal(got, small, ["event_id"])
