"""Shapes of the physical plans: shuffles, pushed filters, read columns."""

from pyspark.sql import functions as F

from tidemark.functions import rows as RW
from tidemark.functions.stats import tail
from tidemark.operators import alerts, composites, features, holders, trend, volatility
from tidemark.plans import views as V
from tidemark.session import cut_lineage


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning")


def test_indicators_share_one_shuffle(spark, sf):
    bars = V.bars(spark, sf)
    assert shuffles(bars) == 1
    for op in (trend.sma, trend.adx, trend.macd, trend.bollinger, volatility.keltner, composites.technical_analysis,
               composites.price_indicators, features.price_features, features.technical_features,
               features.direction_features, features.volatility_features):
        # one for the bars, one for the symbol
        assert shuffles(op(bars, max_rows=1000)) == 2, op.__name__


def test_filters_and_columns_reach_the_scan(spark, sf):
    df = RW.date_filter(V.table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity"), "l_quantity", 10.0, 20.0)
    p = plan(df.select("l_orderkey", "l_quantity"))
    assert "GreaterThanOrEqual(l_quantity,10.0)" in p
    assert "l_comment" not in p and "l_shipdate" not in p.split("ReadSchema")[1]


def test_tail_limits_before_the_shuffle(spark, sf):
    p = plan(tail(V.ticks(spark, sf), 5, order=("time", "event_id")))
    before = p.split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in before


def test_bars_combine_before_the_shuffle(spark, sf):
    assert "partial_max" in plan(V.bars(spark, sf)).split("Exchange hashpartitioning")[1]


def test_detections_and_holders_scan_once(spark, sf):
    flows, held = V.flows(spark, sf), V.holders(spark, sf).withColumn("pct_held", F.col("shares"))

    def scans(df):
        return plan(df).count("FileScan")

    one = scans(flows)
    near = alerts._recent(flows, 60, 20, "net_flow", "time", *alerts._scored("_f", "net_flow", 60), *alerts._sides(5, "net_flow"))
    assert scans(near) == one and "WindowGroupLimit" in plan(near)
    assert plan(near).count("Sort [") <= 3  # one for the window and its group limit, the rest for the merge of the view
    assert scans(alerts.run_all(flows, flows)) == 0 and scans(alerts.correlated_flows(flows)) == 0  # all read the checkpoint
    base = scans(held)
    snaps = holders.snapshot(held)
    assert scans(snaps) == base
    assert scans(holders.holder_diff(held, snapshots=cut_lineage(snaps))) == base
    assert scans(holders.smart_money(held)) == 0
