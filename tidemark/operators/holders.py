"""Institutional holder snapshots and the changes between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import series as S
from tidemark.functions.stats import attach
from tidemark.session import cut_lineage

# Names that mark a holder as notable.
NOTABLE = [
    "BlackRock", "Vanguard", "State Street", "Fidelity", "JPMorgan", "Goldman Sachs", "Morgan Stanley",
    "Bank of America", "Bridgewater", "Ray Dalio", "Citadel", "Renaissance", "Two Sigma", "AQR", "D.E. Shaw",
    "Soros Fund", "Berkshire Hathaway",
]
SNAP = ("symbol", "report_date")


def top_holders(df: DataFrame, n: int = 20) -> DataFrame:
    """The n largest holders of each snapshot, ``rank`` 1 for the largest."""
    w = Window.partitionBy(*SNAP).orderBy(F.col("shares").desc(), "name")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def snapshot(df: DataFrame) -> DataFrame:
    """Totals, holder count, top-20 list and top-10 share of each snapshot, in one pass."""
    rank = F.row_number().over(Window.partitionBy(*SNAP).orderBy(F.col("shares").desc(), "name"))
    return (
        df.withColumn("rank", rank).groupBy(*SNAP).agg(
            F.sum("shares").alias("total_shares"), F.sum("pct_held").alias("total_pct"), F.count(F.lit(1)).alias("num_holders"),
            F.sum(F.when(F.col("rank") <= 10, F.col("shares"))).alias("_top10"),
            F.array_sort(F.collect_list(F.when(F.col("rank") <= 20, F.struct("rank", "name")))).alias("_list"))
        .withColumn("concentration", F.col("_top10") / (F.col("total_shares") + 1e-10) * 100)
        .withColumn("top_holders", F.transform("_list", lambda x: x["name"]))
        .drop("_top10", "_list")
    )


def holder_diff(df: DataFrame, notable=tuple(NOTABLE), snapshots: DataFrame | None = None) -> DataFrame:
    """Changes of each holder against the previous snapshot's top 20.

    Snapshots of a symbol are numbered, and a holder's row looks one number back among its own rows, so nothing is joined
    but the numbers. ``snapshots``, if at hand, gives the dates without another scan.
    """
    dates = (df if snapshots is None else snapshots).select(*SNAP).distinct()
    steps = dates.withColumn("_step", F.row_number().over(Window.partitionBy("symbol").orderBy("report_date")).cast("long"))
    rank = F.row_number().over(Window.partitionBy(*SNAP).orderBy(F.col("shares").desc(), "name"))
    before = Window.partitionBy("symbol", "name").orderBy("_step").rangeBetween(-1, -1)
    joined = df.withColumn("_rank", rank).join(steps, list(SNAP)).withColumn(
        "prev_shares", F.max(F.when(F.col("_rank") <= 20, F.col("shares"))).over(before)).where(F.col("_step") > 1)
    is_new = F.col("prev_shares").isNull()
    name = F.lower("name")
    known = F.exists(F.array(*[F.lit(n.lower()) for n in notable]), lambda n: F.contains(name, n))
    pct = S.ratio("shares", "prev_shares") * 100 - 100
    out = joined.withColumn(
        "change_pct", F.when(is_new, F.lit(100.0)).otherwise(pct)
    ).withColumn(
        "significance",
        F.when(is_new, F.when((F.col("shares") > 0) & known, "major"))
        .when(F.col("prev_shares") <= 0, None)
        .when(F.abs("change_pct") > 50, "major").when(F.abs("change_pct") > 20, "moderate")
        .when(F.abs("change_pct") > 5, "minor"),
    )
    return out.where(F.col("significance").isNotNull()).select(
        "symbol", "report_date", "name", F.coalesce("prev_shares", F.lit(0.0)).alias("prev_shares"),
        F.col("shares").alias("new_shares"),
        (F.col("shares") - F.coalesce("prev_shares", F.lit(0.0))).alias("change_shares"),
        "change_pct", "significance")


def comparison(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of every symbol."""
    cols = F.struct("num_holders", "total_pct", F.col("concentration").alias("concentration_top10"),
                    F.col("report_date").alias("snapshot_date"))
    return snapshots.groupBy("symbol").agg(F.max_by(cols, "report_date").alias("_l")).select("symbol", "_l.*")


def recent_changes(changes: DataFrame, asof, days: int = 90, symbol: str | None = None,
                   significance: str | None = None) -> DataFrame:
    out = changes.where(F.col("report_date") >= F.date_sub(F.lit(asof).cast("date"), days))
    if symbol is not None:
        out = out.where(F.col("symbol") == symbol)
    if significance is not None:
        out = out.where(F.col("significance") == significance)
    return out.orderBy(F.col("report_date").desc())


def smart_money(df: DataFrame, notable=tuple(NOTABLE)) -> DataFrame:
    """``smart_money_flow`` from the positions: they are read once for the snapshots and once for the changes."""
    snapshots = cut_lineage(snapshot(df))
    return smart_money_flow(cut_lineage(holder_diff(df, notable, snapshots)), snapshots)


def smart_money_flow(changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Direction of all recorded changes and the first five notable moves each way."""
    net = changes.groupBy("symbol").agg(F.sum("change_shares").alias("_net"))
    big = changes.where(F.col("significance").isin("major", "moderate") & (F.col("change_shares") != 0)).withColumn(
        "side", F.when(F.col("change_shares") > 0, "up").otherwise("down"))
    w = Window.partitionBy("symbol", "side").orderBy("report_date", F.col("new_shares").desc(), "name")
    first = big.withColumn("k", F.row_number().over(w)).where(F.col("k") <= 5)

    def names(side):
        picked = F.collect_list(F.when(F.col("side") == side, F.struct("k", "name")))
        return F.transform(F.array_sort(picked), lambda x: x["name"])

    movers = first.groupBy("symbol").agg(names("up").alias("notable_increases"), names("down").alias("notable_decreases"))
    latest = snapshots.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_k"), F.max_by("concentration", "report_date").alias("current_concentration"),
        F.max_by("num_holders", "report_date").alias("num_holders"))
    out = attach(attach(latest, net, ["symbol"]), movers, ["symbol"])
    total = F.coalesce("_net", F.lit(0.0))
    empty = F.array().cast("array<string>")
    return out.select(
        "symbol",
        F.when(F.col("_k") < 2, "unknown").when(total > 0, "increasing").when(total < 0, "decreasing")
        .otherwise("stable").alias("direction"),
        total.alias("net_change_shares"), "current_concentration", "num_holders",
        F.coalesce("notable_increases", empty).alias("notable_increases"),
        F.coalesce("notable_decreases", empty).alias("notable_decreases"))


