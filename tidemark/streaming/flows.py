"""Stream versions of the table operators and the plumbing to run them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ordering import first_by, last_by
from tidemark.operators import alerts as A
from tidemark.operators.costs import unit_cost
from tidemark.session import cut_lineage
from tidemark.sources.kafka import physical
from tidemark.sources.tables import scratch_path, upsert

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder)


# --- windowed aggregates ---------------------------------------------------------


def bars_stream(ticks: DataFrame, width: str = "1 hour", delay: str = "3 hours") -> DataFrame:
    """OHLCV per window; a window is final once the watermark has passed it."""
    return (
        ticks.withWatermark("time", delay).groupBy("symbol", F.window("time", width).alias("_w"))
        .agg(first_by("price", "time", "event_id").alias("open"), F.max("price").alias("high"),
             F.min("price").alias("low"), last_by("price", "time", "event_id").alias("close"),
             F.sum("volume").alias("volume"))
        .select("symbol", F.col("_w.start").alias("bucket"), "open", "high", "low", "close", "volume")
    )


def sentiment_stream(news: DataFrame, delay: str = "3 days") -> DataFrame:
    return (
        news.where(F.col("symbol").isNotNull()).withWatermark("time", delay)
        .groupBy("symbol", F.window("time", "1 day").alias("_w"))
        .agg(F.count(F.lit(1)).alias("news_count"), F.avg("score").alias("avg_sentiment"),
             F.count_if(F.col("label") == "positive").alias("positive_count"))
        .select("symbol", F.col("_w.start").alias("bucket"), "news_count", "avg_sentiment", "positive_count")
    )


def live_quotes(ticks: DataFrame) -> DataFrame:
    """Latest price per symbol; run in update or complete mode."""
    newest = F.max_by(F.struct("time", "price"), F.struct("time", "event_id"))
    return ticks.groupBy("symbol").agg(newest.alias("_q")).select("symbol", "_q.*")


def dedupe_stream(df: DataFrame, keys, time: str = "time", delay: str | None = None) -> DataFrame:
    """The first row of each key. Without ``delay`` keys are never forgotten, so the answer does not depend on the
    micro-batches and the state grows with the number of keys; with it a key may come again after that time."""
    if delay is None:
        return df.dropDuplicates(list(keys))
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def budget_stream(usage: DataFrame, daily_budget: float = 10.0, delay: str = "1 hour") -> DataFrame:
    """Spend per day; the day window restarts the total at midnight."""
    return (
        usage.withWatermark("time", delay).groupBy(F.window("time", "1 day").alias("_w"))
        .agg(F.count(F.lit(1)).alias("calls"), F.sum(unit_cost(F.col("api"))).alias("spent"))
        .select(F.to_date("_w.start").alias("date"), "calls", "spent", (F.col("spent") > daily_budget).alias("exceeded"))
    )


def alert_rules_stream(quotes: DataFrame, rules: DataFrame) -> DataFrame:
    """Quotes joined to a static rule table. Quotes carry the reference's change and
    the correlation, since a stream cannot look itself up."""
    for c in ("gold_change_percent", "gold_correlation", "rsi"):
        if c not in quotes.columns:
            quotes = quotes.withColumn(c, F.lit(None).cast("double"))
    return A.check_rules(quotes.join(rules.where("enabled"), "symbol"))


# --- routing and sinks -------------------------------------------------------------


def route_batch(records: DataFrame, processors: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Run each topic's processor on its records; results go to ``<topic>-processed``.

    A processor returns key and value columns; null values are dropped. Use inside
    ``foreachBatch`` or on a table of records.
    """
    out = None
    for topic, fn in processors.items():
        part = fn(records.where(F.col("topic") == physical(topic))).where(F.col("value").isNotNull())
        part = part.select(F.lit(f"{topic}-processed").alias("topic"), "key", "value")
        out = part if out is None else out.unionByName(part)
    return out


def router(processors, write: Callable[[DataFrame], None]):
    """foreachBatch function that hands a batch's routed records to ``write``."""

    def batch(df, _id):
        held = df.persist()
        write(route_batch(held, processors))
        held.unpersist()

    return batch


def upsert_batch(path: str, keys=("symbol", "time"), day: str = "date", time: str = "time"):
    """foreachBatch function that upserts into a table partitioned by day.

    Only the days of the batch are read and rewritten; replaying a batch gives the
    same table. The newest row of a key and day wins inside a batch; of several with the newest time, the one with the
    greatest values in the order of the columns.
    """

    def batch(delta: DataFrame, _id: int):
        spark = delta.sparkSession
        delta = delta.withColumn(day, F.to_date(time))
        newest = delta.groupBy(*dict.fromkeys((*keys, day))).agg(F.max_by(F.struct("*"), F.struct(F.col(time).alias("_newest"), *delta.columns)).alias("row"))
        delta = newest.select("row.*")
        # only a missing table counts as empty; every other error rises, or the rewrite would lose stored days
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            merged = delta
        else:
            base = spark.read.parquet(path)
            days = delta.select(day).distinct()
            merged = upsert(base.join(days, day, "left_semi").select(*delta.columns), delta, (*keys, day))
        merged = cut_lineage(merged)
        (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path))

    return batch


@dataclass(frozen=True)
class Arrivals:
    """A table that comes in parts: each part is added to ``folder`` once the stream has taken those before it."""

    folder: str
    parts: tuple[DataFrame, ...]


def arrivals(table: DataFrame, at: Column, parts: int = 4, late: Column | None = None, by: float = 0.0) -> Arrivals:
    """``table`` in parts of about equal size by the number ``at``; rows with ``late`` come as if ``at`` were greater by
    ``by``, so that those near the end of a part come with the next one."""
    cuts = table.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    when = at if late is None else at + F.when(late, F.lit(by)).otherwise(0.0)
    part = F.lit(0)
    for c in cuts:
        part = part + F.coalesce(when > c, F.lit(False)).cast("int")
    folder = scratch_path(table.sparkSession, "arrivals")
    table.where("false").write.parquet(folder)  # a stream needs its folder from the start
    return Arrivals(folder, tuple(table.where(part == i) for i in range(len(cuts) + 1)))


def replay(stream: DataFrame, mode: str = "append", name: str = "stream", come: Arrivals | None = None,
           batch: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Run a stream over all available input and return what it emitted; with ``batch`` it gets the batches instead.

    With ``come`` the stream runs once for each part, on from its state.
    """
    if mode == "update":
        raise ValueError("what a stream emits in update mode is no table; pass a batch function that merges it")
    spark = stream.sparkSession
    root = scratch_path(spark, name)
    old = {k: spark.conf.get(k) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    shards = min(int(old["spark.sql.shuffle.partitions"]), 2 * spark.sparkContext.defaultParallelism)
    spark.conf.set("spark.sql.shuffle.partitions", str(shards))

    def whole(df, _id):
        df.write.mode("overwrite").parquet(f"{root}/out")

    try:
        writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/state")
        if batch is not None or mode != "append":
            writer = writer.foreachBatch(batch or whole)
        else:
            writer = writer.format("parquet").option("path", f"{root}/out")
        for part in come.parts if come else (None,):
            if part is not None:
                part.write.mode("append").parquet(come.folder)
            writer.start().awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    return None if batch is not None else spark.read.schema(stream.schema).parquet(f"{root}/out")
