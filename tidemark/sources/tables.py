"""Reading and writing tables: prices, upserts, logs, rules, layout, retention."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.alerts import RULE_SCHEMA
from tidemark.session import ensure_checkpoint_dir

# The price columns, in order.
OHLCV = ["time", "symbol", "open", "high", "low", "close", "volume", "adj_close", "source"]
RENAMES = {"date": "time", "datetime": "time", "adj close": "adj_close"}
KEEP_YEARS = {"prices": 5, "news": 3, "flows": 10, "sentiment": 2}


def shape_ohlcv(df: DataFrame, symbol: str | None = None, source: str = "file", start=None, end=None) -> DataFrame:
    """Lower-case names, one time column in UTC, symbol and source stamped, null closes dropped."""
    df = df.withColumnsRenamed({c: RENAMES.get(c.lower(), c.lower()) for c in df.columns})
    if symbol is not None:
        df = df.withColumn("symbol", F.lit(symbol))
    df = df.withColumn("source", F.lit(source)).withColumn("time", F.col("time").cast("timestamp"))
    if start is not None:
        df = df.where(F.col("time") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col("time") < F.lit(end).cast("timestamp"))
    return df.select(*[c for c in OHLCV if c in df.columns]).dropna(subset=["close"])


def load_ohlcv(spark: SparkSession, path, symbol=None, start=None, end=None, fmt: str = "parquet", schema=None,
               asof=None, **options) -> DataFrame:
    """Read price files; with ``asof`` and no start, the 365 days before it."""
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.format(fmt).load(path)
    if start is None and asof is not None:
        shaped = shape_ohlcv(df, symbol, fmt, None, end)
        return shaped.where(F.col("time") >= F.lit(asof).cast("timestamp") - F.expr("INTERVAL 365 DAYS"))
    return shape_ohlcv(df, symbol, fmt, start, end)


def load_many(parts: list[DataFrame]) -> DataFrame:
    """Union by name with missing columns as null, sorted by symbol and time."""
    return union_feeds(parts).orderBy("symbol", "time")


def union_feeds(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


PRICED = ("close", "open", "high", "low", "volume")


def upsert(base: DataFrame, delta: DataFrame, keys=("symbol", "time"), update=PRICED) -> DataFrame:
    """New keys are inserted; on known keys only the ``update`` columns change.

    ``delta`` holds one row per key. Both sides are joined on the key, which
    spreads a huge symbol over its times.
    """
    other = [c for c in base.columns if c not in keys]
    d = delta.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_d_{c}") for c in other if c in delta.columns])
    joined = base.withColumn("_old", F.lit(True)).join(d, list(keys), "full_outer")
    hit, new = F.col("_old").isNotNull() & F.col("_new").isNotNull(), F.col("_old").isNull()
    cols = []
    for c in other:
        if c not in delta.columns:
            cols.append(F.col(c))
        elif c in update:
            cols.append(F.when(hit | new, F.col(f"_d_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.when(new, F.col(f"_d_{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(*keys, *cols)


def insert_ignore(base: DataFrame, delta: DataFrame, keys, order=()) -> DataFrame:
    """Rows with unknown keys are added, one per key: the first by the ``order`` columns, which need not be columns of
    ``base``. Without ``order`` the least row is taken."""
    rest = [c for c in base.columns if c not in keys]
    fresh = exclude_existing(delta, base, keys).groupBy(*keys).agg(
        F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("_row"))).alias("_f"))
    return base.unionByName(fresh.select(*keys, "_f._row.*"))


def exclude_existing(delta: DataFrame, base: DataFrame, keys) -> DataFrame:
    return delta.join(base.select(*keys).distinct(), list(keys), "left_anti")


def new_articles(delta: DataFrame, stored: DataFrame, key: str = "url") -> DataFrame:
    """Articles whose url is not stored; a null url never matches and stays."""
    return exclude_existing(delta, stored, [key])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", by=()) -> None:
    writer = df.write.mode(mode).format(fmt)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_prediction_log(df: DataFrame, path: str, time: str = "time") -> None:
    """JSON lines, one folder per UTC date."""
    write_table(df.withColumn("date", F.to_date(time)), path, "json", "append", ("date",))


def write_price_layout(df: DataFrame, path: str, unit: str = "day", buckets: int = 4, time: str = "time",
                       mode: str = "overwrite") -> None:
    """Folders per time chunk and symbol hash, sorted inside by symbol and time.

    The shuffle keys on chunk and hash; adaptive execution may split a heavy pair.
    """
    placed = df.withColumn("chunk", F.date_trunc(unit, time).cast("date")).withColumn(
        "bucket", F.pmod(F.hash("symbol"), F.lit(buckets)))
    (placed.repartition("chunk", "bucket").sortWithinPartitions("chunk", "bucket", "symbol", time)
     .write.mode(mode).partitionBy("chunk", "bucket").parquet(path))


def retention(df: DataFrame, years: int, time: str = "time") -> DataFrame:
    """Rows not older than ``years`` before the newest row."""
    kind = df.schema[time].dataType
    cut = df.agg((F.max(time) - F.expr(f"INTERVAL {years} YEARS")).cast(kind).alias("c"))
    return df.where(F.col(time) >= cut.scalar())


def save_rules(rules: DataFrame, path: str) -> None:
    rules.write.mode("overwrite").json(path)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RULE_SCHEMA).json(path)


def load_keywords(lines: DataFrame, col: str = "value") -> DataFrame:
    """Rule lines: + marks must, ! exclude, the rest general; blank and # lines skipped."""
    t = F.trim(col)
    kind = F.when(F.startswith(t, F.lit("+")), "must").when(F.startswith(t, F.lit("!")), "exclude").otherwise("general")
    kept = lines.where((F.length(t) > 0) & ~F.startswith(t, F.lit("#")))
    return kept.select(kind.alias("kind"), t.alias("_t")).select(
        "kind", F.lower(F.when(F.col("kind") == "general", F.col("_t")).otherwise(F.substring("_t", 2, 1 << 20))).alias("word"))


def keyword_lists(rules: DataFrame, most: int = 10_000) -> dict[str, list[str]]:
    """The rule table as lists for ``keyword_match``; refuses a table over ``most`` rows."""
    rows = rules.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} keyword rules")
    out = {"general": [], "must": [], "exclude": []}
    for r in rows:
        out[r["kind"]].append(r["word"])
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder next to the session's shared checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def source_fallback(quotes: DataFrame, priority=("yfinance", "alphavantage", "finnhub", "polygon", "twelvedata")):
    """Per symbol the row of the first source in the priority whose row is valid."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("source"))
    ok = F.col("symbol").isNotNull() & (F.col("price") > 0) & F.col("timestamp").isNotNull() & (place > 0)
    w = Window.partitionBy("symbol").orderBy(place, F.col("timestamp").desc())
    best = quotes.where(ok).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return best.withColumnRenamed("source", "data_source")
