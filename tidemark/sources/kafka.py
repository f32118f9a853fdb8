"""Kafka topics as streams. The connector jar comes with the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Logical names of the topics.
TOPICS = {name: f"precious-metals-{name}" for name in ("prices", "news", "sentiment", "signals", "alerts")}


def physical(topic: str) -> str:
    return TOPICS.get(topic, topic)


def kafka_source(spark: SparkSession, topics, servers: str, starting: str = "latest", **options) -> DataFrame:
    """Raw records of the topics. The query's checkpoint keeps the offsets."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(map(physical, topics))).option("startingOffsets", starting)
        .options(**options).load()
    )


def decode(records: DataFrame, schema: str) -> DataFrame:
    """topic, key and the fields of the JSON value; works on streams and tables."""
    value = F.from_json(F.col("value").cast("string"), schema)
    return records.select("topic", F.col("key").cast("string").alias("key"), value.alias("_v")).select("topic", "key", "_v.*")


def envelope(df: DataFrame, topic: str, key: str, sent_at) -> DataFrame:
    """Records to send: all fields plus ``_timestamp`` and ``_key`` as JSON."""
    stamp = F.date_format(F.lit(sent_at).cast("timestamp") if isinstance(sent_at, str) else sent_at, "yyyy-MM-dd'T'HH:mm:ss")
    body = F.to_json(F.struct(*df.columns, stamp.alias("_timestamp"), F.col(key).cast("string").alias("_key")))
    return df.select(F.lit(physical(topic)).alias("topic"), F.col(key).cast("string").alias("key"), body.alias("value"))


def kafka_sink(records: DataFrame, servers: str, checkpoint: str):
    """Write enveloped records; the producer waits for all replicas and retries."""
    return (
        records.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all")
        .option("kafka.retries", "3").option("checkpointLocation", checkpoint)
    )
