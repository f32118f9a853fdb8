"""Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair gets a score, and a record goes to its best shard. With one more shard a record either stays or goes
to the new one. Equal weights compare hashes as they are; otherwise the score is -ln(u) / weight, least wins, so a
shard's share follows its weight.

Slots number the records of a shard without gaps. A shard is cut into blocks by key hash, blocks are counted, and a record's
slot is its place in its block plus the counts of the blocks before; so no task sorts a whole shard.

All of it is DataFrame expressions, and only key, size and checksum are shuffled, never texts.

Defined results: a null key hashes like the empty string but stays null; repeated keys share their shard and get slots of
their own; a null text has no bytes; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def _best(key: Column, weights: list[float], first: int = 0, same: bool = True) -> Column:
    """(score, -shard) of the best of the shards first, first + 1, ...; ties go to the smaller number."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    ws = F.array(*[F.lit(float(w)) for w in weights])

    def score(i: Column) -> Column:
        h = F.xxhash64(i, key)
        # the unit interval in steps of 2^-53, never 0
        return h if same else F.log((F.shiftrightunsigned(h, 11) + 0.5) / float(1 << 53)) / F.get(ws, i - first)

    return F.array_max(F.transform(F.sequence(F.lit(first), F.lit(first + len(weights) - 1)), lambda i: F.struct(score(i).alias("s"), (-i).alias("i"))))


def shard(records: DataFrame, weights: list[float], key: str = "doc_id", more: float | None = None,
          blocks: int = 64) -> DataFrame:
    """``records`` (narrow rows) with shard, slot and, if ``more`` is the weight of a further shard, grown_shard."""
    if not weights or min([*weights, more or 1.0]) <= 0:
        raise ValueError("weights must be positive")
    same = len({*weights, more or weights[0]}) == 1
    # unequal weights, also of the further shard, need the weighted score for all
    won = _best(F.col(key), weights, same=same)
    keyed = records.withColumns({"__h": F.xxhash64(F.lit("slot"), F.coalesce(F.col(key).cast("string"), F.lit(""))), "__best": won})
    keyed = keyed.withColumn("shard", -F.col("__best.i"))
    new = F.when(_best(F.col(key), [more], len(weights), same)["s"] > F.col("__best.s"), F.lit(len(weights))).otherwise(F.col("shard")) if more else F.lit(None)
    keyed = keyed.withColumn("grown_shard", new.cast("int")).drop("__best")
    keyed = keyed.withColumn("__b", F.pmod("__h", F.lit(blocks)).cast("int"))
    placed = cut_lineage(keyed.withColumn("__p", F.expr("row_number() OVER (PARTITION BY shard, __b ORDER BY __h, `%s`)" % key)))
    counts = placed.groupBy("shard", "__b").agg(F.max("__p").alias("n"))  # shards x blocks rows
    before = counts.select("shard", "__b", F.expr("sum(n) OVER (PARTITION BY shard ORDER BY __b) - n").alias("__before"))
    joined = placed.join(F.broadcast(before) if len(weights) * blocks <= 100_000 else before, ["shard", "__b"])
    return joined.withColumn("slot", (F.col("__before") + F.col("__p") - 1).cast("long")).drop("__h", "__b", "__p", "__before")


def shard_documents(docs: DataFrame, n: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Document keys with size (UTF-8 bytes plus 16), checksum, law, shard, slot and the shard among one more."""
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(key), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    return shard(narrow, [1.0] * n, key, 1.0).select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
