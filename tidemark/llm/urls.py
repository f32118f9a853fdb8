"""URL rules decided by a cascade of Bloom filters.

The first filter encodes the listed keys. Keys of the corpus that it takes for listed by mistake are encoded in the
second, listed keys that the second holds by mistake in the third, and so on until no mistake is left. Over the key
universe of the corpus the answer is exact, and a page is judged without a join. Keys are host suffixes with path
prefixes, cut to the depth of the rules; rule paths must end in '/'.

All of it is DataFrame expressions. Each filter is a bit array whose size follows from the number of keys it encodes; it is
refused beyond ``max_bits``, so what travels to the tasks has a known bound.

Defined results: a null url, or one without '://', has empty host and path and meets no rule; an empty path meets no rule;
repeated rows are judged each on its own; of two fitting rules of one length the greater string wins; empty tables give
empty results; other columns pass through untouched, result columns replace columns of their name.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.char_length(url)))


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end; ASCII letters lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, labels: int, depth: int) -> Column:
    """Keys of a url: its last 1..labels host labels with each path prefix that ends in one of its first slashes."""
    n_labels = F.when(host == "", 0).otherwise(F.size(F.split(host, "\\.")))
    slashes = F.size(F.split(path, "/")) - 1
    return F.array_compact(F.array(*[
        F.when((n_labels >= n) & (slashes >= d), F.concat(F.substring_index(host, ".", -n), F.substring_index(path, "/", d), F.lit("/")))
        for n in range(1, labels + 1) for d in range(1, depth + 1)]))


@dataclass(frozen=True)
class Level:
    """A Bloom filter: ``hashes`` bits of ``size`` per key in 64-bit words."""

    number: int
    size: int
    hashes: int
    words: tuple[int, ...]

    def holds(self, key: Column) -> Column:
        bits = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        return reduce(and_, [F.getbit(F.get(bits, (p / 64).cast("int")), (p % 64).cast("int")) == 1
                             for p in positions(key, self.number, self.size, self.hashes)])


def positions(key: Column, number: int, size: int, hashes: int) -> list[Column]:
    a, b = F.xxhash64(F.lit(2 * number), key), F.xxhash64(F.lit(2 * number + 1), key)
    return [F.pmod(F.pmod(a, F.lit(size)) + F.lit(j) * F.pmod(b, F.lit(size)), F.lit(size)) for j in range(hashes)]


def _level(keys: DataFrame, number: int, count: int, rate: float, max_bits: int) -> Level:
    size = max(64, math.ceil(-count * math.log(rate) / math.log(2) ** 2))
    if size > max_bits:
        raise ValueError(f"a filter over {count} keys takes {size} bits, more than max_bits={max_bits}")
    hashes = max(1, round(size / max(count, 1) * math.log(2))) if count else 1
    hashes = min(hashes, 30)
    spread = keys.select(F.explode(F.array(*positions(F.col("key"), number, size, hashes))).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    got = spread.groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(one).alias("bits")).collect()  # size / 64 rows at most
    words = [0] * (size // 64 + 1)
    for r in got:
        words[r["w"]] = r["bits"]
    return Level(number, size, hashes, tuple(words))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def member(self, key: Column) -> Column:
        """Exact for every key of the universe: the first filter without the key decides by its parity."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def build(universe: DataFrame, first_rate: float = 1e-4, rate: float = 0.5, max_bits: int = 1 << 26,
          max_levels: int = 64) -> Cascade:
    """Cascade over ``universe`` (key, listed). The universe is read twice: for the listed keys, then for the first
    filter's mistakes; all later levels work on those two sets."""
    once = universe.groupBy("key").agg(F.max("listed").alias("listed"))
    listed = universe.where("listed").select("key").distinct()
    count = listed.count()
    if not count:
        return Cascade(())
    levels = [_level(listed, 0, count, first_rate, max_bits)]
    kept = cut_lineage(once.where(F.col("listed") | levels[0].holds(F.col("key"))))
    encoded, tested = kept.where("listed").select("key"), kept.where(~F.col("listed")).select("key")
    while (wrong := tested.count()) and len(levels) < max_levels:
        levels.append(_level(tested, len(levels), wrong, rate, max_bits))
        encoded, tested = tested, cut_lineage(encoded.where(levels[-1].holds(F.col("key"))))
    if wrong:
        raise ValueError(f"{wrong} keys left after {max_levels} levels")
    return Cascade(tuple(levels))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", **settings) -> DataFrame:
    """``pages`` with host, path, the longest fitting rule (or null) and its verdict, else ``default``.

    ``rules`` has rule (host and path, like 'example.net/en/') and verdict ('allow' or 'block').
    """
    bad = rules.where(~F.col("rule").rlike("^[^/]+/(.*/)?$") | F.col("rule").isNull() | ~F.col("verdict").isin("allow", "block") | F.col("verdict").isNull())
    size = rules.agg(F.max(F.size(F.split(F.substring_index("rule", "/", 1), "\\."))).alias("labels"),
                     F.max(F.size(F.split("rule", "/")) - 1).alias("depth")).first()
    if size["labels"] is not None and bad.limit(1).count():
        raise ValueError("rules need a host, a path that ends in '/', and the verdict allow or block")
    out = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if size["labels"] is None:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = candidate_keys(F.col("host"), F.col("path"), size["labels"], size["depth"])
    corpus = out.select(F.explode(keys).alias("key")).distinct()
    mine = rules.select(F.col("rule").alias("key"), (F.col("verdict") == "block").alias("listed")).distinct()
    any_rule = build(corpus.withColumn("listed", F.lit(False)).unionByName(mine.withColumn("listed", F.lit(True))), **settings)
    blocked = build(mine, **settings)
    fitting = F.transform(F.filter(keys, any_rule.member), lambda k: F.struct(F.char_length(k).alias("n"), k.alias("k")))
    return out.withColumn("rule", F.array_max(fitting)["k"]).withColumn(
        "verdict", F.when(F.col("rule").isNull(), F.lit(default)).when(blocked.member(F.col("rule")), F.lit("block")).otherwise(F.lit("allow")))


def rule_table(spark, block: Iterable[str], allow: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(r, "block") for r in block] + [(r, "allow") for r in allow], "rule string, verdict string")
