"""Per-key statistics that stay exact and stay spread out when one key is huge."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import series as S


def attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-join a table with one row per key.

    No broadcast hint: adaptive execution broadcasts the aggregate when its real
    size is below the threshold and otherwise splits the skewed partitions.
    """
    return S.join_null_safe(df, per_key, list(keys))


def tail(df: DataFrame, n: int, by: Sequence[str] = ("symbol",), order: Sequence[str] = ("time",),
         back: str = "back") -> DataFrame:
    """The newest n rows per key with ``back`` = 1 for the newest.

    The row-number filter is pushed below the shuffle as a group limit, so each
    task sends at most n rows per key.
    """
    newest = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn(back, F.row_number().over(newest)).where(F.col(back) <= n)


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "row",
             max_rows: int | None = None, block_rows: int | None = None) -> DataFrame:
    """1-based position of every row in its key."""
    s = S.open_series(df, by, order, max_rows=max_rows, block_rows=block_rows)
    place = F.col(S.POS) if s.blocked else F.row_number().over(s.w)
    return s.add(**{name: place.cast("long")}).close()


def _picks(probs: dict[str, float]):
    """Per probability: name, weight of the upper neighbour, and the two position tests."""
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        low = F.floor(h)
        yield name, h - low, F.col("_at") == low + 1, F.col("_at") == F.least(low + 2, F.col("_n"))


def _small(df: DataFrame, by, max_rows, block_rows) -> bool:
    size = block_rows or int(df.sparkSession.conf.get("spark.tidemark.blockRows", str(S.BLOCK_ROWS)))
    return (S.largest_key_rows(df, by) if max_rows is None else max_rows) <= size


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ("symbol",),
              max_rows: int | None = None, block_rows: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per key, one column per entry of ``probs``.

    Picks the two neighbouring rows by position instead of collecting a key's
    values in one aggregation buffer.
    """
    by = list(by)
    kept = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    if _small(kept, by, max_rows, block_rows):
        # position and size from one sort
        key = Window.partitionBy(*by)
        rows = kept.withColumns({"_at": F.row_number().over(key.orderBy("_v")), "_n": F.count(F.lit(1)).over(key)})
    else:
        sizes = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        rows = attach(numbered(kept, by, ["_v"], "_at", max_rows, block_rows), sizes, by)
    picks = list(_picks(probs))
    wanted = functools.reduce(lambda a, b: a | b, [c for _, _, lo, hi in picks for c in (lo, hi)])
    aggs = []
    for name, part, lo, hi in picks:
        a, b = F.max(F.when(lo, F.col("_v"))), F.max(F.when(hi, F.col("_v")))
        aggs.append((a + (b - a) * F.max(part)).alias(name))
    return rows.where(wanted).groupBy(*by).agg(*aggs)


def with_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ("symbol",),
                   max_rows: int | None = None, block_rows: int | None = None) -> DataFrame:
    """Every row with a value, next to its key's quantiles."""
    by = list(by)
    df = df.where(F.col(value).isNotNull())
    if not _small(df, by, max_rows, block_rows):
        return attach(df, quantiles(df, value, probs, by, max_rows, block_rows), by)
    key, v = Window.partitionBy(*by), F.col(value).cast("double")
    df = df.withColumns({"_at": F.row_number().over(key.orderBy(value)), "_n": F.count(F.lit(1)).over(key)})
    out = {}
    for name, part, lo, hi in _picks(probs):
        a, b = F.max(F.when(lo, v)).over(key), F.max(F.when(hi, v)).over(key)
        out[name] = a + (b - a) * part
    return df.withColumns(out).drop("_at", "_n")


def average_rank(df: DataFrame, value: str, by: Sequence[str], out: str,
                 max_rows: int | None = None, block_rows: int | None = None) -> DataFrame:
    """Add the rank of ``value`` in its key, ties sharing their mean rank; null for null.

    Small keys rank inside one sort. Otherwise distinct values are ranked by the
    running total of their counts, so neither ties nor large keys meet in one task.
    """
    by = list(by)
    if _small(df, by, max_rows, block_rows):
        # nulls rank among themselves, so ranks and ties need the same sort
        keyed = df.withColumn("_some", F.col(value).isNotNull())
        ties = F.count(F.lit(1)).over(Window.partitionBy(*by, "_some", value))
        place = F.rank().over(Window.partitionBy(*by, "_some").orderBy(value))
        return keyed.withColumn(out, F.when(F.col("_some"), place + (ties - 1) / 2)).drop("_some")
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_k"))
    s = S.open_series(counts, by, (value,), max_rows=max_rows, block_rows=block_rows)
    s = S.running(s, _upto=("sum", F.col("_k")))
    ranks = s.close().select(*by, value, (F.col("_upto") - (F.col("_k") - 1) / 2).alias(out))
    return attach(df, ranks, [*by, value])


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each value, how many earlier values are smaller."""
    out = np.zeros(len(values), dtype=np.int64)
    seen = np.empty(0)
    for i in range(0, len(values), 512):
        part = values[i:i + 512]
        inside = np.tril(part[None, :] < part[:, None], -1).sum(axis=1)
        out[i:i + 512] = np.searchsorted(seen, part, "left") + inside
        seen = np.sort(np.concatenate([seen, part]), kind="stable")
    return out


def above_running_median(s: S.Series, value: str, out: str) -> S.Series:
    """Add 1 where ``value`` exceeds the median of all values up to its row, else 0.

    A value exceeds the median of a prefix it belongs to exactly when at least
    half of the prefix is smaller than it, so only counts are needed. In the
    blocked layout the smaller earlier values are counted in three parts: same
    time block (inside the block), earlier block and same value bucket (inside the
    bucket), earlier block and lower bucket (from the table of bucket counts).
    """
    s = S.running(s, _x_seen=("count", F.col(value)))

    def inside(pdf):
        got = pdf[value].notna().to_numpy()
        if S.OWN in pdf:
            got &= pdf[S.OWN].to_numpy()
        less = np.zeros(len(pdf), dtype=np.int64)
        less[got] = smaller_before(pdf[value].to_numpy(dtype=float)[got])
        return {"_x_less": less}

    s = s.later(inside, [("_x_less", "long")]).flush()
    less = F.col("_x_less")
    if s.blocked:
        s = s.with_df(S.join_null_safe(s.df, _smaller_in_earlier_blocks(s, value), [*s.by, S.POS]))
        less = less + F.coalesce("_x_earlier", F.lit(0))
    flag = F.col(value).isNotNull() & (less * 2 >= F.col("_x_seen")) & (less > 0)
    return s.add(**{out: F.when(flag, 1).otherwise(0)})


def _smaller_in_earlier_blocks(s: S.Series, value: str) -> DataFrame:
    by = list(s.by)
    own = s.df.where(F.col(S.OWN) & F.col(value).isNotNull()).select(
        *by, F.col(S.POS).alias("_row"), F.col(S.BLOCK).alias("_tb"), F.col(value).cast("double").alias("_v"))
    sizes = own.groupBy(*by, "_tb").count().agg(F.max("count")).first()[0] or 1
    ranked = numbered(own, by, ["_v"], "_vpos", block_rows=sizes)
    cells = ranked.withColumn("_vb", F.floor((F.col("_vpos") - 1) / sizes))
    counts = cells.groupBy(*by, "_tb", "_vb").agg(F.count(F.lit(1)).alias("_c"))
    ends = counts.groupBy(*by).agg(F.max("_tb").alias("_t"), F.max("_vb").alias("_u"))
    grid = (
        ends.withColumn("_tb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_t"))))
        .withColumn("_vb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_u"))))
        .drop("_t", "_u")
    )
    lower = Window.partitionBy(*by, "_tb").orderBy("_vb").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by, "_vb").orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    table = (
        S.join_null_safe(grid, counts, [*by, "_tb", "_vb"])
        .withColumn("_low", F.coalesce(F.sum(F.coalesce("_c", F.lit(0))).over(lower), F.lit(0)))
        .withColumn("_below", F.coalesce(F.sum("_low").over(earlier), F.lit(0)))
        .select(*by, "_tb", "_vb", "_below")
    )

    def in_bucket(pdf):
        pdf = pdf.sort_values("_row")
        v, tb = pdf["_v"].to_numpy(), pdf["_tb"].to_numpy()
        less = smaller_before(v)
        for t in np.unique(tb):
            mine = tb == t
            less[mine] -= smaller_before(v[mine])
        pdf["_less"] = less
        return pdf

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields)
    counted = cells.groupBy(*by, "_vb").applyInPandas(in_bucket, fields + ", _less long")
    return S.join_null_safe(counted, table, [*by, "_tb", "_vb"]).select(
        *by, F.col("_row").alias(S.POS), (F.col("_less") + F.coalesce("_below", F.lit(0))).alias("_x_earlier"))


def moments(value: str) -> dict[str, Column]:
    """mean, sample deviation, bias-corrected skew and excess kurtosis as aggregates."""
    n, v = F.count(value).cast("double"), F.col(value)
    g1, g2 = F.skewness(v), F.kurtosis(v)
    kurt = F.when(
        n > 3, S.ratio((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3))
    )
    skew = F.when(n > 2, S.ratio(F.sqrt(n * (n - 1)) * g1, n - 2))
    return {"mean": F.avg(v), "std": F.stddev_samp(v), "skew": skew, "kurt": kurt, "n": n}
