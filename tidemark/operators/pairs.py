"""Two series side by side: ratios, spreads, rolling and full-sample correlation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import series as S
from tidemark.operators.base import series_operator
from tidemark.series import Series


def pair_series(df: DataFrame, a: str, b: str, col: str = "close", by: str = "symbol",
                on: str = "time") -> DataFrame:
    """Times at which both symbols have a row, with columns a and b.

    One conditional aggregate over the two symbols instead of a self-join; rows of
    one (symbol, time) are assumed unique.
    """
    picked = df.where(F.col(by).isin(a, b))
    return (
        picked.groupBy(on)
        .agg(
            F.max(F.when(F.col(by) == a, F.col(col))).alias("a"),
            F.max(F.when(F.col(by) == b, F.col(col))).alias("b"),
        )
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .withColumn("pair", F.lit(f"{a}/{b}"))
    )


def price_ratio(df: DataFrame, a: str, b: str, **kw) -> DataFrame:
    return pair_series(df, a, b, **kw).withColumn("ratio", S.ratio("a", "b"))


def real_rate(df: DataFrame, nominal: str = "nominal", inflation: str = "inflation") -> DataFrame:
    return df.withColumn("real_rate", F.col(nominal) - F.col(inflation))


@series_operator(lambda n=60, **_: n + 1)
def rolling_corr(s: Series, n: int = 60, a: str = "a", b: str = "b") -> Series:
    """Correlation of the two return series over n complete pairs."""
    s = s.add(_x_ra=S.change(s, a), _x_rb=S.change(s, b))
    return s.add(rolling_corr=S.frame_corr(s, "_x_ra", "_x_rb", n)[0])


@series_operator(lambda n=60, **_: n)
def ratio_zscore(s: Series, n: int = 60, a: str = "a", b: str = "b") -> Series:
    s = s.add(_x_r=S.ratio(a, b))
    return s.add(ratio_zscore=S.ratio(F.col("_x_r") - S.mean(s, "_x_r", n), S.std(s, "_x_r", n)))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as a mergeable aggregate; null when a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    moves = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return F.when(moves, S.ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def corr_with(df: DataFrame, ref: str, col: str = "close", by: str = "symbol", on: str = "time",
              min_rows: int = 10, dp: int | None = 4) -> DataFrame:
    """Correlation of every symbol's price level with the reference symbol's.

    The reference's price comes from the rows of the same time, so the table is read once; a symbol has one row per time.
    A huge symbol spreads over all tasks, since rows are sent by time, and the correlation combines on the map side.
    """
    here = F.max(F.when(F.col(by) == ref, F.col(col))).over(Window.partitionBy(on))
    known = F.max((F.col(by) == ref).cast("int")).over(Window.partitionBy(on))
    value = safe_corr(F.col(col), F.col("_ref"))
    if dp is not None:
        value = F.round(value, dp)
    return (
        df.select(by, on, col).where(F.col(on).isNotNull()).withColumns({"_ref": here, "_known": known}).where("_known = 1")
        .groupBy(by)
        .agg(F.count(F.lit(1)).alias("n"), value.alias("_c"))
        .select(by, "n", F.when(F.col("n") >= min_rows, F.col("_c")).alias("correlation"))
    )


PAIR_ROWS = 500_000
TILE = 700  # a block of PAIR_ROWS rows sends TILE * TILE pairs at most, so fewer rows than it reads


def pair_layout(rows: int, symbols: int, block_rows: int = PAIR_ROWS, tile: int = TILE) -> tuple[int, int]:
    """(blocks of times, groups of symbols): two groups of symbols meet in blocks of about ``block_rows`` of their rows, however
    many symbols there are, so what is sent never outgrows the rows that the groups are dealt."""
    groups = max(1, math.ceil(symbols / tile))
    return max(1, math.ceil(rows * min(1.0, 2 / groups) / block_rows)), groups


def pair_correlation(df: DataFrame, col: str, by: str = "symbol", on: str = "time", block_rows: int = PAIR_ROWS,
                     tile: int = TILE) -> DataFrame:
    """Pearson correlation of every unordered pair of symbols over their shared times.

    Times are dealt into blocks and symbols into groups, so a task multiplies a
    (times x symbols) matrix with itself and sends one row of sums per pair of its
    block, not one row per pair and time. Rows of one (symbol, time) are unique.
    """
    rows = df.where(F.col(col).isNotNull()).select(by, on, F.col(col).cast("double").alias("_x"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(by).alias("k")).first()
    blocks, groups = pair_layout(size["n"], size["k"], block_rows, tile)
    # correlation does not change with a shift; centred values keep their digits
    mean = rows.groupBy(by).agg(F.avg("_x").alias("_m"))
    rows = S.join_null_safe(rows, mean, [by]).withColumn("_x", F.col("_x") - F.col("_m")).drop("_m")
    rows = rows.withColumns({"_b": F.pmod(F.xxhash64(on), F.lit(blocks)), "_g": F.pmod(F.xxhash64(by), F.lit(groups))})
    tiles = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")),
        lambda h: F.struct(F.least(F.col("_g"), h).alias("i"), F.greatest(F.col("_g"), h).alias("j")))
    rows = rows.withColumn("_t", F.explode(tiles)).select(by, on, "_x", "_b", "_g", "_t.i", "_t.j")

    def sums(pdf):
        names, s = np.unique(pdf[by].to_numpy(dtype=object).astype(str), return_inverse=True)
        times, t = np.unique(pdf[on].to_numpy(), return_inverse=True)
        x, i, j = pdf["_x"].to_numpy(), pdf["i"].iloc[0], pdf["j"].iloc[0]
        group = np.zeros(len(names), dtype=int)
        group[s] = pdf["_g"].to_numpy()
        k = len(names)
        n, sx, sxx, sxy = (np.zeros((k, k)) for _ in range(4))
        step = max(1, 4_000_000 // k)
        order = np.argsort(t, kind="stable")
        s, t, x = s[order], t[order], x[order]
        for lo in range(0, len(times), step):
            a, b = np.searchsorted(t, [lo, lo + step])
            v, m = np.zeros((min(step, len(times) - lo), k)), np.zeros((min(step, len(times) - lo), k))
            v[t[a:b] - lo, s[a:b]], m[t[a:b] - lo, s[a:b]] = x[a:b], 1.0
            n, sx, sxx, sxy = n + m.T @ m, sx + v.T @ m, sxx + (v * v).T @ m, sxy + v.T @ v
        wanted = np.triu(n > 0, 1)
        pair = group[:, None] != group[None, :] if i != j else np.ones((k, k), dtype=bool)
        p, q = np.nonzero(wanted & pair)
        return pd.DataFrame({"a": names[p], "b": names[q], "n": n[p, q].astype("int64"), "_sa": sx[p, q], "_sb": sx[q, p],
                             "_saa": sxx[p, q], "_sbb": sxx[q, p], "_sab": sxy[p, q]})

    made = rows.groupBy("_b", "i", "j").applyInPandas(
        sums, "a string, b string, n long, _sa double, _sb double, _saa double, _sbb double, _sab double")
    total = made.groupBy("a", "b").agg(F.sum("n").alias("n"), *[
        F.sum(c).alias(c) for c in ("_sa", "_sb", "_saa", "_sbb", "_sab")])
    n = F.col("n")
    va = F.col("_saa") / n - F.pow(F.col("_sa") / n, 2)
    vb = F.col("_sbb") / n - F.pow(F.col("_sb") / n, 2)
    cov = F.col("_sab") / n - F.col("_sa") / n * (F.col("_sb") / n)
    # sums of squares leave rounding errors of their own size, so a variance counts from a share of the mean square on
    moves = (va > F.col("_saa") / n * 1e-14) & (vb > F.col("_sbb") / n * 1e-14)
    return total.select("a", "b", "n", F.when(moves, S.ratio(cov, F.sqrt(va * vb))).alias("correlation"))


def vector_pairs(df: DataFrame, limit: float, by: str = "symbol", groups: int = 16) -> DataFrame:
    """Pairs whose vectors ``_v`` (one length, nulls allowed) correlate beyond ``limit`` either way over their shared places.

    Vectors are whole in a row, so a pair of groups is complete in its task: it multiplies them ``TILE`` by ``TILE`` and
    sends the pairs found only. More ``groups`` make smaller tasks for more symbols; each vector is sent once per group.
    """
    df = df.where(F.col(by).isNotNull()).withColumn("_g", F.pmod(F.xxhash64(by), F.lit(groups)))
    tiles = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda h: F.struct(F.least("_g", h).alias("i"), F.greatest("_g", h).alias("j")))
    dealt = df.select(by, "_v", "_g", F.inline(tiles))

    def found(pdf):
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        pdf = pdf.sort_values(by)
        x = np.array([[np.nan if v is None else v for v in row] for row in pdf["_v"]], dtype=float).reshape(len(pdf), -1)
        seen = ~np.isnan(x)
        rows = np.maximum(seen.sum(1, keepdims=True), 1)
        x = np.where(seen, x, 0.0)
        x = np.where(seen, x - x.sum(1, keepdims=True) / rows, 0.0)  # centred values keep their digits
        m, names, group = seen.astype(float), pdf[by].to_numpy(dtype=object), pdf["_g"].to_numpy()
        out = []
        left, right = np.nonzero(group == i)[0], np.nonzero(group == j)[0]
        for p in range(0, len(left), TILE):
            for q in range(0, len(right), TILE):
                l, r = left[p:p + TILE], right[q:q + TILE]
                n = m[l] @ m[r].T
                k = np.maximum(n, 1)
                sa, sb = x[l] @ m[r].T / k, m[l] @ x[r].T / k
                aa, bb = (x[l] ** 2) @ m[r].T / k, m[l] @ (x[r] ** 2).T / k
                va, vb, cov = aa - sa ** 2, bb - sb ** 2, x[l] @ x[r].T / k - sa * sb
                # as in pair_correlation, a variance counts from a share of the mean square on
                c = np.where((va > aa * 1e-14) & (vb > bb * 1e-14), cov / np.sqrt(np.maximum(va * vb, 1e-300)), 0.0)
                hit = np.abs(c) > limit
                hit &= (names[l][:, None] < names[r][None, :]) if i == j else True
                a, b = np.nonzero(hit)
                one, two = names[l][a], names[r][b]
                swap = one > two
                out.append((np.where(swap, two, one), np.where(swap, one, two), n[a, b], c[a, b]))
        a, b, n, c = (np.concatenate(col) for col in zip(*out)) if out else ([], [], [], [])
        return pd.DataFrame({"a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object), "n": np.asarray(n, dtype="int64"),
                             "correlation": np.asarray(c, dtype=float)})

    return dealt.groupBy("i", "j").applyInPandas(found, "a string, b string, n long, correlation double")


def corr_matrix(df: DataFrame, symbols: list[str], col: str = "close", by: str = "symbol",
                on: str = "time") -> DataFrame:
    """All-pairs correlation over the times at which every listed symbol has a row."""
    picked = df.where(F.col(by).isin(symbols)).select(on, by, col)
    complete = (
        picked.groupBy(on).agg(F.count_distinct(by).alias("_k"))
        .where(F.col("_k") == len(set(symbols))).select(on)
    )
    return pair_correlation(picked.join(complete, on, "left_semi"), col, by, on)
