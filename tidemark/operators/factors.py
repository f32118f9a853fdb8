"""Multi-factor scores: factor columns, normalisation, weighted score, rank correlation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import series as S
from tidemark.functions.stats import attach, average_rank
from tidemark.operators import momentum, trend
from tidemark.operators.pairs import safe_corr
from tidemark.operators.volatility import YEAR

# Factor name, weight, direction.
FACTORS = [
    ("pe_ratio", 0.10, -1), ("pb_ratio", 0.08, -1), ("ps_ratio", 0.07, -1),
    ("dividend_yield", 0.10, 1), ("ev_ebitda", 0.08, -1),
    ("revenue_growth_yoy", 0.12, 1), ("earnings_growth_yoy", 0.12, 1), ("roe", 0.10, 1), ("roa", 0.08, 1),
    ("profit_margin", 0.08, 1), ("debt_to_equity", 0.06, -1), ("current_ratio", 0.06, 1),
    ("interest_coverage", 0.06, 1),
    ("return_1m", 0.12, 1), ("return_3m", 0.10, 1), ("return_6m", 0.08, 1), ("return_12m", 0.06, 1),
    ("rsi", 0.08, -1), ("macd_signal", 0.08, 1), ("bb_position", 0.06, 1), ("volume_surge", 0.08, 1),
    ("volatility_20d", 0.06, -1), ("beta", 0.05, -1),
    ("gold_correlation", 0.15, 1), ("gold_beta", 0.12, 1), ("correlation_stability", 0.08, 1),
]

PRICE_FACTORS = ["return_1m", "return_3m", "return_6m", "return_12m", "rsi", "macd_signal", "bb_position",
                 "volume_surge", "volatility_20d"]
GOLD_FACTORS = ["gold_correlation", "gold_beta", "correlation_stability"]
PASSED = ("pe_ratio", "pb_ratio", "dividend_yield", "roe")


def _frames(values: np.ndarray, n: int):
    """(first row, frames) of n values each, some rows at a time."""
    step = max(1, 4_000_000 // n)
    for i in range(0, len(values) - n + 1, step):
        yield i, np.lib.stride_tricks.sliding_window_view(values[i : i + step + n - 1], n)


def _gold_columns(pdf, n: int = 60) -> dict:
    """Correlation with gold over n complete pairs, its beta, and how steady the correlation was over n rows. A frame in
    which a side does not move has no correlation. In the pandas pass a frame costs n products, not n aggregate updates."""
    x, g = (pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in ("_r", "_g"))
    gone = np.isnan(x) | np.isnan(g)
    both = np.where(gone, np.nan, x), np.where(gone, np.nan, g)
    corr, beta, steady = (np.full(len(x), np.nan) for _ in range(3))
    with np.errstate(invalid="ignore", divide="ignore"):
        for (i, a), (_, b) in zip(_frames(both[0], n), _frames(both[1], n)):
            rows = slice(i + n - 1, i + n - 1 + len(a))
            da, db = a - a.mean(axis=1)[:, None], b - b.mean(axis=1)[:, None]
            cov, va, vb = (da * db).sum(axis=1), (da * da).sum(axis=1), (db * db).sum(axis=1)
            moves_a, moves_b = a.max(axis=1) > a.min(axis=1), b.max(axis=1) > b.min(axis=1)
            corr[rows] = np.where(moves_a & moves_b, cov / np.sqrt(va * vb), np.nan)
            beta[rows] = np.where(moves_b, cov / vb, np.nan)
        for i, c in _frames(corr, n):
            steady[i + n - 1 : i + n - 1 + len(c)] = -c.std(axis=1, ddof=1)
    return dict(zip(GOLD_FACTORS, (corr, beta, steady)))


def with_reference(prices: DataFrame, symbol: str, by: str = "symbol", on: str = "time", col: str = "close", out: str = "gold_price") -> DataFrame:
    """Adds the reference symbol's price at the same time, taken from the same rows: the prices are built once."""
    return prices.withColumn(out, F.max(F.when(F.col(by) == symbol, F.col(col))).over(Window.partitionBy(on)))


def calculate_factors(prices: DataFrame, gold: DataFrame | None = None, by=("symbol",), order=("time",),
                      max_rows: int | None = None, block_rows: int | None = None) -> DataFrame:
    """Factor columns for every row.

    ``gold`` has one row per time with ``gold_price``; the column may be in ``prices`` already
    (``with_reference``). Fundamental columns of ``prices`` pass through; revenue and earnings give their change over 4 rows.
    """
    if gold is not None:
        prices = attach(prices, gold.select(order[0], "gold_price"), [order[0]])
    gold = "gold_price" in prices.columns
    s = S.open_series(prices, by, order, back=max(trend.macd.reach(), 253), max_rows=max_rows,
                      block_rows=block_rows)
    spans = {"return_1m": 21, "return_3m": 63, "return_6m": 126, "return_12m": 252}
    s = s.add(**{k: S.change(s, "close", n) for k, n in spans.items()}, _r=S.change(s, "close"))
    kept = list(s.df.columns)
    s, rsi = momentum.rsi_columns(s, 14)
    s = trend.bollinger.on(s)
    low, high = F.col("bb_lower"), F.col("bb_upper")
    s = s.add(
        rsi=rsi,
        bb_position=S.ratio(F.col("close") - low, high - low),
        volume_surge=S.ratio(F.col("volume"), S.mean(s, "volume", 20)),
        volatility_20d=S.std(s, "_r", 20) * YEAR,
    )
    kept += ["rsi", "bb_position", "volume_surge", "volatility_20d", "macd_signal"]
    if gold:
        s = s.add(_g=S.change(s, "gold_price")).later(_gold_columns, [(c, "double") for c in GOLD_FACTORS])
        kept += GOLD_FACTORS
    for src, out in (("revenue", "revenue_growth_yoy"), ("earnings", "earnings_growth_yoy")):
        if src in s.df.columns:
            s = s.add(**{out: S.change(s, src, 4)})
            kept.append(out)
    s = trend.macd.on(s).flush()
    s = s.add(macd_signal=F.col("macd") - F.col("macd_signal"))
    helpers = [c for c in (S.POS, S.BLOCK, S.OWN) if s.blocked]
    return s.with_df(s.df.select(*dict.fromkeys([*kept, *helpers]))).close("_r")


def normalize_factors(df: DataFrame, cols, method: str = "z_score", by=("symbol",),
                      max_rows: int | None = None, block_rows: int | None = None) -> DataFrame:
    """Scale each factor over its whole series and cut at -3 and 3."""
    cols = list(cols)
    if method == "rank":
        out = _rank_all(df, cols, by, max_rows, block_rows)
    else:
        lo, span = {
            "z_score": (F.avg, F.stddev_samp),
            "min_max": (F.min, lambda c: F.max(c) - F.min(c)),
        }[method]
        stats = df.groupBy(*by).agg(*[lo(c).alias(f"_lo_{c}") for c in cols],
                                    *[span(c).alias(f"_sp_{c}") for c in cols])
        out = attach(df, stats, by)
        out = out.withColumns({c: S.ratio(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_sp_{c}")) for c in cols})
        out = out.drop(*[f"{p}{c}" for c in cols for p in ("_lo_", "_sp_")])

    def cut(c):
        return F.when(F.col(c).isNotNull(), F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.col(c))))

    return out.withColumns({c: cut(c) for c in cols})


def _rank_all(df, cols, by, max_rows, block_rows):
    """Average-tie percent ranks of all factors: one row per value, one sort for all factors, one regrouping."""
    rest = [c for c in df.columns if c not in cols and c not in by]
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    melted = numbered.select(*by, "_row", F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])).alias("_f", "_v"),
                             F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))
    # other columns travel with one factor's row only
    melted = melted.withColumn("_rest", F.when(F.col("_f") == 0, F.col("_rest")))
    ranked = average_rank(melted, "_v", [*by, "_f"], "_r", max_rows, block_rows)
    if max_rows is not None and max_rows <= (block_rows or S.BLOCK_ROWS):
        sized = ranked.withColumn("_n", F.count("_v").over(Window.partitionBy(*by, "_f")))
    else:
        sized = attach(ranked, melted.groupBy(*by, "_f").agg(F.count("_v").alias("_n")), [*by, "_f"])
    value = S.ratio("_r", "_n")
    out = sized.groupBy(*by, "_row").agg(F.first("_rest", ignorenulls=True).alias("_rest"), *[F.max(F.when(F.col("_f") == i, value)).alias(c) for i, c in enumerate(cols)])
    return out.select(*[F.col(f"_rest.{c}").alias(c) if c in rest else c for c in df.columns])


def composite_score(df: DataFrame, weights: dict[str, float] | None = None, out: str = "composite_score"):
    """Sum of weight x direction x factor; null when any used factor is null."""
    direction = {n: d for n, _, d in FACTORS}
    weights = weights or {n: w for n, w, _ in FACTORS}
    score = F.lit(0.0)
    for name, w in weights.items():
        if name in df.columns:
            score = score + F.col(name) * direction.get(name, 1) * w
    return df.withColumn(out, score)


def factor_ic(df: DataFrame, cols, returns: str = "forward_return", periods=(5, 10, 20), by=("symbol",),
              order=("time",), max_rows: int | None = None, block_rows: int | None = None) -> DataFrame:
    """Spearman correlation of each factor with later returns, summarised per period."""
    s = S.open_series(df, by, order, ahead=max(periods), max_rows=max_rows, block_rows=block_rows)
    s = s.add(**{f"_f_{p}": S.lead(s, returns, p) for p in periods})
    pairs = F.array(*[
        F.struct(F.lit(p).alias("period"), F.lit(c).alias("factor"), F.col(c).cast("double").alias("x"),
                 F.col(f"_f_{p}").cast("double").alias("y"))
        for p in periods for c in cols
    ])
    key = [*by, "period", "factor"]
    rows = s.close().select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.*")
    # rows without a pair keep their factor in the count but have no rank
    some = F.col("x").isNotNull() & F.col("y").isNotNull()
    rows = rows.withColumns({"x": F.when(some, F.col("x")), "y": F.when(some, F.col("y"))})
    rows = average_rank(rows, "x", key, "rx", max_rows, block_rows)
    rows = average_rank(rows, "y", key, "ry", max_rows, block_rows)
    ic = rows.groupBy(*key).agg(safe_corr(F.col("rx"), F.col("ry")).alias("ic"))
    return (
        ic.groupBy(*by, "period")
        .agg(
            F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"),
            S.ratio(F.sum(F.when(F.col("ic") > 0, 1).otherwise(0)), F.count(F.lit(1))).alias("ic_positive_ratio"),
        )
        .withColumn("ic_ir", F.when(F.col("ic_std") != 0, S.ratio("ic_mean", "ic_std")).when(
            F.col("ic_std") == 0, F.lit(0.0)))
    )
