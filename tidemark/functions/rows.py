"""Filters, lookups and validation rules over rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import series as S

# Symbol lists and allowed query values.
ETFS = ["GLD", "SLV", "GDX", "GDXJ", "PPLT", "PALL"]
MINING = ["NEM", "GOLD", "AEM", "KGC", "WPM", "FNV", "RGLD", "AU"]
INDICES = ["^GSPC", "^DJI", "DX-Y.NYB"]
SYMBOLS = ["GLD", "IAU", "GLDM", "SGOL", "PHYS", "SLV", "SIVR", "PSLV", "AGQ"]
INTERVALS = ["1m", "5m", "15m", "30m", "1h", "4h", "1d", "1w", "1M"]


def date_filter(df: DataFrame, col: str, start=None, end=None) -> DataFrame:
    """Optional inclusive bounds, cast to the column's type so that they reach the scan."""
    kind = df.schema[col].dataType
    if start is not None:
        df = df.where(F.col(col) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.where(F.col(col) <= F.lit(end).cast(kind))
    return df


def newest(df: DataFrame, n: int | None = None, order=("time",), ties=()) -> DataFrame:
    out = df.orderBy(*[F.col(c).desc() for c in order], *ties)
    return out if n is None else out.limit(n)


def prices_by_symbol(df: DataFrame, symbol: str, start=None, end=None, n: int = 1000, time: str = "time") -> DataFrame:
    return newest(date_filter(df.where(F.col("symbol") == symbol), time, start, end), n, (time,))


def since(df: DataFrame, asof, days: int, symbol: str | None = None, time: str = "time") -> DataFrame:
    """Rows of the last days before ``asof``, newest first."""
    kind = df.schema[time].dataType
    out = df.where(F.col(time) >= (F.lit(asof).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")).cast(kind))
    if symbol is not None:
        out = out.where(F.col("symbol") == symbol)
    return newest(out, None, (time,))


def paginate(df: DataFrame, order, page: int = 1, per_page: int = 20) -> DataFrame:
    return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def get_by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def recent_news(df: DataFrame, n: int = 20, symbol: str | None = None, processed: bool | None = None, ties=()) -> DataFrame:
    if symbol is not None:
        df = df.where(F.array_contains("symbols", symbol))
    if processed is not None:
        df = df.where(F.col("processed") == processed)
    return newest(df, n, ("time",), ties)


def category(symbol: Column, etfs=ETFS, mining=MINING, indices=INDICES) -> Column:
    return F.when(symbol.isin(etfs), "ETF").when(symbol.isin(mining), "Mining").when(
        symbol.isin(indices), "Index").otherwise("Other")


def screener(quotes: DataFrame, min_correlation=None, max_pe=None, min_volume=None, category_name=None, sort_by=None,
             correlation: DataFrame | None = None) -> DataFrame:
    """Quotes that pass every given limit; a missing P/E passes, a missing correlation fails."""
    if category_name:
        quotes = quotes.where(F.col("category") == category_name)
    if min_volume:
        quotes = quotes.where(F.coalesce("volume", F.lit(0.0)) >= min_volume)
    if max_pe:
        quotes = quotes.where(F.coalesce(F.col("pe_ratio"), F.lit(0.0)) <= max_pe)
    if correlation is not None:
        quotes = quotes.join(correlation.select("symbol", F.col("correlation").alias("gold_correlation")), "symbol", "left")
    if min_correlation:
        quotes = quotes.where(F.coalesce(F.col("gold_correlation") >= min_correlation, F.lit(False)))
    key = {"correlation": "gold_correlation", "change_percent": "change_percent", "volume": "volume"}.get(sort_by)
    return quotes.orderBy(F.coalesce(key, F.lit(0.0)).desc()) if key else quotes


def quote_change(df: DataFrame, price: str = "price", prev: str = "previous_close") -> DataFrame:
    """Change to 4 places and percent to 2; null when a side is missing or 0."""
    known = (F.col(price) != 0) & (F.col(prev) != 0)
    diff = F.col(price) - F.col(prev)
    return df.withColumn("change", F.when(known, F.round(diff, 4))).withColumn(
        "change_pct", F.when(known, F.round(S.ratio(diff, F.col(prev)) * 100, 2)))


def with_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One boolean per rule (null counts as failed), ``is_valid`` and the failed names."""
    rules = {k: F.coalesce(c, F.lit(False)) for k, c in rules.items()}
    every = functools.reduce(lambda a, b: a & b, rules.values())
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(k)) for k, c in rules.items()]))
    return df.withColumns({**rules, "is_valid": every, "failed_rules": failed})


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("is_valid"), df.where(~F.col("is_valid"))


def valid_query(df: DataFrame, symbols=tuple(SYMBOLS), intervals=tuple(INTERVALS)) -> DataFrame:
    """Rules on symbol, interval and date order of a request table."""
    symbol, interval = F.trim(F.upper("symbol")), F.trim(F.lower("interval"))
    size = F.length("symbol")
    ordered = F.col("start_date").isNull() | F.col("end_date").isNull() | (F.col("start_date") <= F.col("end_date"))
    return with_rules(df, {
        "symbol_ok": symbol.isin(list(symbols)) & (size >= 2) & (size <= 10),
        "interval_ok": interval.isin(list(intervals)), "range_ok": ordered})


def valid_quote(df: DataFrame, asof=None) -> DataFrame:
    out = with_rules(df, {
        "symbol_ok": F.col("symbol").isNotNull(), "price_ok": F.col("price") > 0,
        "timestamp_ok": F.col("timestamp").isNotNull()})
    if asof is None:
        return out
    old = F.col("timestamp") < F.lit(asof).cast("timestamp") - F.expr("INTERVAL 24 HOURS")
    return out.withColumn("is_stale", F.coalesce(old, F.lit(False)))


def valid_articles(df: DataFrame) -> DataFrame:
    def size(c):
        return F.length(F.coalesce(c, F.lit("")))

    return df.where((size("title") > 0) & (size("url") > 0) & ~((size("content") < 50) & (size("title") < 20)))


def is_fresh(ts: Column, asof, max_age_minutes: int = 60) -> Column:
    ok = ts >= F.lit(asof).cast("timestamp") - F.expr(f"INTERVAL {max_age_minutes} MINUTES")
    return F.coalesce(ok, F.lit(False))


def quality_report(df: DataFrame, required=("time", "symbol", "close"), limit: float = 0.2, **layout) -> DataFrame:
    """One row: missing columns, null closes, extreme changes and duplicate keys."""
    missing = [c for c in required if c not in df.columns]
    s = S.open_series(df, back=1, **layout)
    moves = s.add(_r=S.change(s, "close")).close().agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("close").isNull()).alias("null_close"),
        F.count_if(F.abs("_r") > limit).alias("extreme_changes"))
    dup = df.groupBy("symbol", "time").count().agg(F.count_if(F.col("count") > 1).alias("d"))
    out = moves.withColumn("duplicate_keys", dup.scalar()).withColumn(
        "missing_columns", F.lit(len(missing)).cast("long"))
    bad = F.col("null_close") + F.col("extreme_changes") + F.col("duplicate_keys") + F.col("missing_columns")
    return out.withColumn("is_valid", (bad == 0) & (F.col("rows") > 0))


def adhoc_select(spark, sql: str) -> DataFrame:
    """Run a statement only if it starts with select."""
    if not sql.strip().lower().startswith("select"):
        raise ValueError("only select statements are allowed")
    return spark.sql(sql)


def url_dedup(df: DataFrame, order, key: str = "url") -> DataFrame:
    """The first row per url; combines on the map side."""
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(first.alias("_f")).select(key, "_f.*")
