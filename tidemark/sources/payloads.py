"""Landed vendor payloads (JSON text) as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X

# Payload keys.
DAILY_KEYS = [("open", "1. open"), ("high", "2. high"), ("low", "3. low"), ("close", "4. close"),
              ("adjusted_close", "5. adjusted close"), ("volume", "6. volume"), ("dividend", "7. dividend amount"),
              ("split_coefficient", "8. split coefficient")]
METALS = {"XAU": "gold", "XAG": "silver", "XPT": "platinum", "XPD": "palladium"}


def parse_daily_series(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per date of a series keyed by date; entries with a bad or missing number are dropped."""
    series = F.from_json(F.get_json_object(payload, "$['Time Series (Daily)']"), "map<string,map<string,string>>")
    rows = df.select("symbol", F.explode(series).alias("_d", "_v"))
    cols = {n: F.try_element_at("_v", F.lit(k)).try_cast("bigint" if n == "volume" else "double") for n, k in DAILY_KEYS}
    out = rows.select("symbol", F.col("_d").try_cast("date").alias("date"), *[c.alias(n) for n, c in cols.items()])
    return out.dropna(subset=["date", *cols])


def parse_quote(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Typed quote; missing numbers are 0, a bad number or an empty quote drops the row."""
    quote = F.from_json(F.get_json_object(payload, "$['Global Quote']"), "map<string,string>")
    rows = df.select("symbol", quote.alias("_q")).where(F.size("_q") > 0)

    def num(key, kind="double", default="0"):
        raw = F.coalesce(F.try_element_at("_q", F.lit(key)), F.lit(default))
        return F.regexp_replace(raw, "%+$", "").try_cast(kind)

    cols = {"price": num("05. price"), "volume": num("06. volume", "bigint"), "previous_close": num("08. previous close"),
            "change": num("09. change"), "change_percent": num("10. change percent")}
    return rows.select("symbol", *[c.alias(n) for n, c in cols.items()]).dropna(subset=list(cols))


def parse_observations(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(time, value, series_id, series_name); values that are no number are dropped."""
    obs = F.from_json(F.get_json_object(payload, "$.observations"), "array<struct<date:string,value:string>>")
    rows = df.select("series_id", "series_name", F.explode(obs).alias("_o"))
    return rows.select(F.col("_o.date").try_cast("date").alias("time"), F.col("_o.value").try_cast("double").alias("value"),
                       "series_id", "series_name").dropna(subset=["time", "value"])


ARTICLE = ("array<struct<title:string,description:string,snippet:string,source:string,url:string,author:string,"
           "published_at:string>>")


def parse_articles(df: DataFrame, asof, payload: str = "payload", keywords=tuple(X.GOLD + X.SILVER + X.METALS)) -> DataFrame:
    """Articles with id, time, cleaned texts, keywords and symbol."""
    items = F.from_json(F.get_json_object(payload, "$.data"), ARTICLE)
    rows = df.select(F.explode(items).alias("_a")).select("_a.*")

    def s(c):
        return F.coalesce(c, F.lit(""))

    body = F.when(F.col("description") != "", F.col("description")).otherwise(F.col("snippet"))
    return rows.select(
        X.article_id(F.col("title"), F.col("source"), F.col("published_at")).alias("article_id"),
        F.coalesce(F.try_to_timestamp("published_at"), F.lit(asof).cast("timestamp")).alias("time"),
        X.clean_text(F.col("title")).alias("title"), X.clean_text(body).alias("content"),
        s("source").alias("source"), s("url").alias("url"), "author",
        X.extract_keywords(F.concat(s("title"), F.lit(" "), s("description")), keywords).alias("keywords"),
        X.determine_symbol(F.col("title")).alias("symbol"), F.lit("en").alias("language"))


def shape_rss(df: DataFrame, asof, keywords=()) -> DataFrame:
    """Feed entries: published, else updated, else asof; any keyword in title or summary."""
    when = F.coalesce("published", "updated", F.lit(asof).cast("timestamp"))

    def s(c):
        return F.coalesce(c, F.lit(""))

    out = df.select(
        s("title").alias("title"), s("summary").alias("content"), s("link").alias("url"),
        F.coalesce("feed_title", F.lit("RSS Feed")).alias("source"), when.alias("published_at"),
        F.lit(None).cast("string").alias("image_url"), F.lit("RSS").alias("fetch_source"))
    if not keywords:
        return out
    return out.where(X.has_any(F.lower(F.concat("title", F.lit(" "), "content")), keywords))


def shape_posts(df: DataFrame) -> DataFrame:
    return df.select(
        "title", F.col("selftext").alias("content"), "url", F.concat(F.lit("Reddit/r/"), "subreddit").alias("source"),
        F.timestamp_seconds("created_utc").alias("published_at"), F.lit(None).cast("string").alias("image_url"),
        F.lit("Reddit").alias("fetch_source"))


def explode_rates(df: DataFrame, rates: str = "rates") -> DataFrame:
    """One row per known metal code; price is 1/rate, 0 when the rate is 0 or null."""
    names = F.create_map(*[F.lit(x) for kv in METALS.items() for x in kv])
    rows = df.select("timestamp", F.explode(rates).alias("_code", "_rate"))
    price: Column = F.coalesce(F.try_divide(F.lit(1.0), F.col("_rate").cast("double")), F.lit(0.0))
    out = rows.select(F.try_element_at(names, F.col("_code")).alias("metal"), price.alias("price"), "timestamp",
                      F.lit("Metals-API").alias("source"))
    return out.where(F.col("metal").isNotNull())
