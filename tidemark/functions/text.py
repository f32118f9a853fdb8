"""Text expressions: cleaning, keyword rules, lexicon sentiment, JSON replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keyword lists.
GOLD = ["gold", "gold price", "gold market", "bullion", "GLD", "gold ETF", "XAUUSD", "gold futures",
        "Federal Reserve gold", "central bank gold"]
SILVER = ["silver", "silver price", "silver market", "SLV", "silver ETF", "XAGUSD", "silver futures"]
METALS = ["precious metals", "safe haven", "inflation hedge", "treasury yields", "dollar weakness",
          "geopolitical risk"]
GOLD_TICKERS = ["gld", "iau", "gldm", "sgol"]
SILVER_TICKERS = ["slv", "sivr", "agq"]
BULLISH = ["surge", "rally", "rise", "bullish", "gain", "record high", "safe haven", "inflation", "uncertainty",
           "central bank buying"]
BEARISH = ["fall", "drop", "decline", "bearish", "loss", "sell-off", "dollar strength", "rate hike", "risk-on"]
ENTITIES = ["fed", "federal reserve", "ecb", "china", "india", "gld", "slv", "comex", "lbma"]


def has_any(low: Column, words: Sequence[str]) -> Column:
    """Whether the lower-cased text contains one of the words; stays in generated code."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w.lower()))
    return out


def hit_count(low: Column, words: Sequence[str]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + F.contains(low, F.lit(w.lower())).cast("int")
    return out


def hits(low: Column, words: Sequence[str], shown=lambda w: w) -> Column:
    """The contained words, in list order."""
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w.lower())), F.lit(shown(w))) for w in words]))


def article_id(title: Column, source: Column, published: Column) -> Column:
    def s(c):
        return F.coalesce(c.cast("string"), F.lit(""))

    return F.left(F.md5(F.concat(s(title), s(source), s(published))), F.lit(16))


def doc_id(text: Column) -> Column:
    return F.md5(text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_text(text: Column) -> Column:
    """Without tags, single spaces, trimmed; empty for null."""
    return F.coalesce(squeeze(F.regexp_replace(text, "<[^>]+>", "")), F.lit(""))


def clean_for_scoring(text: Column, limit: int = 1000) -> Column:
    """Single spaces; over ``limit`` characters cut and marked, as the scorer's input is defined."""
    t = F.coalesce(squeeze(text), F.lit(""))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def combine(title: Column, content: Column) -> Column:
    def full(c):
        return F.when(c != "", c)

    return F.concat_ws(" ", full(title), full(content))


def keyword_match(text: Column, general: Sequence[str], must: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """No excluded word, at least one general word, and one must word if there are any."""
    low = F.lower(text)
    ok = ~has_any(low, exclude) & has_any(low, general)
    if must:
        ok = ok & has_any(low, must)
    return F.coalesce(ok, F.lit(False))


def extract_keywords(text: Column, words: Sequence[str] = tuple(GOLD + SILVER + METALS), limit: int = 10) -> Column:
    """Distinct listed phrases in the text, sorted, at most ``limit``."""
    return F.slice(F.array_sort(F.array_distinct(hits(F.lower(text), words))), 1, limit)


def determine_symbol(text: Column, gold=GOLD, silver=SILVER, gold_tickers=GOLD_TICKERS, silver_tickers=SILVER_TICKERS):
    """Tickers decide first, then the majority of phrases; ties go to gold."""
    low = F.lower(text)
    g, s = hit_count(low, gold), hit_count(low, silver)
    return (
        F.when(has_any(low, gold_tickers), "GLD").when(has_any(low, silver_tickers), "SLV")
        .when(g > s, "GLD").when(s > g, "SLV").when(g > 0, "GLD")
    )


def lexicon_sentiment(df: DataFrame, title: str = "title", content: str = "content", bullish=BULLISH, bearish=BEARISH,
                      entities=ENTITIES) -> DataFrame:
    """Score, label, confidence and entities by counting phrases in title and content."""
    df = df.withColumn("_low", F.lower(F.concat(
        F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))))
    df = df.withColumns({"_up": hit_count(F.col("_low"), bullish), "_down": hit_count(F.col("_low"), bearish)})
    up, down = F.col("_up"), F.col("_down")
    return df.withColumns({
        "sentiment_score": F.when(up > down, F.least(F.lit(0.8), 0.3 + up * 0.1))
        .when(down > up, F.greatest(F.lit(-0.8), -0.3 - down * 0.1)).otherwise(0.0),
        "sentiment_label": F.when(up > down, "bullish").when(down > up, "bearish").otherwise("neutral"),
        "confidence": F.lit(0.6),
        "entities": F.slice(hits(F.col("_low"), entities, str.upper), 1, 5),
    }).drop("_low", "_up", "_down")


def probs_to_label(p_pos: Column, p_neg: Column, p_neu: Column) -> dict[str, Column]:
    """score, label of the highest probability (first on ties) and that probability."""
    top = F.greatest(p_pos, p_neg, p_neu)
    label = F.when(p_pos == top, "positive").when(p_neg == top, "negative").otherwise("neutral")
    return {"score": p_pos - p_neg, "label": label, "confidence": top}


def needs_second_scorer(confidence: Column, neutral: Column, force: bool = False) -> Column:
    return F.lit(True) if force else (confidence < 0.6) | (neutral > 0.4)


def split_by_route(df: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    need = needs_second_scorer(F.col("confidence"), F.col("p_neu"), force)
    return df.where(need), df.where(~need)


def combine_scores(s1: Column, c1: Column, l1: Column, s2: Column, c2: Column) -> dict[str, Column]:
    """Confidence-weighted mean of two scorers; the first alone where the second is null."""
    w1, w2 = c1, c2 * 1.2
    both = s2.isNotNull()
    x = F.try_divide(s1 * w1 + s2 * w2, w1 + w2)
    label = F.when(x > 0.15, "bullish").when(x < -0.15, "bearish").otherwise("neutral")
    return {
        "score": F.when(both, x).otherwise(s1), "label": F.when(both, label).otherwise(l1),
        "confidence": F.when(both, (c1 + c2) / 2).otherwise(c1),
        "source": F.when(both, "hybrid").otherwise("first_only"),
        "first_weight": F.when(both, F.try_divide(w1, w1 + w2)), "second_weight": F.when(both, F.try_divide(w2, w1 + w2)),
    }


REPLY = ("sentiment_score string, sentiment_label string, confidence string, key_factors array<string>, "
         "market_impact string, reasoning string, entities array<string>, time_horizon string")


def parse_scored_reply(text: Column) -> Column:
    """A scorer's JSON reply as a typed struct; defaults for missing fields, a neutral
    low-confidence row for text that is no JSON object or has a bad number."""
    good = F.try_parse_json(text)
    r = F.from_json(text, REPLY)
    score = r["sentiment_score"].try_cast("double")
    conf = r["confidence"].try_cast("double")
    bad = (
        good.isNull() | text.isNull()
        | (r["sentiment_score"].isNotNull() & score.isNull()) | (r["confidence"].isNotNull() & conf.isNull())
    )
    none = F.array().cast("array<string>")

    def pick(c, default, error):
        return F.when(bad, F.lit(error)).otherwise(F.coalesce(c, F.lit(default)))

    return F.struct(
        pick(score, 0.0, 0.0).alias("sentiment_score"),
        pick(r["sentiment_label"], "neutral", "neutral").alias("sentiment_label"),
        pick(conf, 0.5, 0.3).alias("confidence"),
        F.when(bad, none).otherwise(F.coalesce(r["key_factors"], none)).alias("key_factors"),
        pick(r["market_impact"], "medium", "low").alias("market_impact"),
        pick(r["reasoning"], "", "Error parsing response").alias("reasoning"),
        F.when(bad, none).otherwise(F.coalesce(r["entities"], none)).alias("entities"),
        pick(r["time_horizon"], "short_term", "short_term").alias("time_horizon"),
    )


def robust_json(text: Column) -> Column:
    """The JSON inside a reply: the whole text, a fenced block, or first { to last }."""
    def valid(c):
        return F.when(F.try_parse_json(c).isNotNull(), c)

    fenced = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)\s*```", 1)
    start = F.instr(text, "{")
    stop = F.length(text) - F.instr(F.reverse(text), "}") + 1
    braces = F.when((start > 0) & F.contains(text, F.lit("}")) & (stop >= start), F.substring(text, start, stop - start + 1))
    return F.coalesce(valid(text), valid(F.when(fenced != "", fenced)), valid(braces))


def time_decay(ts: Column, asof, days: float = 30.0, exp=F.exp) -> Column:
    """exp(-whole days of age / days); 0.5 for text that is no timestamp. ``exp`` may be a closer one than the JVM's."""
    when = F.try_to_timestamp(ts.cast("string"))
    age = F.floor((F.unix_seconds(F.lit(asof).cast("timestamp")) - F.unix_seconds(when)) / 86400)
    return F.coalesce(exp(-age / F.lit(float(days))), F.lit(0.5))


def mask(value: Column, n: int = 4) -> Column:
    short = value.isNull() | (F.length(value) <= 2 * n)
    return F.when(short, "***").otherwise(F.concat(F.left(value, F.lit(n)), F.lit("***"), F.right(value, F.lit(n))))
