"""Registered queries: title de-duplication, retrieval, learning, hooks."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tidemark.operators import dedup as DD
from tidemark.operators import features as FE
from tidemark.operators import hooks as HK
from tidemark.operators import learning as ML
from tidemark.operators import performance as PF
from tidemark.operators import retrieval as RT
from tidemark.operators import signals as SG
from tidemark.plans import views as V
from tidemark.plans.registry import query
from tidemark.plans.sqlparts import avg
from tidemark.plans.views import BARS, NEWS, VECTORS
from tidemark.session import cut_lineage
from tidemark.sources import tables as TB

# --- titles -------------------------------------------------------------------------
STOP = "[" + ", ".join(f"'{w}'" for w in DD.STOP_WORDS) + "]"
TFIDF = NEWS + f""", wd AS (SELECT doc_id, list_filter(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}\\p{{M}}_]{{2,}}'), lambda w: NOT list_contains({STOP}, w)) AS w FROM news),
tm AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) AS term FROM wd),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tm GROUP BY 1, 2), dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
rw AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM news)) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM tf JOIN dfq USING (term)),
nw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM rw),
ed AS (SELECT a.doc_id AS a, b.doc_id AS b FROM nw a JOIN nw b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING sum(a.w * b.w) > 0.8),
nb AS (SELECT b AS doc_id, list(a) AS earlier FROM ed GROUP BY 1),
od AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, earlier FROM nb),
gr AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS dropped UNION ALL
  SELECT o.k, CASE WHEN len(list_filter(o.earlier, lambda x: NOT list_contains(g.dropped, x))) > 0 THEN list_append(g.dropped, o.doc_id) ELSE g.dropped END FROM gr g JOIN od o ON o.k = g.k + 1)"""
query("v01_tfidf_dedup", "doc_id", ctes="RECURSIVE " + TFIDF, sql="SELECT doc_id FROM news WHERE doc_id NOT IN (SELECT unnest(dropped) FROM gr WHERE k = (SELECT max(k) FROM gr))")(
    lambda s, d: DD.tfidf_dedup(V.news(s, d).select("doc_id", "title")))

# --- retrieval -----------------------------------------------------------------------


def _centroids(s, d):
    """One query per label: the mean vector of all its stored vectors."""
    v = V.vectors(s, d).select("label", F.posexplode("embedding").alias("i", "x"))
    mean = v.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    return mean.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("query"))


CEN = VECTORS + """, ex AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM vectors),
ce AS (SELECT label AS query_id, list(x ORDER BY i) AS q FROM (SELECT label, i, round(avg(x), 6) AS x FROM ex GROUP BY 1, 2) z GROUP BY 1),
ds AS (SELECT query_id, vec_id, time, pow(list_distance(CAST(embedding AS DOUBLE[]), q), 2) AS distance FROM vectors, ce),
nk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM ds)"""


def _found(s, d, k):
    return RT.nearest(V.vectors(s, d), _centroids(s, d), k)


query("v03_vector_topk", "query_id vec_id | distance | rank", dp=5, ctes=CEN, sql="SELECT query_id, vec_id, distance, rank FROM nk WHERE rank <= 20")(
    lambda s, d: _found(s, d, RT.candidates(10, 20)))
query("v06_knowledge_topk", "query_id vec_id | distance | rank", dp=5, ctes=CEN, sql="SELECT query_id, vec_id, distance, rank FROM nk WHERE rank <= 3")(
    lambda s, d: _found(s, d, 3))
AGE = "2024-02-01 00:00:00"
DEC = CEN + f""", dc AS (SELECT query_id, vec_id, distance AS original_distance, distance / (exp(-floor((epoch(TIMESTAMP '{AGE}') - epoch(time)) / 86400) / 30) + 0.1) AS distance FROM nk WHERE rank <= 20),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM dc)"""


def _decayed(s, d):
    got = _found(s, d, 20).drop("rank").join(V.vectors(s, d).select("vec_id", "time"), "vec_id")
    return RT.decay_rerank(got, F.date_format("time", "yyyy-MM-dd HH:mm:ss"), AGE, 30)


query("v04_decay_rerank", "query_id vec_id | distance original_distance | rank", dp=5, ctes=DEC, sql="SELECT query_id, vec_id, distance, original_distance, rank FROM dr")(_decayed)
# one row is picked per step from at most 20 per query: the best mix of closeness and distance from the rows picked before
MMR = "RECURSIVE " + DEC + """, ml AS (SELECT query_id, list({'k': rank, 'v': vec_id, 'd': distance} ORDER BY rank) AS f FROM dr GROUP BY 1),
mp AS (SELECT query_id, f, CAST([1] AS BIGINT[]) AS got FROM ml
  UNION ALL SELECT query_id, f, list_append(got, list_sort(list_transform(list_filter(f, lambda x: NOT list_contains(got, x.k)),
      lambda x: {'s': -(0.5 * (1 - x.d) + (1 - 0.5) * list_min(list_transform(got, lambda j: abs(x.d - f[j].d)))), 'k': x.k}))[1].k) FROM mp WHERE len(got) < least(10, len(f))),
mx AS (SELECT query_id, f, unnest(got) AS k, unnest(range(1, len(got) + 1)) AS pick FROM mp WHERE len(got) = least(10, len(f)))"""
query("v05_mmr", "query_id vec_id | distance | pick", dp=5, ctes=MMR, sql="SELECT query_id, f[k].v AS vec_id, f[k].d AS distance, pick FROM mx")(lambda s, d: RT.mmr(_decayed(s, d), 10, 0.5))


def _collection(s, d):
    n = V.news(s, d)
    return RT.documents(n, "news", F.col("url"), F.col("title"), F.col("content"), F.col("time"))


query("v07_upsert_document", "id text type title", ctes=NEWS, sql="SELECT md5(url) AS id, CASE WHEN min(doc_id) % 2 = 0 THEN 'stored' ELSE arg_min(concat(title, chr(10), chr(10), content), doc_id) END AS text, 'news' AS type, arg_min(title, doc_id) AS title FROM news GROUP BY url")(
    lambda s, d: TB.insert_ignore(_stored(s, d), _first_per_url(s, d), ["id"]))


def _stored(s, d):
    """Half of the urls are in the collection already, under the same ids and with another text."""
    first = V.news(s, d).groupBy("url").agg(F.min("doc_id").alias("least")).where("least % 2 = 0").select("url")
    held = V.news(s, d).groupBy("url").agg(F.min_by(F.struct("title", "content", "time"), "doc_id").alias("f")).select("url", "f.*").join(first, "url")
    return RT.documents(held, "news", F.col("url"), F.col("title"), F.col("content"), F.col("time")).withColumn("text", F.lit("stored"))


def _first_per_url(s, d):
    n = V.news(s, d).groupBy("url").agg(F.min_by(F.struct("title", "content", "time"), "doc_id").alias("f")).select("url", "f.*")
    return RT.documents(n, "news", F.col("url"), F.col("title"), F.col("content"), F.col("time"))


def _hits(s, d):
    near = _found(s, d, 6).withColumn("section", F.when(F.col("rank") <= 2, "report").when(F.col("rank") <= 4, "news").otherwise("knowledge"))
    docs = V.table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("title"), F.col("text").alias("content"))
    return near.join(docs, "vec_id").withColumn("stamp", F.lit("2024-01-01"))


CTX = CEN + """, ht AS (SELECT query_id, rank, distance, source AS title, text AS content, CASE WHEN rank <= 2 THEN 1 WHEN rank <= 4 THEN 2 ELSE 3 END AS p FROM nk JOIN documents ON doc_id = vec_id WHERE rank <= 6),
pc AS (SELECT query_id, p, rank, CASE p WHEN 1 THEN concat(chr(10), '### 报告 ', rank, ' (2024-01-01, 相关度: ', printf('%.2f', 1 - distance), ')', chr(10), left(content, 500))
  WHEN 2 THEN concat(chr(10), '### ', rank, '. ', title, ' (2024-01-01, 相关度: ', printf('%.2f', 1 - distance), ')', chr(10), left(content, 300)) ELSE concat(chr(10), '**', title, '**: ', left(content, 200)) END AS t FROM ht),
sx AS (SELECT query_id, p, concat(CASE p WHEN 1 THEN '## 相关历史报告' WHEN 2 THEN concat(chr(10), '## 相关新闻') ELSE concat(chr(10), '## 相关知识') END, chr(10), string_agg(t, chr(10) ORDER BY rank)) AS b FROM pc GROUP BY 1, 2)"""
query("t25_context_text", "query_id context | | n_sources", ctes=CTX, sql="SELECT query_id, string_agg(b, chr(10) ORDER BY p) AS context, (SELECT count(*) FROM ht h WHERE h.query_id = sx.query_id) AS n_sources FROM sx GROUP BY query_id")(
    lambda s, d: RT.context_text(_hits(s, d)).withColumn("n_sources", F.size("sources")))

# --- learning ---------------------------------------------------------------------------


def training(s, d):
    bound = V.hours_bound(s, d)
    x = FE.direction_features(V.bars(s, d), max_rows=bound)
    y = FE.direction_label(V.bars(s, d), max_rows=bound).select("symbol", "time", "label")
    t = FE.training_target(V.bars(s, d), max_rows=bound).select("symbol", "time", "target")
    return cut_lineage(PF.chrono_split(FE.align(FE.align(x, y), t), max_rows=bound))


COLS = FE.DIRECTION_COLUMNS


@functools.lru_cache(maxsize=4)
def _trained(s, d):
    """Rows of the learning queries; the queries of a session share them and the models fitted on them."""
    return training(s, d)


@functools.lru_cache(maxsize=4)
def _fitted(s, d):
    rows = _trained(s, d)
    return ML.direction_classifier(rows.where("not is_test"), COLS), rows.where("is_test")


query("m01_direction_classifier", "symbol | accuracy | n")(
    lambda s, d: (lambda m, t: m.transform(t).groupBy("symbol").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")))(*_fitted(s, d)))
query("m02_predict", "symbol time | prediction probability_up")(lambda s, d: (lambda m, t: ML.predict(m, t))(*_fitted(s, d)))


@functools.lru_cache(maxsize=4)
def _regressor(s, d):
    """Fitted on the training part, whose own last fifth decides when to stop, so the test rows stay unseen."""
    rows = _trained(s, d)
    inner = PF.chrono_split(rows.where("not is_test").drop("is_test", "row"), max_rows=V.hours_bound(s, d))
    return ML.return_regressor(inner, COLS), rows.where("is_test")


query("m03_return_regressor", "symbol | rmse")(lambda s, d: (lambda m, t: m.transform(t).groupBy("symbol").agg(
    F.sqrt(F.avg((F.col("prediction") - F.col("target")) ** 2)).alias("rmse")))(*_regressor(s, d)))
query("k05_top_features", "feature | importance")(lambda s, d: ML.top_features(ML.feature_importance(_regressor(s, d)[0], COLS, s), 10))


@functools.lru_cache(maxsize=4)
def _compared(s, d):
    return ML.compare_models(_trained(s, d), COLS, max_rows=V.hours_bound(s, d))


query("m04_cross_validate", "| mean_score std_score")(lambda s, d: s.createDataFrame([ML.summarize_scores(ML.walk_forward_scores(
    _trained(s, d).withColumn("label", F.col("label").cast("double")), lambda t: ML.direction_classifier(t, COLS), ML.accuracy, max_rows=V.hours_bound(s, d)))]))
query("m05_compare_models", "model | mean_score std_score | place")(_compared)
query("k08_rank_models", "model | mean_score | place")(lambda s, d: ML.rank_models(_compared(s, d).drop("place")))
query("m06_param_search", "| stepSize mean_score std_score | trial")(lambda s, d: ML.param_search(
    _trained(s, d), COLS, lambda stepSize: ML.CLASSIFIERS["gbt"]().setStepSize(stepSize), ML.grid({"stepSize": [0.03, 0.1]}), max_rows=V.hours_bound(s, d)))
query("m06_random_search", "| regParam elasticNetParam mean_score std_score | trial")(lambda s, d: ML.param_search(
    _trained(s, d), COLS, ML.MAKERS["logistic"], ML.drawn(ML.SPACES["logistic"], 8), max_rows=V.hours_bound(s, d)))
RULE_SPACE = {"lookback": ("choice", [1, 2, 3, 5, 8]), "threshold": ("log", 0.001, 0.2)}
DRAWN = BARS + """, u AS (SELECT t AS trial, CAST('0x' || substr(md5('7:' || t || ':lookback'), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS a,
  CAST('0x' || substr(md5('7:' || t || ':threshold'), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS b FROM range(40) r(t)),
pt AS (SELECT trial, [1, 2, 3, 5, 8][CAST(floor(a * 5) AS INT) + 1] AS lookback, exp(ln(0.001) + b * (ln(0.2) - ln(0.001))) AS threshold FROM u),
mv AS (SELECT symbol, time, k, close / lag(close, k) OVER (PARTITION BY symbol, k ORDER BY time) - 1 AS move, lead(close) OVER (PARTITION BY symbol, k ORDER BY time) / close - 1 AS nx FROM bars, (SELECT unnest([1, 2, 3, 5, 8]) AS k) q)"""


def _moves(s, d):
    from tidemark import series as S

    x = S.open_series(V.bars(s, d), back=8, ahead=1, max_rows=V.hours_bound(s, d))
    return x.add(**{f"move_{k}": S.change(x, "close", k) for k in (1, 2, 3, 5, 8)}, next_return=S.ratio(S.lead(x, "close"), F.col("close")) - 1).close()


query("m06_random_rule", "| threshold accuracy | trial lookback n", ctes=DRAWN,
      sql="SELECT trial, lookback, threshold, avg(CASE WHEN (move > threshold) = (nx > 0) THEN 1 ELSE 0 END) AS accuracy, count(*) AS n FROM pt JOIN mv ON k = lookback WHERE move IS NOT NULL AND nx IS NOT NULL GROUP BY 1, 2, 3")(
    lambda s, d: ML.threshold_search(_moves(s, d), ML.drawn(RULE_SPACE, 40, seed=7), {k: f"move_{k}" for k in (1, 2, 3, 5, 8)}))

# --- hooks -----------------------------------------------------------------------------------
SMA_SIG = f"CASE WHEN {avg('close', 5)} > {avg('close', 20)} THEN 'BUY' WHEN {avg('close', 5)} < {avg('close', 20)} THEN 'SELL' ELSE 'HOLD' END"


def _cross(m):
    return lambda b: SG.trend_signal(b, fast=5, slow=20, max_rows=m)


query("x01_strategy_interface", "symbol time signal", ctes=BARS, sql=f"SELECT symbol, time, {SMA_SIG} AS signal FROM bars")(
    lambda s, d: SG.run_strategies(V.bars(s, d), [_cross(V.hours_bound(s, d))]))
query("x02_signal_callable", "symbol time | position", ctes=BARS + f""", sg AS (SELECT symbol, time, {SMA_SIG} AS sig FROM bars),
hx AS (SELECT symbol, time, coalesce(last_value(CASE sig WHEN 'BUY' THEN 1.0 WHEN 'SELL' THEN 0.0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time), 0) AS target FROM sg)""",
      sql="SELECT symbol, time, coalesce(lag(target) OVER (PARTITION BY symbol ORDER BY time), 0) AS position FROM hx")(
    lambda s, d: HK.backtest_strategy(V.bars(s, d), _cross(V.hours_bound(s, d)), max_rows=V.hours_bound(s, d)))
query("x03_rule_interface", "symbol time rule", ctes=BARS, sql="SELECT symbol, time, 'wide' AS rule FROM bars WHERE high > 2 * low UNION ALL SELECT symbol, time, 'busy' FROM bars WHERE volume > 300")(
    lambda s, d: HK.apply_rules(V.bars(s, d), [("wide", lambda: F.col("high") > 2 * F.col("low")), ("busy", lambda: F.col("volume") > 300)]))


def _vowels(texts):
    return [((t.count("a") / max(len(t), 1)), (t.count("e") / max(len(t), 1)), 1 - (t.count("a") + t.count("e")) / max(len(t), 1)) for t in texts]


query("x05_text_scorer", "doc_id | positive negative neutral",
      sql="SELECT doc_id, (length(text) - length(replace(text, 'a', ''))) / greatest(length(text), 1) AS positive, (length(text) - length(replace(text, 'e', ''))) / greatest(length(text), 1) AS negative, 1 - (2 * length(text) - length(replace(text, 'a', '')) - length(replace(text, 'e', ''))) / greatest(length(text), 1) AS neutral FROM documents")(
    lambda s, d: HK.score_texts(V.table(s, d, "documents").select("doc_id", "text"), _vowels))
query("x06_objective_callable", "symbol | value | param_id", ctes=BARS, sql="SELECT symbol, avg(close) AS value, 0 AS param_id FROM bars GROUP BY 1 UNION ALL SELECT symbol, max(close), 1 FROM bars GROUP BY 1")(
    lambda s, d: HK.evaluate(V.bars(s, d), lambda df, fn: df.groupBy("symbol").agg(fn("close").alias("value")), [{"fn": F.avg}, {"fn": F.max}]))
query("x07_row_processor", "o_orderkey error | result", sql="SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'ZeroDivisionError: division by zero' END AS error, CASE WHEN o_custkey % 10 <> 0 THEN 100 / CAST(o_custkey % 10 AS DOUBLE) END AS result FROM orders")(
    lambda s, d: HK.process_rows(V.table(s, d, "orders").select("o_orderkey", "o_custkey"), lambda r: 100 / int(r["o_custkey"] % 10)))
