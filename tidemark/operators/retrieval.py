"""Vector retrieval: nearest stored vectors, age re-ranking, diverse selection, context."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X

BLOCK = 1024  # queries of a block
ROWS = 4096  # stored vectors of a block
SENT = 8  # query blocks that are broadcast; the others meet the vectors by a join
CELLS = 256


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _packed(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """Blocks of vectors: names, the matrix as bytes and its width. Vectors that are null are left out."""

    def pack(batches):
        for pdf in batches:
            pdf = pdf[pdf[vec].notna()]
            for i in range(0, len(pdf), ROWS):
                part = pdf.iloc[i : i + ROWS]
                m = np.stack([np.asarray(v, dtype=float) for v in part[vec]])
                yield pd.DataFrame({"names": [part[key].to_numpy()], "stored": [m.tobytes()], "width": [m.shape[1]]})

    return rows.select(key, vec).mapInPandas(pack, f"names array<{_kind(rows, key)}>, stored binary, width int")


def _query_blocks(queries: DataFrame, key: str, vec: str) -> tuple[DataFrame, Column]:
    """Query blocks (g, ids, points) of some ``BLOCK`` queries by a hash of their key, and the number of blocks. Both are
    part of the plan: nothing is counted or collected before it runs."""
    blocks = F.greatest(F.lit(1), F.ceil(F.lit(1.0) * queries.agg(F.count(F.lit(1))).scalar() / BLOCK)).cast("int")
    dealt = queries.select(F.col(key).alias("id"), F.col(vec).alias("vec")).withColumn("g", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    held = dealt.where("vec is not null").groupBy("g").agg(F.sort_array(F.collect_list(F.struct("id", "vec"))).alias("qs"))
    held = held.select("g", F.col("qs.id").alias("ids"), F.col("qs.vec").alias("vecs"))

    def pack(batches):
        for pdf in batches:
            m = [np.stack([np.asarray(v, dtype=float) for v in vs]) for vs in pdf["vecs"]]
            yield pd.DataFrame({"g": pdf["g"], "ids": pdf["ids"], "points": [x.tobytes() for x in m]})

    return held.mapInPandas(pack, f"g int, ids array<{_kind(queries, key)}>, points binary"), blocks


def _fused_square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x * x + c rounded once: the errors of the product and of the sum are added last."""
    p = x * x
    t = 134217729.0 * x
    hi = t - (t - x)
    lo = x - hi
    s = p + c
    z = s - p
    return s + (((p - (s - z)) + (c - z)) + (((hi * hi - p) + 2 * hi * lo) + lo * lo))


def _distances(stored: np.ndarray, points: np.ndarray, metric: str) -> np.ndarray:
    """Distance of the vectors in the same row. The squared one is the square of the root of fused sums in the order of the
    dimensions, which are the doubles of the SQL: scores of ``mmr`` tie by nature, and the last bit decides."""
    if metric == "l2":
        apart, total = (stored - points).T, np.zeros(len(stored))
        for x in apart:
            total = _fused_square(x, total)
        return np.array([math.pow(r, 2.0) for r in np.sqrt(total).tolist()], dtype=float)
    norm = np.linalg.norm(stored, axis=1) * np.linalg.norm(points, axis=1)
    return 1 - (stored * points).sum(axis=1) / np.where(norm == 0, np.nan, norm)


def _best_of(names: np.ndarray, stored: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int, metric: str) -> pd.DataFrame:
    """The k nearest of one block for each of its queries. A matrix product finds all that can be among them within its
    rounding error; their distances are then taken from the differences."""
    product = stored @ points.T
    a, b = (stored**2).sum(axis=1), (points**2).sum(axis=1)
    if metric == "l2":
        rough = a[:, None] + b[None, :] - 2 * product
        slack = 1e-12 * (a.max() + b)
    else:
        norm = np.sqrt(a[:, None] * b[None, :])
        rough = np.where(norm == 0, np.inf, 1 - product / np.where(norm == 0, 1, norm))
        slack = np.full(len(b), 1e-12)
    if len(stored) > k:
        rows, cols = np.nonzero(rough <= np.partition(rough, k - 1, axis=0)[k - 1] + slack)
    else:
        rows, cols = np.divmod(np.arange(rough.size), len(points))
    found = pd.DataFrame({"q": cols, "d": _distances(stored[rows], points[cols], metric), "n": names[rows]})
    found = found.sort_values(["q", "d", "n"], kind="stable")
    found = found[found.groupby("q").cumcount() < k]
    return pd.DataFrame({"q": ids[found["q"].to_numpy()], "n": found["n"].to_numpy(), "d": found["d"].to_numpy()})


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", key: str = "vec_id",
            vec: str = "embedding", query_key: str = "query_id", query_vec: str = "query") -> DataFrame:
    """The k nearest stored vectors per query: query_id, key, distance, rank.

    Vectors are packed into blocks where they are read, queries into blocks by a hash of their key. Every pair of blocks
    is one matrix product, which keeps k candidates per query; only those are shuffled. The first ``SENT`` query
    blocks are broadcast, so that the vectors are scanned once and not moved; further ones meet them in
    cells of a shuffled grid. Squared Euclidean distance by default.
    """
    schema = f"{query_key} {_kind(queries, query_key)}, {key} {_kind(vectors, key)}, distance double"

    def search(batches):
        for pdf in batches:
            for names, stored, width, ids, points in zip(pdf["names"], pdf["stored"], pdf["width"], pdf["ids"], pdf["points"]):
                m, q = (np.frombuffer(x, dtype=float).reshape(-1, width) for x in (stored, points))
                yield _best_of(np.asarray(names), m, np.asarray(ids), q, k, metric).set_axis([query_key, key, "distance"], axis=1)

    blocks, count = _query_blocks(queries, query_key, query_vec)
    columns = ["names", "stored", "width", "ids", "points"]
    near = _packed(vectors, key, vec).crossJoin(F.broadcast(blocks.where(F.col("g") < SENT))).select(*columns)
    rest = _packed(vectors.where(count > SENT), key, vec).withColumn("cell", F.pmod(F.xxhash64("stored"), F.lit(CELLS)).cast("int"))
    rest = rest.withColumn("g", F.explode(F.sequence(F.lit(SENT), count - 1)))
    late = blocks.where(F.col("g") >= SENT).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))))
    found = near.unionByName(rest.join(late, ["g", "cell"]).select(*columns)).mapInPandas(search, schema)
    w = Window.partitionBy(query_key).orderBy("distance", key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def candidates(n: int, cap: int) -> int:
    """How many rows to fetch for n results: twice as many, capped (20 reports, 30 news)."""
    return min(2 * n, cap)


def _exp(x: Column) -> Column:
    """The C library's exponential. The JVM's differs from it in the last bit of every tenth value, and ``mmr`` ties on last bits."""

    def each(values: pd.Series) -> pd.Series:
        return pd.Series([math.exp(v) if v < 709 else float(np.exp(v)) for v in values], dtype=float)

    return F.pandas_udf(each, "double")(x)


def decay_rerank(found: DataFrame, ts: Column, asof, days: float, query_key: str = "query_id", key: str = "vec_id"):
    """Distance divided by the age weight + 0.1; ranked again. 30 days for reports, 7 for news."""
    out = found.withColumnRenamed("distance", "original_distance")
    weight = X.time_decay(ts, asof, days, _exp)
    out = out.withColumn("distance", F.col("original_distance") / (weight + 0.1))
    w = Window.partitionBy(query_key).orderBy("distance", key)
    return out.withColumn("rank", F.row_number().over(w))


def mmr(found: DataFrame, n: int, weight: float = 0.7, query_key: str = "query_id") -> DataFrame:
    """Up to n rows per query, trading closeness against distance from the chosen rows.

    Works on the at most 30 fetched rows of a query. ``pick`` is the order of choice.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)

    def choose(pdf):
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        d = pdf["distance"].to_numpy()
        order, left = [0], list(range(1, len(d)))
        if len(d) <= n:
            order, left = list(range(len(d))), []
        while len(order) < n and left:
            score = [weight * (1 - d[i]) + (1 - weight) * min(abs(d[i] - d[j]) for j in order) for i in left]
            order.append(left.pop(int(np.argmax(score))))
        out = pdf.iloc[order].copy()
        out["pick"] = np.arange(1, len(out) + 1)
        return out

    return found.groupBy(query_key).applyInPandas(choose, schema + ", pick long")


def documents(df: DataFrame, kind: str, key: Column, title: Column | None, content: Column, stamp: Column) -> DataFrame:
    """Rows of a collection: md5 id, text (title and content), type, title, timestamp."""
    body = content if title is None else F.concat(title, F.lit("\n\n"), content)
    return df.select(X.doc_id(key).alias("id"), body.alias("text"), F.lit(kind).alias("type"),
                     (F.lit(None).cast("string") if title is None else title).alias("title"), stamp.alias("timestamp"))


# Section headings and cuts of the context text.
SECTIONS = {"report": ("## 相关历史报告", 500), "news": ("\n## 相关新闻", 300), "knowledge": ("\n## 相关知识", 200)}


def context_text(hits: DataFrame, query_key: str = "query_id") -> DataFrame:
    """Context and sources per query from ranked hits.

    ``hits`` has query key, section (report, news, knowledge), rank, title, content,
    stamp (yyyy-MM-dd) and distance; a query has a handful of hits. Pieces are cut
    to the section's length, which is part of the text's definition.
    """
    number, near = F.col("rank").cast("string"), F.format_string("%.2f", 1 - F.col("distance"))
    name = F.coalesce("title", F.lit("Untitled"))
    section = F.col("section")
    piece = (
        F.when(section == "report", F.concat(F.lit("\n### 报告 "), number, F.lit(" ("), "stamp", F.lit(", 相关度: "), near,
                                             F.lit(")\n"), F.left("content", F.lit(SECTIONS["report"][1]))))
        .when(section == "news", F.concat(F.lit("\n### "), number, F.lit(". "), name, F.lit(" ("), "stamp",
                                          F.lit(", 相关度: "), near, F.lit(")\n"), F.left("content", F.lit(SECTIONS["news"][1]))))
        .otherwise(F.concat(F.lit("\n**"), name, F.lit("**: "), F.left("content", F.lit(SECTIONS["knowledge"][1]))))
    )
    place = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), section)
    rows = hits.withColumns({"_p": place, "_t": piece})
    parts = rows.groupBy(query_key, "_p", "section").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_t"))), lambda x: x["_t"]), "\n").alias("_body"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "title", "distance"))),
                    lambda x: F.struct(x["title"].alias("title"), (1 - x["distance"]).alias("relevance"))).alias("_src"))
    head = F.element_at(F.array(*[F.lit(h) for h, _ in SECTIONS.values()]), F.col("_p").cast("int"))
    parts = parts.withColumn("_body", F.concat(head, F.lit("\n"), "_body"))
    return parts.groupBy(query_key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_body"))), lambda x: x["_body"]), "\n").alias("context"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_src"))), lambda x: x["_src"])).alias("sources"))
