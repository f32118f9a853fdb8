"""Near-duplicate titles: TF-IDF vectors and the order-first greedy selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.session import cut_lineage

# Common English function words; pass another list to match another vectoriser.
STOP_WORDS = [
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before",
    "but", "by", "can", "could", "do", "for", "from", "had", "has", "have", "he", "her", "his", "how", "if", "in",
    "into", "is", "it", "its", "me", "more", "most", "my", "no", "not", "of", "on", "only", "or", "other", "our",
    "out", "over", "she", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these",
    "they", "this", "those", "to", "under", "up", "was", "we", "were", "what", "when", "which", "while", "who",
    "will", "with", "would", "you", "your",
]


def terms(text, stop_words: Sequence[str] = tuple(STOP_WORDS)):
    """Words of two or more characters without stop words, and their neighbour pairs."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w\w+)"), F.lit(1))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(list(stop_words)))
    return words


def _with_pairs(words):
    def pair(i):
        return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))

    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(0), F.size(words) - 2), pair)).otherwise(
        F.array().cast("array<string>"))
    return F.concat(words, pairs)


def _counted(bag: str, starts: str):
    """(term, tf) of a sorted bag; ``starts`` holds the places at which a term begins."""
    def one(s, j):
        return F.struct(F.get(bag, s).alias("term"), (F.coalesce(F.get(starts, j + 1), F.size(bag)) - s).cast("long").alias("tf"))

    return F.transform(starts, one)


def tfidf_vectors(df: DataFrame, order: str, text: str, stop_words=tuple(STOP_WORDS)) -> tuple[DataFrame, DataFrame]:
    """(groups, weights): texts with the same terms form one group led by the first in order.

    groups: lead, sig, and one row per distinct bag of terms; weights: lead, term,
    df, w with unit length per lead, and rest, the squared norm that is left from the term on, rarest first.
    Document frequencies count every text.
    """
    words = df.select(F.col(order).alias("_o"), terms(F.col(text), stop_words).alias("_w"))
    bags = words.select("_o", F.sort_array(_with_pairs(F.col("_w"))).alias("_t"))
    bags = bags.withColumn("sig", F.md5(F.array_join("_t", "\u0001")))
    # copies collapse before anything is paired: one row per bag leaves the map side
    groups = bags.groupBy("sig").agg(F.min("_o").alias("lead"), F.count(F.lit(1)).alias("copies"),
                                     F.first("_t").alias("_t"))
    starts = F.array_compact(F.transform("_t", lambda t, i: F.when((i == 0) | (t != F.get("_t", i - 1)), i)))
    # a bag is one row, so its terms are counted inside it
    groups = cut_lineage(groups.withColumn("_s", starts).select("sig", "lead", "copies", _counted("_t", "_s").alias("_t")))
    counted = groups.select("lead", "copies", F.explode("_t").alias("_t")).select("lead", "copies", "_t.term", "_t.tf")
    freq = counted.groupBy("term").agg(F.sum("copies").alias("df"))
    n = groups.agg(F.sum("copies").alias("n"))
    idf = freq.withColumn("idf", F.ln((n.scalar() + 1) / (F.col("df") + 1)) + 1)
    raw = counted.join(idf, "term").withColumn("_w", F.col("tf") * F.col("idf"))
    # norm and running norm share one shuffle and one sort
    w = Window.partitionBy("lead").orderBy("df", "term")
    square = F.sum(F.col("_w") * F.col("_w"))
    before = F.coalesce(square.over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    normed = raw.select("lead", "term", "df", "_w", before.alias("_b"),
                        square.over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    weights = normed.select("lead", "term", "df", (F.col("_w") / F.sqrt("_n")).alias("w"), (1 - F.col("_b") / F.col("_n")).alias("rest"))
    return groups.select("sig", "lead"), weights


def _index(weights: DataFrame, threshold: float) -> DataFrame:
    """The rare terms of each vector with the squared norm that is left from each one on.

    Terms are ordered rarest first; once the remaining terms have a norm below the
    threshold they cannot reach it alone. So two vectors above the threshold have their first
    common term in both indexes, and the norms left there, multiplied, reach it too.
    """
    return weights.where(F.col("rest") >= threshold * threshold - 1e-9).select("term", "lead", "rest")


@F.pandas_udf(DoubleType())
def _dot(ta: pd.Series, wa: pd.Series, tb: pd.Series, wb: pd.Series) -> pd.Series:
    out = []
    for xs, us, ys, vs in zip(ta, wa, tb, wb):
        held = dict(zip(ys, vs))
        out.append(sum(u * held.get(x, 0.0) for x, u in zip(xs, us)))
    return pd.Series(out, dtype=float)


def _first_of_all(index: DataFrame, vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Texts that come first in all their index terms: nothing before them is similar, so they are kept. Returned with
    what they remove; each text is compared with one of them per index term, so a group of near copies costs its size."""
    sizes = index.groupBy("term").agg(F.min("lead").alias("first"))
    placed = cut_lineage(index.select("term", "lead").join(sizes, "term"))
    leaders = cut_lineage(placed.groupBy("lead").agg(F.min(F.col("lead") == F.col("first")).alias("_all")).where("_all").select("lead"))
    near = placed.join(leaders.withColumnRenamed("lead", "first"), "first", "left_semi").where("lead <> first")
    near = near.select(F.col("first").alias("a"), F.col("lead").alias("b")).distinct()
    left = vectors.select(F.col("lead").alias("a"), F.col("terms").alias("_ta"), F.col("ws").alias("_wa"))
    right = vectors.select(F.col("lead").alias("b"), F.col("terms").alias("_tb"), F.col("ws").alias("_wb"))
    gone = near.join(left, "a").join(right, "b").where(_dot("_ta", "_wa", "_tb", "_wb") > threshold)
    return leaders, cut_lineage(gone.select(F.col("b").alias("lead")).distinct())


def _run_edges(lead: np.ndarray, rest: np.ndarray, side: np.ndarray, terms: list, ws: list, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Similar pairs of a run: between its two blocks, or within its only one."""
    ids, _ = pd.factorize(np.concatenate([np.asarray(t, dtype=object) for t in terms]))
    owner = np.repeat(np.arange(len(lead)), [len(t) for t in terms])
    shared = np.bincount(ids) > 1  # a term of one vector adds to no product
    column = np.cumsum(shared) - 1
    held = shared[ids]
    m = np.zeros((len(lead), int(shared.sum())))
    m[owner[held], column[ids[held]]] = np.concatenate([np.asarray(w, dtype=float) for w in ws])[held]
    x = np.flatnonzero(side == 0)
    y = np.flatnonzero(side == 1) if (side == 1).any() else x
    like = (m[x] @ m[y].T > threshold) & (rest[x][:, None] * rest[y][None, :] > threshold * threshold - 1e-9)
    i, j = np.nonzero(like)
    u, v = lead[x[i]], lead[y[j]]
    keep = u < v if y is x else u != v
    return np.minimum(u, v)[keep], np.maximum(u, v)[keep]


def _edges(index: DataFrame, vectors: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b) of all similar pairs. The texts of a term are cut into blocks by a salt and every pair of blocks is a run of
    its own; candidate pairs are compared by a matrix product inside a run and never become rows."""
    sizes = index.groupBy("term").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("g"), F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = index.join(sizes.drop("n"), "term").withColumn("i", F.pmod(F.xxhash64("lead"), F.col("g")).cast("int"))
    dealt = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    runs = dealt.select("term", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), (F.col("i") > F.col("j")).cast("int").alias("side"), "lead", "rest")
    runs = runs.join(vectors, "lead")
    kind = vectors.schema["lead"].dataType.simpleString()

    def compare(key, pdf):
        lead = pdf["lead"].to_numpy()
        a, b = _run_edges(lead, pdf["rest"].to_numpy(), pdf["side"].to_numpy(), list(pdf["terms"]), list(pdf["ws"]), threshold)
        return pd.DataFrame({"a": a, "b": b})

    return runs.groupBy("term", "lo", "hi").applyInPandas(compare, f"a {kind}, b {kind}").distinct()


def _decide_by_edges(nodes, edges):
    """Order-first independent set: keep what no earlier undecided text reaches."""
    kept = []
    edges = cut_lineage(edges)
    while not edges.isEmpty():
        late = edges.select(F.col("b").alias("lead")).distinct()
        keep = cut_lineage(nodes.join(late, "lead", "left_anti"))
        gone = edges.join(keep.withColumnRenamed("lead", "a"), "a", "left_semi").select(F.col("b").alias("lead")).distinct()
        done = keep.union(gone)
        nodes = cut_lineage(nodes.join(done, "lead", "left_anti"))
        live = nodes.select("lead")
        edges = cut_lineage(edges.join(live.withColumnRenamed("lead", "a"), "a", "left_semi")
                            .join(live.withColumnRenamed("lead", "b"), "b", "left_semi"))
        kept.append(keep)
    return [*kept, nodes]


def tfidf_dedup(df: DataFrame, order: str = "doc_id", text: str = "title", threshold: float = 0.8,
                stop_words=tuple(STOP_WORDS), block: int = 512) -> DataFrame:
    """Rows kept by scanning in order and dropping what is similar to a kept row.

    Exact: same result as the scan over the full similarity matrix. Texts without
    terms are similar to nothing and all stay. A run of the similarity join has two blocks of
    some ``block`` texts; a fixed number of jobs finds all similar pairs.
    """
    _, weights = tfidf_vectors(df, order, text, stop_words)
    weights = cut_lineage(weights)
    held = F.sort_array(F.collect_list(F.struct("term", "w")))
    vectors = cut_lineage(weights.groupBy("lead").agg(held.alias("v")).select("lead", F.col("v.term").alias("terms"), F.col("v.w").alias("ws")))
    index = _index(weights, threshold)
    leaders, gone = _first_of_all(index, vectors, threshold)
    open_ = cut_lineage(index.join(leaders.union(gone), "lead", "left_anti"))
    kept = [leaders, *_decide_by_edges(open_.select("lead").distinct(), _edges(open_, vectors, threshold, block))]
    out = kept[0]
    for k in kept[1:]:
        out = out.union(k)
    chosen = df.join(out.withColumnRenamed("lead", order), order, "left_semi")
    empty = df.where(F.size(terms(F.col(text), stop_words)) == 0)
    return chosen.unionByName(empty)
