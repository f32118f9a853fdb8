"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few random dimensions and ordered along several Hilbert curves, each with a projection and shift of
its own. Spark range-partitions all curves at once, which gives every vector its rank on every curve. A query's candidates
are the vectors in blocks of ranks within a window around it, on any curve; blocks are compared with their queries as matrix
products, and the best of all windows are merged and ranked on the original vectors.

Inner products become distances by one more coordinate that brings every vector to the greatest norm (queries: 0 there).
The window is fitted: a bounded set of queries is searched in full, and the window is as wide as it takes for the wanted
share of their true neighbours to lie within it on some curve. So clustered vectors get narrow windows, and vectors without
structure get windows that are a share of the table, since nothing else reaches the recall there.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part,
nor do rows without id; rows of one id count as one candidate, by their best score; equal vectors are ranked by id; with fewer
candidates than asked for, all are given; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

SAMPLE = 4096
BLOCK = 4096
QUERY_CHUNK = 512


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of grid cells (n x dims, each below 2^bits).

    From the top bit down, what lies below is reflected or swapped with the first axis, then axes are chained by Gray code
    and their bits interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(dims):
            on = (x[i] >> b & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


class Curves:
    """Projections, shifts and the grid of the curves, fitted on a bounded sample of unit-ball vectors."""

    def __init__(self, sample: np.ndarray, greatest: float, curves: int, dims: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        width = sample.shape[1] + 1
        self.greatest, self.bits = greatest, bits
        self.planes = [np.linalg.qr(rng.standard_normal((width, min(dims, width))))[0] for _ in range(curves)]
        lifted = self.lift(sample)
        self.grids = []
        for plane in self.planes:
            at = lifted @ plane
            mean, spread = at.mean(axis=0), at.std(axis=0) + 1e-12
            self.grids.append((mean, spread, rng.random(plane.shape[1])))

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        v = vectors / self.greatest
        return np.hstack([v, np.sqrt(np.maximum(0.0, 1 - (v * v).sum(axis=1, keepdims=True)))])

    def aim(self, vectors: np.ndarray) -> np.ndarray:
        v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.hstack([v, np.zeros((len(v), 1))])

    def keys(self, points: np.ndarray) -> np.ndarray:
        out = []
        for plane, (mean, spread, shift) in zip(self.planes, self.grids):
            # five spreads and the shift fill the grid; beyond that, cells at the rim
            cells = (((points @ plane - mean) / spread + 3 + 2 * shift) / 8 * (1 << self.bits)).astype(np.int64)
            out.append(hilbert_keys(np.clip(cells, 0, (1 << self.bits) - 1), self.bits))
        return np.stack(out, axis=1)


def _matrix(vectors: pd.Series, length: int) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, length))


def _ordered(rows: DataFrame, fitted: Curves, length: int) -> DataFrame:
    """(curve, id, query, vector, rank): ranks run through all curves, one after the other."""

    @F.pandas_udf("array<long>")
    def keys(vectors: pd.Series, query: pd.Series) -> pd.Series:
        m, q = _matrix(vectors, length), query.to_numpy(bool)
        points = fitted.lift(m)
        if q.any():
            points[q] = fitted.aim(m[q])
        return pd.Series(list(fitted.keys(points)))

    keyed = rows.select("id", "query", "vector", F.posexplode(keys("vector", "query")).alias("curve", "key"))
    placed = keyed.repartitionByRange("curve", "key", "id").sortWithinPartitions("curve", "key", "id")
    at = F.monotonically_increasing_id()
    placed = cut_lineage(placed.select("curve", "id", "query", "vector", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("n")))
    sizes = placed.groupBy("part").agg((F.max("n") + 1).alias("size"))  # one row per partition
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return placed.join(F.broadcast(before), "part").select("curve", "id", "query", "vector", (F.col("before") + F.col("n")).alias("rank"))


def _best(scores: np.ndarray, own: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, qvec: np.ndarray, k: int, least):
    """(query, id, score) of each query's k best columns that reach ``least``, scored row by row so that equal vectors
    score the same."""
    for i in range(len(queries)):
        s = np.where(ids == own[i], -np.inf, scores[i])
        near = np.arange(len(s)) if len(s) <= k else np.flatnonzero(s >= np.partition(s, -k)[-k] - 1e-9)
        near = near[s[near] > (-np.inf if least is None else least[i] - 1e-9)]
        exact = (vectors[near] * qvec[i]).sum(axis=1)
        first = np.lexsort((ids[near], -exact))[:k]
        yield from zip([int(queries[i])] * len(first), ids[near][first].tolist(), exact[first].tolist())


def _search(left: np.ndarray, ids: np.ndarray, qvec: np.ndarray, qid: np.ndarray, k: int, least: np.ndarray | None = None) -> pd.DataFrame:
    rows = []
    for a in range(0, len(qid), QUERY_CHUNK):
        part = slice(a, a + QUERY_CHUNK)
        rows += _best(qvec[part] @ left.T, qid[part], qid[part], ids, left, qvec[part], k, None if least is None else least[part])
    return pd.DataFrame(rows, columns=["query_id", "id", "score"]).astype({"query_id": "int64", "id": "int64", "score": "float64"})


def _merge(found: DataFrame, k: int) -> DataFrame:
    one = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_neighbours(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Full search for a bounded set of queries, which goes to all tasks."""
    few = [(r["id"], np.array(r["vector"], np.float64)) for r in queries.collect()]
    qid, qvec = np.array([i for i, _ in few], np.int64), np.array([v for _, v in few]).reshape(len(few), -1)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) and len(qid):
                yield _search(_matrix(batch["vector"], qvec.shape[1]), batch["id"].to_numpy(np.int64), qvec, qid, k)

    return _merge(rows.mapInPandas(scan, "query_id long, id long, score double"), k)


def _window(ranked: DataFrame, data: DataFrame, queries: DataFrame, k: int, probes: int, target: float) -> int:
    """Ranks to either side that hold ``target`` of the true neighbours of ``probes`` queries on some curve."""
    some = queries.orderBy(F.xxhash64("id"), "id").limit(probes)
    true = cut_lineage(exact_neighbours(data, some, k).select("query_id", "id"))  # probes x k rows
    there = ranked.where("NOT query").join(F.broadcast(true), "id").select("query_id", "id", "curve", "rank")
    own = ranked.where("query").join(F.broadcast(some.select("id")), "id").select(F.col("id").alias("query_id"), "curve", F.col("rank").alias("own"))
    near = there.join(F.broadcast(own), ["query_id", "curve"]).groupBy("query_id", "id").agg(F.min(F.abs(F.col("rank") - F.col("own"))).alias("d"))
    return int(near.agg(F.percentile("d", target).alias("w")).first()["w"] or 0) + 1


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, curves: int = 3, dims: int = 6, bits: int = 10,
            target: float = 0.96, probes: int = 64, seed: int = 5, key: str = "vec_id", vector: str = "embedding",
            window: int | None = None) -> DataFrame:
    """(query_id, rank, key, score): each query's k nearest by inner product. ``window`` replaces the fitted one."""
    spark = vectors.sparkSession
    out = f"query_id long, rank int, {key} long, score double"
    rows = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), F.col(vector).alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    sizes = rows.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("greatest"))
    size = sizes.orderBy(F.desc("n"), F.desc("length")).first()
    if size is None:
        return spark.createDataFrame([], out)
    length = size["length"]
    rows = rows.where(F.size("vector") == length)
    sample = rows.orderBy(F.xxhash64("id", "vector")).limit(SAMPLE).select("vector").collect()  # SAMPLE vectors at most
    fitted = Curves(np.array([r["vector"] for r in sample], np.float64), size["greatest"], curves, dims, bits, seed)
    data = rows.withColumn("query", F.lit(False))
    queries = rows.where("query")
    ranked = cut_lineage(_ordered(data.unionByName(queries), fitted, length))
    total = data.count() + queries.count()
    w = max(k, window if window is not None else _window(ranked, data, queries, k, probes, target))
    here = F.col("rank") - F.col("curve").cast("long") * total  # rank on its own curve
    low, high = F.greatest(F.lit(0), here - w), F.least(F.lit(total - 1), here + w)
    chunks = max(1, -(-queries.count() // 20_000))
    chunk = F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")
    visits = ranked.where("query").select("curve", "id", "vector", chunk.alias("chunk"), F.explode(F.sequence(F.floor(low / BLOCK), F.floor(high / BLOCK))).alias("block"))
    blocks = ranked.where("NOT query").select("curve", "id", "vector", F.floor(here / BLOCK).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _search(_matrix(left["vector"], length), left["id"].to_numpy(np.int64), _matrix(right["q_vector"], length),
                       right["q_id"].to_numpy(np.int64), k, right["least"].to_numpy(np.float64))

    def along(which: Column, least: DataFrame | None) -> DataFrame:
        asked = visits.where(which)
        lowest = F.lit(float("-inf"))
        asked = asked.withColumn("bound", lowest) if least is None else asked.join(least.withColumnRenamed("query_id", "id"), "id", "left")
        asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("curve", "block", "chunk", "id", "vector")], F.coalesce("bound", lowest).alias("least"))
        return blocks.where(which).groupBy("curve", "block", "chunk").cogroup(asked.groupBy("q_curve", "q_block", "q_chunk")).applyInPandas(
            compare, "query_id long, id long, score double")

    # what the first curve finds bounds each query's k-th score, so the other curves only give what is at least as good
    found = cut_lineage(_merge(along(F.col("curve") == 0, None), k).select("query_id", "id", "score"))
    if curves > 1:
        bound = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
        found = found.unionByName(along(F.col("curve") > 0, bound))
    return _merge(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
