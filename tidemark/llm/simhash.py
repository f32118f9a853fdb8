"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64 bits over four-word shingles. Bit i has a vector m(i) of r + 1 bits; for each of the 2^(r+1) - 1 non-zero
vectors v, table v keeps the bits with an odd <m(i), v>. The at most r differing bits of a pair within the radius span at most
r dimensions, so some v is orthogonal to all of them and the pair meets in that table: no pair is missed.

Only distinct fingerprints are indexed, so exact copies never meet. Buckets of two are compared by expressions. Larger ones
are cut into blocks; every pair of blocks is one run of rows, compared by numpy, which gives a spanning forest of the run's
links instead of all its pairs. No bucket is gathered in one task.

Defined results: null and empty texts, or texts without words, have fingerprint 0; shorter texts than four words are one
shingle; texts of any length are read whole; repeated rows share their component; null doc_id never is a component's least
id unless all are null; empty tables give empty results; other columns pass through ``deduplicate`` and are not read else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.llm.components import components
from tidemark.session import cut_lineage

RADIUS = 4
BLOCK = 1024
HOT = 1000


def fingerprint_of(text: str | None, width: int = 4) -> int:
    """Unsigned fingerprint: a bit is set if more than half of the shingle hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - width + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts, stops)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):  # 64 bytes a shingle at a time
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint_of(t) for t in texts], np.uint64).view(np.int64))


def masks(radius: int = RADIUS) -> list[int]:
    top = (1 << (radius + 1)) - 1
    vector = [(i * 11) % top + 1 for i in range(64)]
    return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2) for v in range(1, top + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _tables(fps: DataFrame, radius: int) -> DataFrame:
    return fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks(radius)])).alias("t", "k"))


def _far(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _forest(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within ``radius`` among the fingerprints."""
    rest, out = fp, []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                rest = rest[~near]
    return out


def _links_of_runs(radius: int):
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def edges(part: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(part):
                key = part[["t", "k", "i", "j"]].to_numpy()
                cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
                fps = part["fp"].to_numpy().view(np.uint64)
                for run in np.split(fps, cuts):
                    if len(run) > 1:
                        out += _forest(run, radius)
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

        held = None  # the last run may go on in the next batch; a run has two blocks of rows at most
        for batch in batches:
            part = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(part):
                continue
            key = part[["t", "k", "i", "j"]].to_numpy()
            last = (key == key[-1]).all(axis=1)
            at = int(np.argmax(last))
            yield edges(part.iloc[:at])
            held = part.iloc[at:]
        if held is not None:
            yield edges(held)

    return link


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(u, v) between distinct fingerprints (column fp) within the radius: enough of them to keep all connections."""
    tables = _tables(fps, radius)
    buckets = cut_lineage(tables.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"))
    pairs = buckets.where("n = 2").where(_far(F.col("u"), F.col("v")) <= radius).select("u", "v")
    crowded = buckets.where("n > 2").select("t", "k", F.ceil(F.col("n") / block).cast("int").alias("g"))
    inside = tables.join(crowded, ["t", "k"]).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    runs = inside.withColumn("c", other).select("t", "k", F.least("b", "c").alias("i"), F.greatest("b", "c").alias("j"), "fp")
    runs = runs.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    return pairs.unionByName(runs.mapInPandas(_links_of_runs(radius), "u long, v long"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fp, root, component_id) per document; root is the class's least fingerprint (signed)."""
    marked = cut_lineage(docs.select(F.col(key).alias("d"), fingerprint(F.col(text)).alias("fp")))
    fps = marked.groupBy("fp").agg(F.min("d").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = cut_lineage(components(cut_lineage(links(fps.select("fp"), radius))).withColumnRenamed("node", "fp"))
    rooted = fps.join(nodes, "fp", "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    linked = nodes.join(fps, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    shared = cut_lineage(rooted.join(linked, "root", "left").select("fp", "root", F.coalesce("component_id", "least").alias("component_id"), "copies"))
    # a fingerprint of many copies would gather them in one task; fewer than HOT can have over a HOT-th of the rows each
    rows = shared.agg(F.sum("copies")).first()[0] or 0
    often = F.col("copies") * HOT > rows
    hot, rest = F.broadcast(shared.where(often).drop("copies")), shared.where(~often).drop("copies")
    found = marked.join(hot, "fp").unionByName(marked.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(rest, "fp"))
    return found.select(F.col("d").alias(key), "fp", "root", "component_id")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id) per document."""
    return classes(docs, key, text, radius).select(key, hexed(F.col("fp")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document of each class, the one of the least key; columns unchanged."""
    found = classes(docs, key, text, radius)
    best = found.groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("d"), F.col("fp").alias("f"))).alias("best"))
    keep = best.select("best.none", "best.d", "best.f").withColumnsRenamed({"none": "__none", "d": "__d", "f": "__f"})
    marked = docs.withColumns({"__fp": fingerprint(F.col(text)), "__key": F.coalesce(F.col(key).cast("string"), F.lit(""))})
    keep = keep.withColumn("__k", F.coalesce(F.col("__d").cast("string"), F.lit("")))
    kept = marked.join(keep, (F.col("__key") == F.col("__k")) & (F.col("__fp") == F.col("__f")) & (F.col(key).isNull() == F.col("__none")), "left_semi")
    return kept.dropDuplicates(["__key", "__fp"]).select(*[F.col(f"`{c}`") for c in docs.columns])
