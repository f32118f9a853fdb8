"""Mixing sources to target weights by capped water-filling.

A source's target is its share of the total by weight, but at most ``epochs`` times its size; what capped sources cannot take
is shared among the others by weight until all fit. Sorted by size per weight the capped sources come first, so the level
of the water follows from running sums over the table of sources.

A source takes every document as often as its target holds it whole; the rest is taken from its documents in the order of a
seeded digest, up to the target. The document at the border is left out, and what is missing is filled by the ``fill`` largest
later documents that fit, one after the other, and then in digest order again by documents no larger than what is still
missing, until no document fits: a source's part is never short by as much as one of its free documents. Running sums go over
blocks of the digest, and only the block with the border is sorted, so a source with most of the rows is not sorted in one task.

All of it is DataFrame expressions. Texts are read once, for their sizes; later steps use narrow rows.

Defined results: null text has size 0 and is taken 0 words; null source is a source, ranked last; repeated rows are documents
of their own; a source of size 0 has target 0; with a total of 0 all targets are 0; empty tables give empty results; other
columns are not read. The same rows give the same mix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import word_count
from tidemark.session import cut_lineage

BLOCKS = 256
MOST_SOURCES = 20_000


def targets(sources: DataFrame, weights=(5, 2, 1), epochs: int = 3) -> DataFrame:
    """``sources`` (source, source_size; one row each) with target. One row per source goes through one task."""
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    ws = F.array(*[F.lit(int(w)) for w in weights])
    t = sources.select("*", F.get(ws, rank % len(weights)).alias("w"))
    # capped sources are those whose cap lies below the water level, so they come first by cap per weight
    order = Window.orderBy((F.col("source_size") * epochs / F.col("w")), F.col("source").isNull(), "source")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.select("*", F.sum("source_size").over(everything).alias("total"), F.sum("w").over(everything).alias("all_w"),
                 F.coalesce(F.sum("source_size").over(upto), F.lit(0)).alias("before"), F.coalesce(F.sum("w").over(upto), F.lit(0)).alias("before_w"))
    # the level if all sources before this one are capped and none from here on is
    t = t.withColumn("level", (F.col("total") - F.col("before") * epochs).cast("double") / (F.col("all_w") - F.col("before_w")))
    t = t.withColumn("capped", F.col("source_size") * epochs < F.col("level") * F.col("w"))
    t = t.withColumn("water", F.min(F.when(~F.col("capped"), F.struct((F.col("source_size") * epochs / F.col("w")).alias("k"), F.col("before").alias("b"), F.col("level").alias("l")))).over(everything)["l"])
    return t.select("source", "source_size", F.when(F.col("capped"), (F.col("source_size") * epochs).cast("double"))
                    .otherwise(F.least(F.col("water") * F.col("w"), (F.col("source_size") * epochs).cast("double"))).alias("target"))


def _sized(docs: DataFrame, key: str, source: str, text: str, seed: int) -> DataFrame:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return docs.select(F.col(key).alias("k"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), digest.alias("h"), F.monotonically_increasing_id().alias("r"),
                       F.xxhash64(text).alias("digest"))


def _attach(rows: DataFrame, per_source: DataFrame, sources: int) -> DataFrame:
    small = per_source.withColumnRenamed("source", "__s")
    return rows.join(F.broadcast(small) if sources <= MOST_SOURCES else small, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")


def _prefix(rows: DataFrame, blocks: DataFrame, per: DataFrame, n: int) -> DataFrame:
    """``rows`` with the columns of ``per`` and more: 1 as long as the running size in digest order is within the part."""
    upto = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    run = blocks.select("source", "b", "n", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    run = _attach(run, per.select("source", "part"), n)
    # the block in which the running size passes the part; none if the part ends with the last block
    border = run.where((F.col("before") <= F.col("part")) & (F.col("before") + F.col("n") > F.col("part")))
    border = border.groupBy("source").agg(F.min("b").alias("at"), F.min("before").alias("at_before"))
    per = cut_lineage(per.join(border.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s"))
    full = _attach(rows, per, n)
    inside = full.where(F.col("b") == F.col("at"))
    place = Window.partitionBy("source").orderBy("h", "k", "size", "r")
    inside = inside.withColumn("run", F.col("at_before") + F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.withColumn("more", ((F.col("part") > 0) & (F.col("run") <= F.col("part"))).cast("int")).drop("run")
    outside = full.where(F.col("at").isNull() | (F.col("b") != F.col("at")))
    outside = outside.withColumn("more", ((F.col("part") > 0) & (F.col("at").isNull() | (F.col("b") < F.col("at")))).cast("int"))
    return inside.unionByName(outside).drop("at", "at_before")


def mix(docs: DataFrame, weights=(5, 2, 1), epochs: int = 3, seed: int = 11, fill: int = 2, key: str = "doc_id",
        source: str = "source", text: str = "text", digest: bool = False) -> DataFrame:
    """(key, source, size, source_size, target, times, taken) per document: taken = times x size words; with ``digest``
    also a hash of the text."""
    rows = cut_lineage(_sized(docs, key, source, text, seed).withColumn("b", F.conv(F.substring("h", 1, 2), 16, 10).cast("int")))
    blocks = cut_lineage(rows.groupBy("source", "b").agg(F.sum("size").alias("n")))  # sources x BLOCKS rows
    per = targets(blocks.groupBy("source").agg(F.sum("n").alias("source_size")), weights, epochs)
    per = per.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(0).cast("int"))
    per = cut_lineage(per.withColumn("part", F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("source_size"))).cast("long")))
    n = per.count()
    chosen = cut_lineage(_prefix(rows, blocks, per, n))
    for _ in range(fill):
        chosen = cut_lineage(_fill(chosen, n))
    chosen = _pass_on(chosen, n)
    times = F.col("whole") + F.col("more")
    return chosen.select(F.col("k").alias(key), F.col("source").alias(source), "size", F.col("source_size").cast("long").alias("source_size"), "target",
                         times.alias("times"), (F.col("size") * times).cast("long").alias("taken"), *(["digest"] if digest else []))


def _fill(chosen: DataFrame, n: int) -> DataFrame:
    """Take one more document of each source: the largest that still fits under the target."""
    gap = chosen.groupBy("source").agg((F.max("part") - F.sum(F.col("size") * F.col("more"))).alias("gap"))
    free = _attach(chosen.where((F.col("more") == 0) & (F.col("size") > 0)), gap, n)
    best = free.where(F.col("size") <= F.col("gap")).groupBy("source").agg(F.max(F.struct("size", "h", "k", "r")).alias("best"))
    best = best.select(F.col("source").alias("__s"), "best")
    with_best = chosen.join(F.broadcast(best) if n <= MOST_SOURCES else best, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    return with_best.withColumn("more", F.when((F.col("more") == 0) & (F.struct("size", "h", "k", "r") == F.col("best")), 1).otherwise(F.col("more"))).drop("best")


def _pass_on(chosen: DataFrame, n: int) -> DataFrame:
    """Repeat the prefix over the free documents no larger than what is missing, until none fits. A pass ends at a document
    larger than what it leaves missing, so later passes go over fewer and smaller documents."""
    marked, taken = chosen, []
    while True:
        state = marked.groupBy("source").agg((F.max("part") - F.sum(F.col("size") * F.col("more"))).alias("part"),
                                             F.min(F.when((F.col("more") == 0) & (F.col("size") > 0), F.col("size"))).alias("least"))
        live = cut_lineage(state.where(F.col("least") <= F.col("part")).drop("least"))
        if live.isEmpty():
            break
        free = marked.where((F.col("more") == 0) & (F.col("size") > 0)).select("source", "k", "size", "h", "r", "b")
        free = _attach(free, live, n).where(F.col("size") <= F.col("part")).drop("part")
        blocks = free.groupBy("source", "b").agg(F.sum("size").alias("n"))
        marked = cut_lineage(_prefix(free, blocks, live, n))
        taken.append(marked.where(F.col("more") == 1).select("r", F.lit(1).alias("plus")))
    if not taken:
        return chosen
    return chosen.join(reduce(DataFrame.unionByName, taken), "r", "left").withColumn("more", F.coalesce("plus", "more")).drop("plus")


def mix_documents(docs: DataFrame, weights=(5, 2, 1), epochs: int = 3, seed: int = 11, key: str = "doc_id",
                  source: str = "source", text: str = "text") -> DataFrame:
    """Every document as often as the mix takes it; columns unchanged. Rows and decisions meet by key, source and a digest
    of the text, and repeated rows by their number among those."""
    order = Window.partitionBy("__k", "__s", "__t")
    decided = mix(docs, weights, epochs, seed, key=key, source=source, text=text, digest=True)
    decided = decided.select(F.col(key).alias("__k"), F.col(source).alias("__s"), F.col("digest").alias("__t"), F.col("times").alias("__times"))
    decided = decided.withColumn("__n", F.row_number().over(order.orderBy(F.desc("__times")))).where("__times > 0").withColumnsRenamed(
        {"__k": "__dk", "__s": "__ds", "__t": "__dt", "__n": "__dn"})
    rows = docs.withColumns({"__k": F.col(key), "__s": F.col(source), "__t": F.xxhash64(text)})
    rows = rows.withColumn("__n", F.row_number().over(order.orderBy(F.lit(1))))
    same = [F.col(f"__{c}").eqNullSafe(F.col(f"__d{c}")) for c in "kst"] + [F.col("__n") == F.col("__dn")]
    taken = rows.join(decided, same)
    return taken.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[F.col(f"`{c}`") for c in docs.columns])
