"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of linked token pairs.

Each text is encoded by a byte-level tokenizer (side A, behind one space) and by a piece tokenizer (side B, which adds that
space itself). Byte offsets at which tokens of both sides end cut the tokens into groups; every A token of a group is linked to
every B token of it. The count of an id pair is the number of documents that hold it linked.

Counting. Texts are encoded once and their ids written to the shared folder. A first pass aligns them and keeps, per
chunk of documents, each distinct pair with its number of documents. The distinct pairs of the corpus are cut into segments,
and each segment gets a minimal perfect hash, so that a chunk's counts are a dense vector indexed by the hash; vectors are
summed in a tree of fixed fan-out. A second pass aligns the ids anew and looks the counts up; a key kept at each
place verifies the hit.

Sizes. A segment has some ``segment`` pairs and is one task's work. The pairs that most chunks hold, at most ``table`` of
them, are broadcast for the second pass: that is the proven bound of what is sent to every task. Pairs beyond it are found by
a join of rows, which no frequent pair enters; the result is the same for any ``table``.

Defined results: null and empty texts, and texts whose tokens on either side do not spell a space and the text (a piece
vocabulary may rewrite characters), have no tokens: zeros and an empty ``groups``. Special tokens in a text are plain text.
Texts of any length are read whole; a group of many tokens is counted by distinct ids and multiplicities. Repeated rows
count as documents of their own. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.perfect import Places, mixed
from tidemark.session import cut_lineage
from tidemark.sources.tables import scratch_path

NEVER = b"\xff\xfe"  # in no UTF-8 text: tokens that spell nothing
SEGMENT = 1 << 18  # pairs of a segment
TABLE = 1 << 22  # pairs that are broadcast at most: 16 bytes each and some 4 bits of hash
FAN = 16
TOKENS = 1 << 18  # tokens aligned at a time
LINKS = 1 << 22  # links held at a time
FLUSH = 1 << 21  # distinct pairs of a chunk
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: how byte-level BPE cuts words
STATS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteSide:
    """Byte-level BPE from a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("side A must be a byte-level BPE without normalizer")
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        char = _byte_of()
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if all(c in char for c in t)}
        special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
        vocab = {t: i for t, i in vocab.items() if t not in special}
        self.size = max(spec["model"]["vocab"].values()) + 1
        self.bytes = [NEVER] * self.size
        for t, i in vocab.items():
            self.bytes[i] = bytes(char[c] for c in t)
        # where ids follow the merges, a BPE by ranks gives the same ids in a quarter of the time
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        first = min((vocab[a + b] for a, b in merges), default=0)
        ranked = spec["pre_tokenizer"].get("use_regex", True) and not spec["pre_tokenizer"].get("add_prefix_space")
        ranked = ranked and [vocab.get(a + b) for a, b in merges] == list(range(first, first + len(merges))) and first == 256
        self.fast = None
        if ranked:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={self.bytes[i]: i for i in vocab.values()}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        texts = [" " + t for t in texts]
        if self.fast is None:
            return [e.ids for e in self.plain.encode_batch(texts, add_special_tokens=False)]
        # its pattern gives up on endless runs of white space; the other library reads them
        return [self.fast.encode_ordinary(t) if not _ENDLESS.search(t) else self.plain.encode(t, add_special_tokens=False).ids for t in texts]


_ENDLESS = re.compile(r"\s{5000}")


class PieceSide:
    """Pieces of a sentencepiece model; it adds the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.bytes = [NEVER if self.model.is_control(i) or self.model.is_unknown(i) else self._bytes(self.model.id_to_piece(i)) for i in range(self.size)]

    @staticmethod
    def _bytes(piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> tuple[ByteSide, PieceSide]:
    return ByteSide(a_path), PieceSide(b_path)


class Meter:
    """Byte lengths, printed ids and number types of both sides."""

    def __init__(self, a: ByteSide, b: PieceSide):
        self.size_a, self.size_b = a.size, b.size
        self.len_a, self.len_b = (np.array([len(x) for x in s.bytes], np.int64) for s in (a, b))
        self.type_a, self.type_b = (np.uint16 if s.size <= 1 << 16 else np.uint32 for s in (a, b))
        # four runs of printed ids: A inside and at the end of a group, B the same
        self.printed = [f"{i}{end}" for size, end in ((a.size, ","), (a.size, "|"), (b.size, ","), (b.size, ";")) for i in range(size)]


@functools.lru_cache(maxsize=2)
def meter(a_path: str, b_path: str) -> Meter:
    return Meter(*sides(a_path, b_path))


def _encoder(a_path: str, b_path: str):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = sides(a_path, b_path)
        m = meter(a_path, b_path)
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.iloc[i : i + 256]
                texts = [t or "" for t in part["text"]]
                out_a, out_b = [], []
                for t, ia, ib in zip(texts, a.encode(texts), b.encode(texts)):
                    raw = b" " + t.encode("utf-8", "surrogatepass")
                    same = t != "" and b"".join([a.bytes[x] for x in ia]) == raw and b"".join([b.bytes[x] for x in ib]) == raw
                    out_a.append(np.array(ia if same else [], m.type_a).tobytes())
                    out_b.append(np.array(ib if same else [], m.type_b).tobytes())
                yield pd.DataFrame({"row": part["row"], "key": part["key"], "a": out_a, "b": out_b})

    return encode


class Aligned:
    """Groups of the documents of a slice: all tokens of a side in one array, with the group each one is in."""

    def __init__(self, m: Meter, a: list[bytes], b: list[bytes]):
        self.m = m
        each_a, each_b = [np.frombuffer(x, m.type_a) for x in a], [np.frombuffer(x, m.type_b) for x in b]
        self.n_a, self.n_b = np.array([len(x) for x in each_a], np.int64), np.array([len(x) for x in each_b], np.int64)
        self.a, self.b = np.concatenate(each_a).astype(np.int64), np.concatenate(each_b).astype(np.int64)
        end_a, end_b = np.cumsum(m.len_a[self.a]), np.cumsum(m.len_b[self.b])
        cuts = end_a[np.isin(end_a, end_b, assume_unique=True)]  # both sides spell the same bytes, so documents end at cuts
        self.group_a, self.group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        self.doc_of_a = np.repeat(np.arange(len(a)), self.n_a)
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=len(cuts)), np.bincount(self.group_b, minlength=len(cuts))
        self.first_a, self.first_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        self.doc_of_group = self.doc_of_a[self.first_a]
        self.n_groups = np.bincount(self.doc_of_group, minlength=len(a))
        self.n_links = np.bincount(self.doc_of_group, self.in_a * self.in_b, len(a)).astype(np.int64)

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, pair, times) of all links; a document's pair may come several times, but within one step only."""
        a, group, times_a = self.a, self.group_a, np.ones(len(self.a), np.int64)
        b, first_b, in_b, times_b = self.b, self.first_b, self.in_b, np.ones(len(self.b), np.int64)
        steps = [slice(0, len(a))]
        if int(self.n_links.sum()) > LINKS:  # distinct ids of each group with their numbers, then some A ids at a time
            span = max(self.m.size_a, self.m.size_b)
            both, times_a = np.unique(group * span + a, return_counts=True)
            group, a = both // span, both % span
            both, times_b = np.unique(self.group_b * span + b, return_counts=True)
            in_b = np.bincount(both // span, minlength=len(in_b))
            b, first_b = both % span, np.cumsum(in_b) - in_b
            order = np.argsort(a, kind="stable")
            a, group, times_a = a[order], group[order], times_a[order]
            ids, at = np.unique(a, return_index=True)
            reach = np.cumsum(in_b[group])
            upto = np.append(at[1:], len(a))
            step = np.concatenate([[0], np.flatnonzero(np.diff(reach[upto - 1] // LINKS)) + 1])
            begins = at[step]
            steps = [slice(x, y) for x, y in zip(begins, [*begins[1:], len(a)])]
        for s in steps:
            wide = in_b[group[s]]
            inner = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
            other = np.repeat(first_b[group[s]], wide) + inner
            yield np.repeat(self.doc_of_group[group[s]], wide), np.repeat(a[s], wide) * self.m.size_b + b[other], np.repeat(times_a[s], wide) * times_b[other]

    def printed(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` per document."""
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (self.group_a, self.group_b))
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + self.first_b[self.group_a]] = self.a + last_a * self.m.size_a
        code[np.arange(len(self.b)) + (self.first_a + self.in_a)[self.group_b]] = 2 * self.m.size_a + self.b + last_b * self.m.size_b
        words, out, at = [self.m.printed[x] for x in code.tolist()], [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append("".join(words[at : at + n])[:-1])
            at += n
        return out


def _slices(part: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    """Runs of rows of some TOKENS tokens; a longer document is a run of its own."""
    held = np.cumsum(part["a"].map(len).to_numpy() // width)
    for _, rows in part.groupby(held // TOKENS, sort=True):
        yield rows


def _counter(a_path: str, b_path: str):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = meter(a_path, b_path)
        task, flushed, held, waiting = TaskContext.get().partitionId(), 0, [], 0

        def merged():
            pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pairs, np.bincount(at, np.concatenate([n for _, n in held]), len(pairs)).astype(np.int64)

        for batch in batches:
            for rows in _slices(batch, np.dtype(m.type_a).itemsize):
                span = m.size_a * m.size_b
                for doc, pair, _ in Aligned(m, list(rows["a"]), list(rows["b"])).links():
                    once = np.unique(doc * span + pair) % span
                    held.append(np.unique(once, return_counts=True))
                    waiting += len(held[-1][0])
                    if waiting > FLUSH:
                        held = [merged()]
                        waiting = len(held[0][0])
                        if waiting > FLUSH // 2:
                            yield pd.DataFrame({"chunk": task * 65536 + flushed % 65536, "pair": held[0][0], "n": held[0][1]})
                            flushed, held, waiting = flushed + 1, [], 0
        if held:
            pairs, n = merged()
            yield pd.DataFrame({"chunk": task * 65536 + flushed % 65536, "pair": pairs, "n": n})

    return count


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    keys = rows["pair"].to_numpy(np.int64)
    places = Places.build(keys)
    kept = np.empty(len(keys), np.int64)
    kept[places.of(keys)] = keys
    return pd.DataFrame({"segment": [rows["segment"].iloc[0]], "places": [places.dump()], "keys": [kept.tobytes()]})


def _leaf(key: tuple, rows: pd.DataFrame, built: pd.DataFrame) -> pd.DataFrame:
    """Dense vector of a few chunks in one segment."""
    places, keys = Places.load(built["places"].iloc[0]), np.frombuffer(built["keys"].iloc[0], np.int64)
    pairs = rows["pair"].to_numpy(np.int64)
    at = places.of(pairs)
    if len(pairs) and not (keys[at] == pairs).all():
        raise ValueError("a pair that was counted has no place")
    vector = np.bincount(at, rows["n"].to_numpy(np.float64), len(keys)).astype(np.int64)
    return pd.DataFrame({"segment": [key[0]], "part": [key[1]], "vector": [vector.tobytes()]})


def _add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = np.frombuffer(rows["vector"].iloc[0], np.int64).copy()
    for other in rows["vector"].iloc[1:]:
        total += np.frombuffer(other, np.int64)
    return pd.DataFrame({"segment": [key[0]], "part": [key[1]], "vector": [total.tobytes()]})


def pair_counts(tokens: DataFrame, a_path: str, b_path: str, segment: int = SEGMENT, table: int = TABLE) -> tuple[DataFrame, int]:
    """(segment, places, keys, vector) of all distinct pairs, and the number of the segments, from 0, that hold the most common."""
    chunks = cut_lineage(tokens.select("a", "b").mapInPandas(_counter(a_path, b_path), "chunk long, pair long, n long"))
    distinct = cut_lineage(chunks.groupBy("pair").agg(F.floor(F.log2(F.count(F.lit(1)))).cast("int").alias("tier")))
    tiers = sorted(((r["tier"], r["n"]) for r in distinct.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    room, full, partly, share = table, 99, -1, 0  # whole tiers from the top, then a share of the next by hash
    for tier, n in tiers:
        if n > room:
            partly, share = tier, 1000 * room // n
            room -= n * share // 1000
            break
        full, room = tier, room - n
    hot, cold = -(-(table - room) // segment), max(1, -(-(sum(n for _, n in tiers) - table + room) // segment))

    @F.pandas_udf("int")
    def place(pair: pd.Series, tier: pd.Series) -> pd.Series:
        hashed = mixed(pair.to_numpy(np.int64), 0)
        often = (tier >= full) | ((tier == partly) & ((hashed >> np.uint64(40)) % np.uint64(1000) < share))
        return pd.Series(np.where(often & (hot > 0), hashed % np.uint64(max(1, hot)), np.uint64(hot) + hashed % np.uint64(cold)).astype(np.int32))

    placed = cut_lineage(distinct.select("pair", place("pair", "tier").alias("segment")))
    built = cut_lineage(placed.groupBy("segment").applyInPandas(_build, "segment int, places binary, keys binary"))
    dealt = chunks.select("chunk").distinct().count()
    parts = max(1, -(-dealt // FAN))
    spread = chunks.join(placed, "pair").withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int"))
    copies = built.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    by = ["segment", "part"]
    summed = spread.groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(_leaf, "segment int, part int, vector binary")
    while parts > 1:
        parts = -(-parts // FAN)
        summed = cut_lineage(summed).withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy(*by).applyInPandas(_add, "segment int, part int, vector binary")
    return cut_lineage(built.join(summed.drop("part"), "segment")), hot


class Counts:
    """Verified lookup in the broadcast segments."""

    def __init__(self, parts: list[tuple[int, bytes, bytes, bytes]], segments: int):
        self.segments = segments
        self.parts = {s: (Places.load(p), np.frombuffer(k, np.int64), np.frombuffer(v, np.int64)) for s, p, k, v in parts}

    def of(self, pairs: np.ndarray) -> np.ndarray:
        """Count of each pair, 0 for pairs that are not in the table."""
        out = np.zeros(len(pairs), np.int64)
        if not self.parts:
            return out
        home = (mixed(pairs, 0) % np.uint64(self.segments)).astype(np.int64)
        for s, (places, keys, vector) in self.parts.items():
            mine = np.flatnonzero(home == s)
            at = places.of(pairs[mine])
            hit = (at >= 0) & (keys[at] == pairs[mine])
            out[mine[hit]] = vector[at[hit]]
        return out


def _looker(a_path: str, b_path: str, shared):
    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = meter(a_path, b_path)
        parts, segments, best = shared.value
        counts, best = Counts(parts, segments), np.frombuffer(best, np.int64)
        for batch in batches:
            for rows in _slices(batch, np.dtype(m.type_a).itemsize):
                got = Aligned(m, list(rows["a"]), list(rows["b"]))
                n_best, total = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                rest = [[] for _ in range(len(rows))]
                for doc, pair, times in got.links():
                    each, at = np.unique(pair, return_inverse=True)
                    n = counts.of(each)
                    top = n == best[each // m.size_b]
                    known = n[at] > 0
                    np.add.at(n_best, doc, np.where(known & top[at], times, 0))
                    np.add.at(total, doc, n[at] * times)
                    for d, p, t in zip(doc[~known].tolist(), pair[~known].tolist(), times[~known].tolist()):
                        rest[d].append({"pair": p, "times": t})
                yield pd.DataFrame({"row": rows["row"].to_numpy(), "key": rows["key"].to_numpy(), "n_a": got.n_a, "n_b": got.n_b, "n_groups": got.n_groups,
                                    "n_links": got.n_links, "n_best": n_best, "count_sum": total, "groups": got.printed(), "rest": rest})

    return look


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", segment: int = SEGMENT, table: int = TABLE) -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum and the groups as ``a1,a2|b1;a3|b2,b3``."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    path = scratch_path(spark, "tokens")
    numbered.mapInPandas(_encoder(a_path, b_path), "row long, key string, a binary, b binary").write.option("compression", "zstd").parquet(path)
    tokens = spark.read.parquet(path)
    counted, hot = pair_counts(tokens, a_path, b_path, segment, table)
    m = meter(a_path, b_path)
    size_a, size_b = m.size_a, m.size_b

    def highest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, vector in zip(batch["keys"], batch["vector"]):
                top = np.zeros(size_a, np.int64)
                np.maximum.at(top, np.frombuffer(keys, np.int64) // size_b, np.frombuffer(vector, np.int64))
                ids = np.flatnonzero(top)
                yield pd.DataFrame({"a": ids, "n": top[ids]})

    best = np.zeros(size_a, np.int64)  # one number per id of the vocabulary
    tops = cut_lineage(counted.select("keys", "vector").mapInPandas(highest, "a long, n long").groupBy("a").agg(F.max("n").alias("n")))
    for r in tops.collect():
        best[r["a"]] = r["n"]
    rows = counted.where(F.col("segment") < hot).collect()
    shared = spark.sparkContext.broadcast(([(r["segment"], bytes(r["places"]), bytes(r["keys"]), bytes(r["vector"])) for r in rows], hot, best.tobytes()))
    found = tokens.mapInPandas(_looker(a_path, b_path, shared), f"row long, key string, {STATS}, rest array<struct<pair:long,times:long>>")
    if counted.where(F.col("segment") >= hot).limit(1).count():
        found = cut_lineage(found)

        def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for keys, vector in zip(batch["keys"], batch["vector"]):
                    pairs = np.frombuffer(keys, np.int64)
                    yield pd.DataFrame({"pair": pairs, "n": np.frombuffer(vector, np.int64), "a": pairs // size_b})

        cold = counted.where(F.col("segment") >= hot).select("keys", "vector").mapInPandas(unfold, "pair long, n long, a long")
        cold = cold.join(tops.withColumnRenamed("n", "top"), "a").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
        late = found.select("row", F.explode("rest").alias("r")).select("row", "r.pair", "r.times").join(cold, "pair")
        late = late.groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more"), F.sum(F.col("best") * F.col("times")).alias("good"))
        found = found.join(late, "row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("good", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    return found.select(F.col("key").cast(kind).alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
