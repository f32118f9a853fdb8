"""Best-fit packing of tokenised documents with certified bin counts.

Texts are tokenised in blocks, longer documents are cut into full pieces, and pieces are packed as narrow rows. Each
partition runs best-fit decreasing and certifies its bin count by lower bounds from dual-feasible functions. Partitions
above their bound give up all bins that are not full, certified ones their emptiest bin; those documents are exchanged
and packed again, as long as that saves sequences.

The tokeniser of this file splits nothing across white space, so the runs between are reduced to distinct ones, these to
distinct words and the punctuation behind them, and the library is asked for words that are new; the ids of all runs are then
gathered from one array. ``tests/llm`` compares the ids of whole texts with the library's.

Defined results: a null or empty text is one piece with the end id alone; texts of any length are tokenised whole; repeated
rows are documents of their own; null keys stay null; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import zlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

CAPACITY = 4096
END_ID = 1
CACHED = 600_000
AT_ONCE = 2_000_000
#: ASCII punctuation but the apostrophe, which may start a token with the letters after it
WORD_AND_MARKS = r"(?s)^(?P<word>.*?)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
PIECE = "d long, piece int, start long, length long, ids_crc32 long"


def _sure(word: str) -> bool:
    """Letters, which the tokeniser parts from the punctuation behind them before any merge; not letters that lower-casing
    takes apart."""
    return word.isalpha() and (word.isascii() or (word.lower().isalpha() and max(word) < "\u2000"))


def _lowered(text: str | None) -> str:
    text = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ")
    if "<|" not in text:  # special strings are matched as written, before lower-casing
        try:
            text.encode("latin-1")  # letters that every lower-casing maps one to one, and that need no composing
            text = text.lower()
        except UnicodeEncodeError:
            pass
    return text


class Ids:
    """Ids of runs of characters without space, tab or line break, as the library gives them: a row for each run that is
    known, with its place in one array of ids. Bounded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.digit = self.tokenizer.encode("0", add_special_tokens=False).ids[0]
        # the same merges, for words that the file's normaliser and split leave as they are
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names, last = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(max(names.values()) + 1, bool)  # the ids that end a word
        self.ends[[i for name, i in names.items() if last and name.endswith(last)]] = True
        self.rows: dict[str, int] = {}
        self.ids, self.stops = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _add(self, runs: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        if len(runs) != len(sizes):
            raise ValueError("the tokeniser does not end every word by an id of its own")
        self.rows.update(zip(runs, range(len(self.stops) - 1, len(self.stops) - 1 + len(runs))))
        self.stops = np.concatenate([self.stops, self.stops[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])

    def _learn_words(self, words: list[str]) -> None:
        """New words in few calls, many in one text: told apart by the ids that end a word, or by a digit, which is an id
        of its own, where the normaliser has work to do."""
        simple = [w for w in words if (w.isascii() and w.islower()) or (max(w) < "\u0100" and w == w.lower())]
        if simple:
            texts = [" ".join(simple[at : at + 4096]) for at in range(0, len(simple), 4096)]
            ids = np.concatenate([np.array(self.plain.encode_batch_fast([t], add_special_tokens=False)[0].ids, "<u4") for t in texts])
            self._add(simple, ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
        if len(simple) < len(words):
            others = list(set(words).difference(simple))
            texts = [" 0 ".join(others[at : at + 4096]) + " 0" for at in range(0, len(others), 4096)]
            ids = np.concatenate([np.array(self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, "<u4") for t in texts])
            self._add(others, ids[ids != self.digit], np.diff(np.flatnonzero(ids == self.digit), prepend=-1) - 1)

    def _learn_runs(self, runs: list[str]) -> None:
        got = [np.array(self.tokenizer.encode(r, add_special_tokens=False).ids, "<u4") for r in runs]
        self._add(runs, np.concatenate(got), np.array([len(g) for g in got]))

    def _known(self, runs: list[str], learn) -> np.ndarray:
        """The rows of distinct runs; new ones are learned."""
        new = [r for r in runs if r not in self.rows]
        if new:
            learn(new)
        return np.fromiter(map(self.rows.__getitem__, runs), np.int64, len(runs))

    def _taken(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows one behind the other, and where each begins, with the end of the last."""
        return _gather(self.ids, self.stops, rows)

    def _forget(self, keep: list[str]) -> None:
        """Of a full table only what is in use stays, and never a long run."""
        keep = [r for r in keep if r in self.rows and len(r) < 64]
        self.ids, self.stops = self._taken(np.fromiter(map(self.rows.__getitem__, keep), np.int64, len(keep)))
        self.rows = dict(zip(keep, range(len(keep))))

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one behind the other, and the places where each text begins, with the end of the last."""
        split = pc.split_pattern(pa.array(map(_lowered, texts), pa.string()), " ")
        runs = split.values.dictionary_encode()
        parts = pc.extract_regex(runs.dictionary, WORD_AND_MARKS)
        word, marks = (parts.field(n).dictionary_encode() for n in ("word", "marks"))
        words = word.dictionary.to_pylist()
        if len(self.rows) > CACHED or len(self.ids) > 8 * CACHED:
            self._forget(words)
        sure = np.fromiter(map(_sure, words), bool, len(words))
        of_word = np.zeros(len(words), np.int64)
        of_word[sure] = self._known(list(itertools.compress(words, sure)), self._learn_words)
        of_marks = self._known(marks.dictionary.to_pylist(), self._learn_runs)
        # a run is a word and the marks behind it, or, where that is not sure, a whole and nothing behind it
        whole = np.flatnonzero(~sure[word.indices.to_numpy()])
        pair = np.stack([of_word[word.indices.to_numpy()], of_marks[marks.indices.to_numpy()]], 1)
        pair[whole, 0] = self._known(runs.dictionary.take(pa.array(whole)).to_pylist(), self._learn_runs)
        pair[whole, 1] = self._known([""], self._learn_runs)
        ids, stops = self._taken(pair.ravel())
        ids, stops = _gather(ids, stops[::2], runs.indices.to_numpy())
        return ids, stops[split.offsets.to_numpy()]


def _gather(ids: np.ndarray, stops: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``rows`` of ``ids``, which end at ``stops[1:]``, one behind the other, and their own stops."""
    sizes = np.diff(stops)[rows]
    out = np.concatenate([[0], np.cumsum(sizes)])
    places = np.repeat(stops[rows] - out[:-1], sizes)
    places += np.arange(len(places))
    return ids[places], out


_IDS: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One table per Python worker, kept from task to task."""
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(d, piece, start, length, ids_crc32): the pieces of every document, end id included."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for part in _slices(batch):
                rows = []
                ids, stops = ids_of(path).texts(part["t"].to_pylist())
                for row, (a, b) in enumerate(zip(stops[:-1].tolist(), stops[1:].tolist())):
                    got = ids[a:b].tobytes() + end
                    for p, at in enumerate(range(0, len(got), 4 * capacity)):
                        one = got[at : at + 4 * capacity]
                        rows.append((row, p, at // 4, len(one) // 4, zlib.crc32(one)))
                row, *made = zip(*rows)
                yield pa.RecordBatch.from_arrays([part["d"].take(pa.array(row)), *map(pa.array, made, (pa.int32(), *3 * [pa.int64()]))],
                                                 ["d", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(cut, PIECE)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in turn, some ``AT_ONCE`` bytes of text in each slice but for longer texts; every slice has a row."""
    sizes = pc.fill_null(pc.binary_length(batch["t"]), 0).to_numpy().astype(np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // AT_ONCE)) + 1
    for a, b in itertools.pairwise([0, *cuts.tolist(), len(sizes)]):
        if b > a:
            yield batch.slice(a, b - a)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, as the best of several dual-feasible functions, in whole numbers.

    f_k counts items above capacity - k as full, drops those below k and leaves the rest; u_k rounds (k + 1) x down to
    multiples of the capacity unless it is one already.
    """
    hist = np.bincount(lengths, minlength=capacity + 1).astype(object)
    size = np.arange(capacity + 1).astype(object)
    count, total = np.concatenate([[0], np.cumsum(hist)]), np.concatenate([[0], np.cumsum(hist * size)])
    best = -(-total[-1] // capacity)
    for k in np.unique(lengths[lengths <= capacity // 2]):
        k = int(k)
        full = count[-1] - count[capacity - k + 1]
        best = max(best, full + -(-(total[capacity - k + 1] - total[k]) // capacity))
    for k in range(1, 33):
        grown = (k + 1) * size
        even = grown % capacity == 0
        value = np.where(even, k * size, capacity * (grown // capacity))
        best = max(best, -(-int((hist * value).sum()) // (k * capacity)))
    return int(best)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of every item, and each bin's free room, by best-fit decreasing."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where a bin with room r waits
    for at in np.argsort(-lengths, kind="stable"):
        n = int(lengths[at])
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        bins[at], offsets[at] = b, capacity - room
        left = room - n
        free[b] = left
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, free


PACKED = PIECE + ", p int, bin long, offset long, loose boolean, bins long, bound long"


def _pack(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "d", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        lengths = rows["length"].to_numpy()
        bins, offsets, free = best_fit(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        room = np.array(free)
        loose = room > 0 if len(free) > bound else (room == room.max()) & (np.cumsum(room == room.max()) == 1) & (room > 0)
        return rows.assign(bin=bins, offset=offsets, loose=loose[bins], bins=len(free), bound=bound)

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY, per_partition: int = 20_000) -> DataFrame:
    """``parts`` (see ``pieces``) with sequence_id and offset. Full pieces are sequences of their own.

    Rounds end when fewer than two bins are loose, when all loose bins have met in one partition, or when a round
    saves nothing; each has at most a quarter of the partitions of the one before.
    """
    top = F.lit(31 << 58)  # rounds count up from 0 and are fewer than 31, as partitions are fewer than 4^31
    full = parts.where(F.col("length") == capacity).select("*", (top + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, rows = [], parts.where(F.col("length") < capacity)
    n = rows.count()
    for turn in itertools.count():
        # fewer tasks each round, or what lies alone in a bin would never meet
        groups = max(1, -(-n // per_partition) if not turn else min(-(-n // per_partition), groups // 4))
        spread = rows.withColumn("p", F.pmod(F.xxhash64(F.lit(turn), "d", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
        got = cut_lineage(spread.groupBy("p").applyInPandas(_pack(capacity), PACKED))
        got = got.withColumn("sequence_id", F.lit(turn).cast("long") * F.lit(1 << 58) + F.col("p").cast("long") * F.lit(1 << 32) + F.col("bin"))
        now = got.where("offset = 0").agg(F.count(F.lit(1)).alias("bins"), F.sum(F.col("loose").cast("long")).alias("loose")).first()
        loose, spent = now["loose"] or 0, now["bins"]
        if turn and spent >= before:  # the exchange saved nothing: keep the packing that gave these rows up
            done.append(given)
            break
        if groups == 1 or loose < 2:
            done.append(got)
            break
        done.append(got.where(~F.col("loose")))
        given, before = got.where("loose"), loose
        rows = given.select(*parts.columns)
        n = rows.count()
    out = full
    for part in done:
        out = out.unionByName(part.select(*parts.columns, "sequence_id", "offset"))
    return out


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut_lineage(pieces(docs, path, key, text, capacity)), capacity).withColumnRenamed("d", key)
