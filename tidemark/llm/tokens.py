"""Exact token counts at every prefix of a text by dynamic programming.

For byte-pair pieces a sequence is the library's encoding exactly if every two neighbours are the encoding of their own text.
So the encoding of a prefix ends in the one piece that fits behind the encoding of what is left of it, and its count is
that one's plus one. No piece has a space behind another character or holds a line break (checked when the model is
loaded), so a text falls into segments that are encoded apart; a segment's counts at all prefixes are found once and
looked up afterwards. A text's counts are the sums over its segments before plus the segment's own: ``Counts`` answers how
many tokens a prefix has, and which prefix fits a budget, without encoding again.

Defined results: null and empty texts have no tokens; texts of any length are counted whole; repeated rows are counted each
on their own; special strings are ordinary text, as in the library; empty tables give empty results; other columns pass
through ``count`` untouched, result columns replace columns of their name.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CACHED = 600_000
SHARED = 24
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")


class Counts:
    """Token counts at all prefixes of one text, kept per segment."""

    def __init__(self, tables: list[bytes]):
        sizes = np.fromiter(map(len, tables), np.int64, len(tables)) // 4
        self.inner = np.frombuffer(b"".join(tables), "<u4")
        self.stop = np.cumsum(sizes)
        self.base = np.cumsum(self.inner[self.stop - 1].astype(np.int64)) if len(tables) else np.zeros(0, np.int64)

    @property
    def total(self) -> int:
        return int(self.base[-1]) if len(self.base) else 0

    def all(self) -> np.ndarray:
        """Counts of the prefixes of 0, 1, 2, ... code points."""
        if not len(self.base):
            return np.zeros(1, np.int64)
        before = np.concatenate([[0], self.base[:-1]])
        counts = self.inner + np.repeat(before, np.diff(self.stop, prepend=0))
        counts[0] = 0  # the empty text; the model's own leading space counts only with what follows
        return counts

    def at(self, chars: int) -> int:
        """Tokens of the first ``chars`` code points."""
        if chars <= 0 or not len(self.base):
            return 0
        seg = int(np.searchsorted(self.stop, chars, side="right"))
        return int(self.inner[chars]) + (int(self.base[seg - 1]) if seg else 0)

    def fits(self, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens."""
        return len(self.inner) - 1 if self.total <= budget and len(self.base) else int(np.flatnonzero(self.all() <= budget)[-1])


class Prefixes(dict):
    """Segment -> counts at its prefixes as little-endian bytes; bounded. A segment without a leading line break has a
    leading space that the key leaves out."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        model = self.model
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())
                 if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in names):
            raise ValueError("pieces reach across segments")
        single = {p for p in names if len(p) == 1}
        if any(c not in single for p in names for c in p):
            raise ValueError("a piece holds a character that is no piece")
        # pieces that the library never gives for their own text are no candidates
        self.pieces = {p for p, got in zip(names, self._encode(names)) if got == [p]}
        self.longest3: dict[str, int] = {}  # by the last three characters
        for p in self.pieces:
            if len(p) > 2:
                self.longest3[p[-3:]] = max(self.longest3.get(p[-3:], 2), len(p))
        self.nodes: dict[str, str] = {}  # prefix of a segment -> the piece it ends in; segments share prefixes
        self.fit: dict[tuple[str, str], bool] = {}

    def _encode(self, segments: list[str]) -> list[list[str]]:
        """Library pieces of raw segments: a line break in front keeps the model's own leading space apart."""
        got = self.model.encode(["\n" + s.replace(SPACE, " ") for s in segments], out_type=str, num_threads=1)
        return [g[2:] for g in got]

    def _follows(self, a: str, b: str) -> bool:
        known = self.fit.get((a, b))
        if known is None:
            if len(self.fit) > CACHED:
                self.fit.clear()
            known = a not in self.pieces or b not in self.pieces or self.model.encode_as_pieces("\n" + (a + b).replace(SPACE, " "))[2:] == [a, b]
            self.fit[(a, b)] = known
        return known

    def _last(self, s: str, i: int, last: list[str]) -> str:
        """The piece in which the encoding of s[:i] ends, given those of all shorter prefixes."""
        pieces, fit = self.pieces, self.fit
        for n in range(min(i, self.longest3.get(s[i - 3 : i], 2) if i > 2 else 2), 1, -1):
            t = s[i - n : i]
            if t in pieces:
                if n == i:
                    return t
                known = fit.get((last[i - n], t))
                if known or (known is None and self._follows(last[i - n], t)):
                    return t
        return s[i - 1]  # what no longer piece explains ends in its character

    def __missing__(self, key: str) -> bytes:
        s = key if key[:1] == "\n" else SPACE + key
        counts, last = [0], [""]
        pieces, nodes = self.pieces, self.nodes
        if len(nodes) > CACHED:
            nodes.clear()
        for i in range(1, len(s) + 1):
            p = s[:i] if i < SHARED else None
            t = nodes.get(p) if p else None
            if t is None:
                t = self._last(s, i, last)
                if p:
                    nodes[p] = t
            counts.append(counts[i - len(t)] + (1 if t in pieces else len(t.encode("utf-8", "surrogatepass"))))
            last.append(t)
        got = np.array(counts[1:], "<u4").tobytes()
        if len(key) < 64:
            if len(self) > CACHED:
                self.clear()
            self[key] = got
        return got

    def of(self, text: str | None) -> Counts:
        if not text:
            return Counts([])
        if text[0] == " " or "  " in text or SPACE in text:  # runs of spaces are segments with what follows
            keys = [s[1:] if s[0] == SPACE else s for s in SEGMENT.findall(SPACE + text.replace(" ", SPACE))]
        else:
            keys = text.replace("\n", " \n").split(" ")
        return Counts([self[k] for k in keys])


_PREFIXES: dict[str, Prefixes] = {}


def prefixes_of(path: str) -> Prefixes:
    """One table per Python worker, kept from task to task."""
    if path not in _PREFIXES:
        _PREFIXES[path] = Prefixes(path)
    return _PREFIXES[path]


def prefix_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with prefix_tokens: the token counts of the prefixes of 0, 1, 2, ... code points."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        table = prefixes_of(path)
        return pd.Series([table.of(t).all().astype(np.int32) for t in texts])

    return docs.withColumn("prefix_tokens", run(F.col(text)))


def count(docs: DataFrame, path: str, budget: int = 4096, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens, over_limit and fits_chars, the code points of the longest prefix in the budget."""

    @F.pandas_udf("n long, fits long")
    def run(texts: pd.Series) -> pd.DataFrame:
        table = prefixes_of(path)
        out = np.zeros((len(texts), 2), np.int64)
        for i, t in enumerate(texts):
            if t:
                c = table.of(t)
                out[i] = c.total, c.fits(budget)
        return pd.DataFrame(out, columns=["n", "fits"])

    got = docs.withColumn("__t", run(F.col(text)))
    return got.withColumns({
        "n_bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"), "n_tokens": F.col("__t.n"),
        "over_limit": F.col("__t.n") > budget, "fits_chars": F.col("__t.fits")}).drop("__t")
