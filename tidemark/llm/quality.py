"""Quality rules as a short-circuit cascade.

Every rule names the measures it reads and a condition under which a document fails. Cost (seconds) and selectivity
(share of rejections) of each rule are estimated on a bounded sample; rules run in order of rejections per second, and a
measure is only computed for documents that no earlier rule has rejected. The verdict does not depend on the order.
The report of ``measured`` needs some measures of every document; those of the other rules are made for open documents
there too. All of it is DataFrame expressions.

Defined results: a null text counts as empty (no words, so it fails); a text of any length is measured whole; repeated
rows are judged each on its own; an empty table gives an empty table; other columns pass through ``cascade`` untouched,
and a column of ``docs`` that has the name of a result column is replaced by it in ``measured``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import WORD, words

SPAN = 8
T = "__q_"


def _c(name: str) -> Column:
    return F.col(T + name)


def _window_hashes() -> Column:
    """One hash per window of SPAN words; null below two windows. Two different windows of one text share a hash with
    a chance of about 1e-19."""
    return F.when(_c("n_words") > SPAN, F.transform(F.sequence(F.lit(1), _c("n_words").cast("int") - (SPAN - 1)),
                                                    lambda i: F.xxhash64(F.slice(_c("words"), i, SPAN))))


def _placed() -> Column:
    """Windows with their positions, sorted by hash; null where no hash repeats, which spares most texts the sort."""
    return F.when(F.size(F.array_distinct(_c("hashes"))) < F.size(_c("hashes")),
                  F.sort_array(F.transform(_c("hashes"), lambda h, i: F.struct(h.alias("h"), i.alias("p")))))


def _repeated_at() -> Column:
    """Sorted start positions of the windows that are found at least twice."""
    arr = _c("placed")
    twice = F.filter(arr, lambda e, i: ((i > 0) & (F.get(arr, i - 1)["h"] == e["h"]))
                     | ((i < F.size(arr) - 1) & (F.get(arr, i + 1)["h"] == e["h"])))
    return F.sort_array(F.transform(twice, lambda e: e["p"]))


def _covered() -> Column:
    """Words under those windows: a window adds the words up to the next one, SPAN at most."""
    at = _c("repeated_at")
    return F.coalesce(F.aggregate(
        F.transform(at, lambda p, i: F.least(F.lit(SPAN), F.coalesce(F.get(at, i + 1) - p, F.lit(SPAN)))),
        F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))


def _top_word() -> Column:
    """Occurrences of the most frequent word: the longest run of equal words in sorted order."""
    arr, at = _c("sorted"), _c("starts")
    return F.coalesce(F.array_max(F.transform(at, lambda p, i: F.coalesce(F.get(at, i + 1), F.size(arr)) - p)), F.lit(0)).cast("long")


#: measure -> (measures it reads, expression)
MEASURES: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "words": ((), lambda: words(_c("text"))),
    "n_words": (("words",), lambda: F.size(_c("words")).cast("long")),
    "word_chars": (("words",), lambda: F.char_length(F.array_join(_c("words"), "")).cast("long")),
    "n_symbols": ((), lambda: F.regexp_count(_c("text"), F.lit("[#*$%&|<>]")).cast("long")),
    "lines": ((), lambda: F.filter(F.split(_c("text"), "\n"), lambda x: x.rlike(WORD))),
    "n_lines": (("lines",), lambda: F.size(_c("lines")).cast("long")),
    "n_dup_lines": (("lines",), lambda: (F.size(_c("lines")) - F.size(F.array_distinct(_c("lines")))).cast("long")),
    "hashes": (("words", "n_words"), _window_hashes),
    "placed": (("hashes",), _placed),
    "repeated_at": (("placed",), _repeated_at),
    "n_repeat_words": (("repeated_at",), _covered),
    "n_letters": ((), lambda: F.regexp_count(_c("text"), F.lit(r"[\p{L}\p{M}\p{N}]")).cast("long")),
    "sorted": (("words",), lambda: F.sort_array(_c("words"))),
    "starts": (("sorted",), lambda: F.array_compact(F.transform(
        _c("sorted"), lambda w, i: F.when((i == 0) | (w != F.get(_c("sorted"), i - 1)), i)))),
    "top_word": (("sorted", "starts"), _top_word),
}


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    fails: Callable[[Callable[[str], Column]], Column]


#: The base rules come first here; the order in which they run is estimated.
BASE = (
    Rule("few_words", ("n_words",), lambda m: m("n_words") < 20),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
)
RULES = (
    *BASE,
    Rule("word_length", ("n_words", "word_chars"),
         lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 15 * m("n_words"))),
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 5 * m("n_symbols") > m("n_words")),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    Rule("few_letters", ("word_chars", "n_letters"), lambda m: 2 * m("n_letters") < m("word_chars")),
    Rule("one_word", ("n_words", "top_word"), lambda m: 5 * m("top_word") > 2 * m("n_words")),
)
#: Reported for every document, rejected or not.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COPIES = 4


def _with(df: DataFrame, names: tuple[str, ...], needed: Column | None, done: set[str]) -> DataFrame:
    """Add the measures and those that they read, each in a projection of its own so that none is computed twice."""
    for name in names:
        if name in done:
            continue
        reads, build = MEASURES[name]
        df = _with(df, reads, needed, done)
        df = df.withColumn(T + name, build() if needed is None else F.when(needed, build()))
        done.add(name)
    return df


def estimate(docs: DataFrame, rules=RULES, text: str = "text", rows: int = 500, fraction: float = 0.05,
             seed: int = 7) -> list[tuple[str, float, float]]:
    """(rule, seconds, share rejected) per rule on at most ``rows`` sampled documents, best of two runs each.

    The sample is judged ``COPIES`` times over in a run, and the time of a run without any rule is taken off, so that
    starting a job does not count as a rule's cost.
    """
    sample = docs.select(F.coalesce(F.col(text), F.lit("")).alias(T + "text")).sample(fraction, seed).limit(rows).persist()
    try:
        n = COPIES * sample.count()
        if not n:
            return [(rule.name, 0.0, 0.0) for rule in rules]
        many = sample.withColumn(T + "copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))

        def run(judged: DataFrame) -> tuple[float, int]:
            best, bad = float("inf"), 0
            for _ in range(2):
                t0 = time.perf_counter()
                bad = judged.first()["n"] or 0
                best = min(best, time.perf_counter() - t0)
            return best, bad

        empty, _ = run(many.agg(F.sum((F.octet_length(_c("text")) < 0).cast("long")).alias("n")))
        found = []
        for rule in rules:
            cost, bad = run(_with(many, rule.needs, None, set()).agg(F.sum(rule.fails(_c).cast("long")).alias("n")))
            found.append((rule.name, max(0.0, cost - empty), bad / n))
        return found
    finally:
        sample.unpersist()


def ordered(rules, figures: list[tuple[str, float, float]]) -> list[Rule]:
    """Rules by rejections per second, most first; those without rejections by cost."""
    at = {name: (-share / max(cost, 1e-9), cost) for name, cost, share in figures}
    return sorted(rules, key=lambda r: at[r.name])


def cascade(docs: DataFrame, rules=RULES, text: str = "text", figures=None, always: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``__q_rejected_by`` (null: kept) and the measures as ``__q_<measure>``.

    Measures of documents that an earlier rule has rejected are null, but for those that are to be made ``always``.
    ``figures`` replaces the estimate on a sample.
    """
    order = ordered(rules, estimate(docs, rules, text) if figures is None else figures)
    df = docs.withColumn(T + "text", F.coalesce(F.col(text), F.lit(""))).withColumn(T + "rejected_by", F.lit(None).cast("string"))
    done: set[str] = set()
    df = _with(df, always, None, done)
    for rule in order:
        open_ = _c("rejected_by").isNull()
        # measures shared with earlier rules were made under a wider condition, so they are there for all open rows
        df = _with(df, rule.needs, open_, done)
        df = df.withColumn(T + "rejected_by", F.when(open_ & rule.fails(_c), F.lit(rule.name)).otherwise(_c("rejected_by")))
    return df


def quality_filter(docs: DataFrame, rules=RULES, text: str = "text", figures=None) -> DataFrame:
    """Documents that no rule rejects, columns unchanged."""
    # a numbered row keeps the optimiser from rewriting the verdict into one condition that computes measures again
    judged = cascade(docs, rules, text, figures).withColumn(T + "row", F.monotonically_increasing_id())
    return judged.where(_c("rejected_by").isNull() & (_c("row") >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])


def measured(docs: DataFrame, text: str = "text", key: str = "doc_id", figures=None) -> DataFrame:
    """One row per document: all measures, ``base_failed`` by the two base rules and ``kept`` by the whole cascade."""
    df = cascade(docs.select(key, text), RULES, text, figures, REPORTED)
    base = F.lit(False)
    for rule in BASE:
        base = base | rule.fails(_c)
    return df.select(F.col(key), *[_c(m).alias(m) for m in REPORTED],
                     base.alias("base_failed"), _c("rejected_by").isNull().alias("kept"))
