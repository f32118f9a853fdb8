"""Title de-duplication against the scan over the full similarity matrix."""

import math
import random
import re
from collections import Counter

import pytest

from tidemark.operators import dedup as DD


def brute(titles, threshold=0.8, stop=tuple(DD.STOP_WORDS)):
    bags = []
    for t in titles:
        w = [x for x in re.findall(r"(?u)\b\w\w+\b", t.lower()) if x not in stop]
        bags.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    n, df = len(bags), Counter(t for b in bags for t in b)
    vecs = []
    for b in bags:
        v = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in b.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        vecs.append({t: x / norm for t, x in v.items()})
    kept, seen = [], set()
    for i in range(n):
        if i in seen:
            continue
        kept.append(i)
        for j in range(n):
            if j != i and sum(x * vecs[j].get(t, 0.0) for t, x in vecs[i].items()) > threshold:
                seen.add(j)
    return kept


@pytest.fixture(scope="module")
def titles():
    rng = random.Random(5)
    words = [f"word{i}" for i in range(60)]
    out = []
    base = " ".join(rng.choice(words) for _ in range(9))
    for i in range(160):
        if i % 3 == 0:  # a third of all rows: exact copies and one-word variants of one title
            t = base.split()
            if i % 6 == 0:
                t[rng.randrange(9)] = rng.choice(words)
            out.append(" ".join(t))
        elif i % 17 == 0:
            out.append("the of and" if i % 2 else "")
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.randrange(3, 10))))
    return out


@pytest.mark.parametrize("block", [2, 512])
def test_greedy_is_exact(spark, titles, block):
    df = spark.createDataFrame(list(enumerate(titles)), "doc_id long, title string")
    got = sorted(r["doc_id"] for r in DD.tfidf_dedup(df, block=block).collect())
    assert got == brute(titles)


def crowd(n):
    """n unlike titles that share a term heavy enough for their index, and a tenth as many near copies of one title."""
    rows = ["common " * 16 + f"own{i}" for i in range(n)]
    return rows + ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda " + ("sigma" if i % 2 else "omega") for i in range(n // 10)]


def test_crowded_term_of_unlike_titles(spark):
    jobs = {}
    for n in (200, 5000):
        rows = crowd(n)
        df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, title string").repartition(8)
        spark.sparkContext.setJobGroup(f"crowd-{n}", "titles")
        got = sorted(r["doc_id"] for r in DD.tfidf_dedup(df, block=256).collect())
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"crowd-{n}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert got == (brute(rows) if n == 200 else [*range(n), n])
    assert jobs[5000] <= jobs[200] + 10


def test_ids_need_not_be_numbers(spark, titles):
    names = [f"t{i:04d}" for i in range(len(titles))]
    df = spark.createDataFrame(list(zip(names, titles)), "doc_id string, title string")
    assert sorted(r["doc_id"] for r in DD.tfidf_dedup(df).collect()) == [names[i] for i in brute(titles)]


def test_terms_are_counted_inside_their_bag(spark):
    """Repeats, weights and the norm left behind each term, rarest first; terms are shuffled by term and by text only."""
    titles = ["gold gold gold price gold", "price of gold", "", None, "the of", "silver gold silver gold silver", "price of gold"]
    groups, weights = DD.tfidf_vectors(spark.createDataFrame(list(enumerate(titles)), "doc_id long, title string"), "doc_id", "title")
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3
    bags = {i: [w for w in (t or "").split() if w not in DD.STOP_WORDS] for i, t in enumerate(titles)}
    bags = {i: Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for i, w in bags.items()}
    df = Counter(t for bag in bags.values() for t in bag)
    want = {}
    for i in (0, 1, 5):
        raw = {t: n * (math.log((1 + len(titles)) / (1 + df[t])) + 1) for t, n in bags[i].items()}
        norm, left = sum(x * x for x in raw.values()), 1.0
        for t in sorted(raw, key=lambda t: (df[t], t)):
            want[i, t] = (df[t], raw[t] / math.sqrt(norm), left)
            left -= raw[t] ** 2 / norm
    got = {(r["lead"], r["term"]): (r["df"], r["w"], r["rest"]) for r in weights.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert groups.count() == 5
