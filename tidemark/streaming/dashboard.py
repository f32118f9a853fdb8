"""The live sentiment dashboard as a stream."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tidemark.operators.sentiment import LAST, SPAN, STEP, dashboard_columns

SUMS = ("n", "s", "x", "p", "q")  # rows, scores, their sum, positive and negative rows
HELD = 20_000  # steps held before they go to the state store, and ends given at once
PART = "n long, s long, x double, p long, q long, last array<struct<at:long,tie:long,score:double,label:int>>"
ROW = "until timestamp, n long, avg double, bull double, bear double, held long, newer double, older double"


def _summed(by: Sequence[str]):
    """Sums and the newest rows per key and step of each Arrow batch, before anything is shuffled."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.sort_values([*by, "step", "at", "tie"]).reset_index(drop=True)
            group = pdf.groupby([*by, "step"], dropna=False, sort=False).ngroup().to_numpy()
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            stop = np.r_[first[1:], len(pdf)]
            score = pdf["score"].to_numpy(dtype=float)
            there, label = ~np.isnan(score), pdf["label"].to_numpy()
            each = [{"at": a, "tie": t, "score": x if k else None, "label": m}
                    for a, t, x, k, m in zip(pdf["at"].tolist(), pdf["tie"].tolist(), score.tolist(), there.tolist(), label.tolist())]
            got = pdf.iloc[first][[*by, "step"]].reset_index(drop=True)
            got["time"] = pdf["time"].iloc[stop - 1].reset_index(drop=True)
            got["n"] = stop - first
            for name, values in (("s", there), ("x", np.where(there, score, 0.0)), ("p", label > 0), ("q", label < 0)):
                got[name] = np.add.reduceat(values if name == "x" else values.astype("int64"), first)
            got["last"] = [each[max(a, b - LAST) : b] for a, b in zip(first.tolist(), stop.tolist())]
            yield got

    return run


def _mean(rows):
    scores = [r[2] for r in rows if r[2] is not None]
    return sum(scores) / len(scores) if scores else None


def _merged(a, b):
    """Sums and last rows of a step that came in two parts."""
    return [[x + y for x, y in zip(a[0], b[0])], sorted(a[1] + b[1], key=lambda r: r[:2])[-LAST:]]


class DashboardProcessor(StatefulProcessor):
    """Sums of the steps inside the span and the last ten rows of a key; a step waits for the watermark.

    The state holds a row per step, never the news themselves, so its size has a bound whatever a key sends: the steps of
    the span, those the watermark has not passed, and ten rows in each. Waiting steps lie together by span, and a
    key has one timer, for the first end to come, so calls of the state grow with the spans and not with the steps.
    """

    def __init__(self, by: Sequence[str], every: int, span: int):
        self.by, self.every, self.width = list(by), every * 1000, span // every

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("state", "body string")
        self.timer = handle.getValueState("timer", "at long")
        self.waiting = handle.getMapState("waiting", "span long", "body string")

    def handleInputRows(self, key, rows, timerValues):
        new, least = {}, None
        for pdf in rows:
            for step, n, s, x, p, q, last in zip(pdf["step"], *[pdf[c] for c in SUMS], pdf["last"]):
                step, sums = int(step), [int(n), int(s), float(x), int(p), int(q)]
                last = [[r["at"], r["tie"], r["score"], r["label"]] for r in last]
                new[step] = _merged(new[step], [sums, last]) if step in new else [sums, last]
            if new:
                least = min(new) if least is None else min(least, min(new))
            if len(new) > HELD:
                self._hold(new)
                new = {}
        self._hold(new)
        if least is not None:
            self._wake((least + 1) * self.every)
        return iter(())

    def _hold(self, new):
        spans = {}
        for step, body in new.items():
            spans.setdefault(step // self.width, {})[step] = body
        for span, steps in spans.items():
            if self.waiting.containsKey((span,)):
                held = {int(k): v for k, v in json.loads(self.waiting.getValue((span,))[0]).items()}
                steps = held | {k: _merged(held[k], v) if k in held else v for k, v in steps.items()}
            self.waiting.updateValue((span,), (json.dumps(steps),))

    def _wake(self, at):
        """Leaves one timer, at the earlier of its time and ``at``."""
        now = self.timer.get()[0] if self.timer.exists() else None
        if now is None or at < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.clear()
        upto = timerValues.getCurrentWatermarkInMs() // self.every
        steps, last, nxt = json.loads(self.state.get()[0]) if self.state.exists() else ([], [], None)
        steps, runs, wake = deque(steps), [], []

        def shown(limit):
            """Ends up to ``limit``, as runs of ends with the same figures; the first one without news shows the last rows and
            is the last for now."""
            nonlocal nxt
            while nxt is not None and nxt <= limit:
                while steps and steps[0][0] < nxt - self.width:
                    steps.popleft()
                if steps:
                    n, s, x, p, q = (sum(c) for c in list(zip(*steps))[1:])
                    avg, upto = x / s if s else None, min(limit, steps[0][0] + self.width)
                else:
                    n, avg, upto = len(last), _mean(last), nxt
                    p, q = sum(r[3] > 0 for r in last), sum(r[3] < 0 for r in last)
                runs.append((nxt, upto, n, avg, p / n, q / n, len(last), _mean(last[-5:]), _mean(last[:5])))
                nxt = upto + 1 if steps else None

        for span in sorted(k for (k,) in self.waiting.keys() if k * self.width < upto):
            held = {int(k): v for k, v in json.loads(self.waiting.getValue((span,))[0]).items()}
            for step in sorted(k for k in held if k < upto):
                shown(step)
                sums, new = held.pop(step)
                steps.append([step, *sums])
                last, nxt = (last + new)[-LAST:], step + 1
            if held:
                self.waiting.updateValue((span,), (json.dumps(held),))
                wake.append((min(held) + 1) * self.every)
            else:
                self.waiting.removeKey((span,))
            if sum(r[1] - r[0] for r in runs) > HELD:
                yield self._rows(key, runs)
                runs.clear()
        shown(upto)
        self.state.update((json.dumps([list(steps), last, nxt]),))
        if nxt is not None:
            wake.append(nxt * self.every)
        later = [k for (k,) in self.waiting.keys() if k * self.width >= upto]
        if later and not (nxt is not None and nxt <= min(later) * self.width):
            held = json.loads(self.waiting.getValue((min(later),))[0])
            wake.append((min(int(k) for k in held) + 1) * self.every)
        if wake:
            self._wake(min(wake))
        if runs:
            yield self._rows(key, runs)

    def _rows(self, key, runs):
        first, stop, *figures = zip(*runs)
        first, n = np.array(first), np.array(stop) - np.array(first) + 1
        at = np.repeat(np.arange(len(n)), n)
        ends = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + first[at]
        got = pd.DataFrame({"until": pd.to_datetime(ends * self.every, unit="ms")})
        for name, values in zip(("n", "avg", "bull", "bear", "held", "newer", "older"), figures):
            got[name] = np.array(values, dtype="int64" if name in ("n", "held") else "float64")[at]
        for i, (name, value) in enumerate(zip(self.by, key)):
            got.insert(i, name, value)
        return got

    def close(self):
        pass


def live_dashboard(news: DataFrame, every: int = STEP, span: int = SPAN, by: Sequence[str] = ("symbol",), tie: Column | None = None,
                   delay: str = "10 minutes") -> DataFrame:
    """``operators.sentiment.live_dashboards`` on a stream (needs the RocksDB state store).

    ``news`` has time, score and label. Each end of a step is given once, when the watermark has passed it. ``tie`` is a
    whole number that orders news of one time. News are added up per key and step before the shuffle, so a key with a
    third of all news sends one row per step and Arrow batch.
    """
    by = list(by)
    at = F.unix_micros(F.col("time").cast("timestamp"))
    label = F.when(F.col("label") == "positive", 1).when(F.col("label") == "negative", -1).otherwise(0)
    rows = news.where(F.col("time").isNotNull()).select(
        *by, "time", F.floor(at / (every * 1_000_000)).cast("long").alias("step"), at.alias("at"),
        (F.lit(0) if tie is None else tie).cast("long").alias("tie"), F.col("score").cast("double").alias("score"), label.alias("label"))
    keys = [rows.schema[c] for c in by]
    part = T.StructType([*keys, rows.schema["step"], rows.schema["time"], *T._parse_datatype_string(PART).fields])
    sums = rows.mapInPandas(_summed(by), part).withWatermark("time", delay)
    shown = sums.groupBy(*by).transformWithStateInPandas(
        DashboardProcessor(by, every, span), T.StructType([*keys, *T._parse_datatype_string(ROW).fields]), "Append", "EventTime")
    return shown.select(*by, "until", *dashboard_columns(*[F.col(c) for c in ("n", "avg", "bull", "bear", "held", "newer", "older")]))
