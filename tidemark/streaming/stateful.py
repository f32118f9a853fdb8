"""Keyed stateful rules that run both on streams and, in one ordered pass, on tables.

A rule is a pair ``make_state() -> state`` and ``step(state, *inputs) -> (state,
outputs)``; outputs of None emit nothing. The state must survive JSON.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tidemark.series import scan


@dataclass(frozen=True)
class Rule:
    make_state: Callable
    step: Callable
    inputs: tuple[str, ...]
    outputs: tuple[tuple[str, str], ...]


CHUNK = 50_000  # rows of a bucket that are held in memory before they go to the state store
KEY, SLOT = "rule_key", "rule_slot"  # a leading underscore does not reach the processor
BUCKETS, SLOTS = 256, 64  # keys share a bucket, which is one group of the stream; their states share the slots of its map


class RuleProcessor(StatefulProcessor):
    """Applies a rule per key, in order of time, to the rows of a bucket of keys.

    A call per key and micro-batch costs milliseconds, so many keys with few rows come together; column ``KEY`` tells
    them apart (without it all rows are of one key) and ``SLOT`` the entry of the map that holds a key's state.
    Rows come in runs that know no order. Up to ``chunk`` of them are sorted in memory; beyond that they go to the state
    store by ``grain`` of time, and are taken from it one grain after the other. So a key may have any number of rows
    in a micro-batch; those of one grain must fit into memory. With ``timed`` every row waits for the watermark to
    pass its grain, and late rows find their place.
    """

    def __init__(self, rule: Rule, keep: Sequence[str], order: Sequence[str], grain: float = 3600.0, timed: bool = False, chunk: int = CHUNK):
        self.rule, self.keep, self.order = rule, list(keep), list(order)
        self.grain, self.timed, self.chunk = int(grain * 1000), timed, chunk

    def init(self, handle):
        self.handle = handle
        self.states = handle.getMapState("states", "slot int", "body string")
        self.runs = handle.getMapState("runs", "grain long", "n long")
        self.held = handle.getMapState("held", "grain long, run long", "body binary")
        self.loaded, self.changed = {}, set()

    def handleInputRows(self, key, rows, timerValues):
        waiting, n = [], 0
        for pdf in rows:
            if not len(pdf):
                continue
            waiting.append(pdf)
            n += len(pdf)
            if self.timed or n > self.chunk:
                self._hold(waiting)
                waiting, n = [], 0
        if self.timed:
            return
        if any(True for _ in self.runs.keys()):
            if waiting:
                self._hold(waiting)
            yield from self._drain(None)
        elif waiting:
            got = self._run(pd.concat(waiting))
            if len(got):
                yield got

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._drain(timerValues.getCurrentWatermarkInMs())

    def _slot(self, slot):
        """The states of a slot by key."""
        if slot not in self.loaded:
            self.loaded[slot] = json.loads(self.states.getValue((slot,))[0]) if self.states.containsKey((slot,)) else {}
        return self.loaded[slot]

    def _store(self):
        """Before anything is given out: the bucket may be another one after that."""
        for slot in self.changed:
            self.states.updateValue((slot,), (json.dumps(self.loaded[slot]),))
        self.loaded, self.changed = {}, set()

    def _hold(self, frames):
        pdf = pd.concat(frames)
        stamp = pd.to_datetime(pdf[self.order[0]])
        stamp = (stamp.dt.tz_localize(None) if stamp.dt.tz is not None else stamp).to_numpy().astype("datetime64[ms]").astype("int64")
        for grain, part in pdf.groupby(stamp // self.grain):
            grain = int(grain)
            run = self.runs.getValue((grain,))[0] if self.runs.containsKey((grain,)) else 0
            if run == 0 and self.timed:
                self.handle.registerTimer((grain + 1) * self.grain)
            self.held.updateValue((grain, run), (pickle.dumps(part, protocol=5),))
            self.runs.updateValue((grain,), (run + 1,))

    def _drain(self, upto):
        ready = sorted(g for (g,) in self.runs.keys() if upto is None or (g + 1) * self.grain <= upto)
        for grain in ready:
            n = self.runs.getValue((grain,))[0]
            rows = pd.concat([pickle.loads(bytes(self.held.getValue((grain, i))[0])) for i in range(n)])
            got = self._run(rows)
            if len(got):
                yield got
            for i in range(n):
                self.held.removeKey((grain, i))
            self.runs.removeKey((grain,))

    def _run(self, pdf):
        pdf = pdf.sort_values(self.order, kind="mergesort")
        keyed = KEY in pdf
        keys, slots = (pdf[KEY], pdf[SLOT].tolist()) if keyed else ([""] * len(pdf), [0] * len(pdf))
        emitted, made, now, home = [], [], {}, {}
        for i, (key, slot, *vals) in enumerate(zip(keys, slots, *[pdf[c] for c in self.rule.inputs])):
            if key not in now:
                held = self._slot(slot)
                now[key], home[key] = held[key] if key in held else self.rule.make_state(), slot
            now[key], out = self.rule.step(now[key], *vals)
            if out is not None:
                emitted.append(i)
                made.append(out)
        for key, state in now.items():
            self.loaded[home[key]][key] = state
        self.changed.update(home.values())
        self._store()
        got = pdf.iloc[emitted][self.keep].reset_index(drop=True)
        got = got.astype({c: object for c in got if pd.api.types.is_string_dtype(got[c])})  # rows from the store come in several Arrow chunks
        for j, (name, _) in enumerate(self.rule.outputs):
            got[name] = [m[j] for m in made]
        return got

    def close(self):
        pass


def _schema(df: DataFrame, keep, rule: Rule) -> T.StructType:
    return T.StructType([df.schema[c] for c in keep] + [
        T.StructField(n, T._parse_datatype_string(t)) for n, t in rule.outputs])


def apply_stream(df: DataFrame, rule: Rule, by: Sequence[str], keep: Sequence[str], order: Sequence[str],
                 delay: str | None = None, grain: float = 3600.0) -> DataFrame:
    """The rule as a stateful stream operator (needs the RocksDB state store).

    Without ``delay`` rows count when they arrive, in order inside a micro-batch. With it they count in order of time
    (the first of ``order``, a timestamp) once the watermark has passed their ``grain`` seconds, whenever they arrived before.
    """
    names = dict.fromkeys([*keep, *order, *rule.inputs])
    code = F.xxhash64(*by)
    rows = df.select(*names, F.to_json(F.array(*[F.col(c).cast("string") for c in by])).alias(KEY), F.pmod(code, F.lit(BUCKETS)).cast("int").alias("rule_bucket"),
                     F.pmod(F.floor(code / BUCKETS), F.lit(SLOTS)).cast("int").alias(SLOT))
    if delay is not None:
        rows = rows.withWatermark(order[0], delay)
    return rows.groupBy("rule_bucket").transformWithStateInPandas(
        RuleProcessor(rule, keep, order, grain, delay is not None), _schema(df, keep, rule), "Append", "None" if delay is None else "EventTime")


def apply_table(df: DataFrame, rule: Rule, by: Sequence[str], keep: Sequence[str], order: Sequence[str],
                **layout) -> DataFrame:
    """The same rule over a finished table."""
    silent = (None,) * len(rule.outputs)

    def step(state, *vals):
        state, out = rule.step(state, *vals)
        return state, (out is not None, *(silent if out is None else out))

    df = df.select(*dict.fromkeys([*by, *keep, *order, *rule.inputs]))  # blocks are held in Python: no other columns
    scanned = scan(df, by, order, rule.make_state, step, rule.inputs,
                   [("_emitted", "boolean"), *rule.outputs], **layout)
    return scanned.where("_emitted").select(*keep, *[F.col(n) for n, _ in rule.outputs])
