"""Places for user code: strategies, rules, scorers, row processors, objectives."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.performance import signal_backtest

Strategy = Callable[[DataFrame], DataFrame]
Rule = tuple[str, Callable[[], Column]]


def backtest_strategy(bars: DataFrame, strategy: Strategy, **kw) -> DataFrame:
    """Run a user strategy that returns symbol, time and ``signal`` (BUY, SELL or HOLD)."""
    way = F.when(F.col("signal").isin("BUY", "STRONG_BUY"), 1).when(F.col("signal").isin("SELL", "STRONG_SELL"), -1).otherwise(0)
    signals = strategy(bars).select("symbol", "time", way.alias("direction"))
    return signal_backtest(bars.join(signals, ["symbol", "time"], "left"), **kw)


def apply_rules(rows: DataFrame, rules: list[Rule], key: str = "symbol", time: str = "time") -> DataFrame:
    """One alert row per row and user rule whose column is true."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(make(), F.lit(False)), F.lit(name)) for name, make in rules]))
    return rows.select(key, time, F.explode(hits).alias("rule"))


def score_texts(df: DataFrame, scorer: Callable[[list[str]], Iterable[tuple[float, float, float]]],
                text: str = "text", batch: int = 16) -> DataFrame:
    """Append positive, negative and neutral from any Python scorer called on batches of texts. Rows stay in Arrow, so only
    one batch of texts at a time is a list in Python."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    names = ("positive", "negative", "neutral")

    def run(frames):
        for rows in frames:
            texts, scores = rows.column(text), [array("d") for _ in names]
            for i in range(0, len(texts), batch):
                for got in scorer([t or "" for t in texts.slice(i, batch).to_pylist()]):
                    for held, score in zip(scores, got):
                        held.append(float(score))
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(np.asarray(x), from_pandas=True) for x in scores)], names=[*rows.schema.names, *names])

    return df.mapInArrow(run, schema + ", positive double, negative double, neutral double")


def process_rows(df: DataFrame, fn: Callable[[dict], object], out: str = "result", kind: str = "double") -> DataFrame:
    """Apply ``fn`` to every row; a failing row keeps its error text and the job goes on."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def one(row):
        try:
            return fn(row), None
        except Exception as e:  # the error is part of the result
            return None, f"{type(e).__name__}: {e}"

    def run(frames):
        for pdf in frames:
            got = [one(r) for r in pdf.to_dict("records")]
            yield pdf.assign(**{out: pd.Series([g[0] for g in got], index=pdf.index),
                                "error": pd.Series([g[1] for g in got], index=pdf.index, dtype=object)})

    return df.mapInPandas(run, f"{schema}, {out} {kind}, error string")


def evaluate(df: DataFrame, objective: Callable[..., DataFrame], grid: list[dict]) -> DataFrame:
    """Union of ``objective(df, **params)`` tables over the parameter sets, each stamped with its set."""
    out = None
    for i, params in enumerate(grid):
        part = objective(df, **params).withColumn("param_id", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out
