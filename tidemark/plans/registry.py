"""Registered queries with their SQL twins.

A query is declared once with an output spec ``"raw | double | bigint"``: raw
columns pass through, doubles are rounded on both sides, integers are widened on
both sides. That keeps the two results comparable value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import utc


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def _split(spec: str) -> tuple[list[str], list[str], list[str]]:
    parts = [p.split() for p in spec.split("|")]
    parts += [[]] * (3 - len(parts))
    return parts[0], parts[1], parts[2]


def shape(df: DataFrame, spec: str, dp: int = 6) -> DataFrame:
    raw, doubles, longs = _split(spec)
    return df.select(
        *raw,
        *[(F.round(F.col(c).cast("double"), dp) + F.lit(0.0)).alias(c) for c in doubles],
        *[F.col(c).cast("long").alias(c) for c in longs],
    )


def shape_sql(ctes: str, body: str, spec: str, dp: int = 6) -> str:
    raw, doubles, longs = _split(spec)
    cols = [*raw]
    cols += [f"round(CAST({c} AS DOUBLE), {dp}) + CAST(0 AS DOUBLE) AS {c}" for c in doubles]
    cols += [f"CAST({c} AS BIGINT) AS {c}" for c in longs]
    head = f"WITH {ctes}\n" if ctes else ""
    return f"{head}SELECT {', '.join(cols)} FROM (\n{body}\n) AS answer"


def query(name: str, spec: str, sql: str | None = None, ctes: str = "", dp: int = 6):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shape(fn(utc(spark), sf_dir), spec, dp)

        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Entry(run, None if sql is None else shape_sql(ctes, sql, spec, dp))
        return fn

    return wrap
