"""Ordered series per key, laid out so that one huge key is not one huge task.

A window with ``partitionBy(symbol)`` puts a whole symbol into one task. That is
the best plan while every symbol is small, and it fails when one symbol holds a
third of the table. ``open_series`` picks between two layouts of the same rows:

* whole: one window partition per key. Used when the row count of the largest
  key is known, or has been counted, to be at most ``block_rows``.
* blocked: every row gets its position in the key, positions are cut into blocks
  of ``block_rows`` rows, and each block also receives the ``back`` rows before
  it and the ``ahead`` rows after it. A row frame that reaches at most that far
  gives the same value in both layouts. ``close`` removes the borrowed rows.

Positions come from counts per (key, time bucket): the counts are aggregated on
the map side, their running total per key is tiny, and the row number inside a
bucket needs only that bucket. No step sees a whole key.

Unbounded frames (running sums, maxima, last non-null value) use ``running``,
which adds the totals of earlier blocks to the value inside the block.
"""

from __future__ import annotations

import functools
import json
import math
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage, shared_folder

BLOCK_ROWS = 1_000_000
SCAN_ROWS = 250_000  # rows of a block that a rule in Python holds at once
# Buckets are drawn finer than blocks so that busy hours still fit into a task.
BUCKETS_PER_BLOCK = 16
PARTS = 64  # folders of a scan's blocks
POS, BLOCK, OWN, BUCKET, OFFSET = "_pos", "_block", "_own", "_bucket", "_offset"


@dataclass(frozen=True)
class Series:
    df: DataFrame
    by: tuple[str, ...]
    order: tuple[str, ...]
    blocked: bool
    waiting: tuple = ()
    size: int = 0

    @property
    def keys(self) -> list[str]:
        return [*self.by, BLOCK] if self.blocked else list(self.by)

    @property
    def sort(self) -> list[str]:
        return [POS] if self.blocked else list(self.order)

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.sort)

    def rows(self, n: int) -> WindowSpec:
        """The current row and the n-1 rows before it."""
        return self.w.rowsBetween(-(n - 1), 0)

    def with_df(self, df: DataFrame) -> "Series":
        return replace(self, df=df)

    def later(self, fn: Callable, schema: Sequence[tuple[str, str]]) -> "Series":
        """Queue ``fn(block) -> columns`` for one shared pass over the ordered blocks.

        Window columns keep the key's partitioning, a pandas pass loses it. Running
        all queued functions in one pass after the windows needs no extra shuffle.
        A function may read the columns of functions queued before it.
        """
        return replace(self, waiting=(*self.waiting, (fn, tuple(schema))))

    def flush(self) -> "Series":
        """Run the queued functions."""
        if not self.waiting:
            return self
        fns = [f for f, _ in self.waiting]
        schema = [c for _, cols in self.waiting for c in cols]
        plain = replace(self, waiting=())

        def run(pdf):
            made = {}
            for f in fns:
                new = f(pdf)
                made |= new
                for k, v in new.items():
                    pdf[k] = v
            return made

        return per_block(plain, run, schema)

    def add(self, **cols: Column) -> "Series":
        return self.with_df(self.df.withColumns(cols))

    def owned(self, c: Column) -> Column:
        """The value on the block's own rows, null on borrowed ones."""
        return F.when(F.col(OWN), c) if self.blocked else c

    def close(self, *drop: str) -> DataFrame:
        if self.waiting:
            return self.flush().close(*drop)
        if not self.blocked:
            return self.df.drop(*drop)
        return self.df.where(F.col(OWN)).drop(POS, BLOCK, OWN, *drop)


def largest_key_rows(df: DataFrame, by: Sequence[str]) -> int:
    """Row count of the largest key: one map-side aggregated job, one row back."""
    row = df.groupBy(*by).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


def _same(a: str, keys: Iterable[str], left: DataFrame, right: DataFrame) -> Column:
    return functools.reduce(
        lambda x, y: x & y, (left[k].eqNullSafe(right[f"{a}{k}"]) for k in keys)
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which null keys match each other; the keys stay single."""
    renamed = right.select(
        *[F.col(k).alias(f"_jk_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    joined = left.join(renamed, _same("_jk_", keys, left, renamed), "left")
    return joined.drop(*[f"_jk_{k}" for k in keys])


def ordinal(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    raise TypeError(f"cannot cut {name} of type {kind.simpleString()} into buckets")


def with_position(
    df: DataFrame, by: Sequence[str], order: Sequence[str], block_rows: int, max_rows: int
) -> DataFrame:
    """Add the 1-based position of every row in its key, without a whole-key sort."""
    first = ordinal(df, order[0])
    lo, hi = df.agg(F.min(first), F.max(first)).first()
    if lo is None:
        lo = hi = 0.0
    pieces = max(1, math.ceil(max_rows / block_rows)) * BUCKETS_PER_BLOCK
    width = max((hi - lo) / pieces, 1e-9)
    bucket = F.coalesce(
        F.floor((first - F.lit(lo)) / F.lit(width)).cast("long"), F.lit(-1).cast("long")
    )
    df = df.withColumn(BUCKET, bucket)
    keys = [*by, BUCKET]
    before = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(OFFSET, F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        join_null_safe(df, offsets, keys)
        .withColumn(POS, F.col(OFFSET) + F.row_number().over(inside))
        .drop(OFFSET, BUCKET)
    )


def open_series(
    df: DataFrame,
    by: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("time",),
    back: int = 0,
    ahead: int = 0,
    max_rows: int | None = None,
    block_rows: int | None = None,
) -> Series:
    """Lay out ``df`` as ordered series.

    ``order`` must be a total order per key. ``back``/``ahead`` are how many rows
    the frames of the caller reach in total, nested frames added up. ``max_rows``
    is a proven bound on the rows of one key; without it the rows are counted.
    """
    by, order = tuple(by), tuple(order)
    size = block_rows or int(df.sparkSession.conf.get("spark.tidemark.blockRows", str(BLOCK_ROWS)))
    if max_rows is None:
        max_rows = largest_key_rows(df, by)
    if max_rows <= size:
        return Series(df, by, order, False)
    size = max(size, 4 * (back + ahead), 2)
    placed = with_position(df, by, order, size, max_rows)
    return Series(_cut(placed, size, back, ahead), by, order, True, size=size)


def _cut(placed: DataFrame, size: int, back: int, ahead: int) -> DataFrame:
    """Copy every row to its block and to the neighbours that borrow it."""
    zero = F.col(POS) - 1
    home = F.floor(zero / size).cast("long")
    inside = zero % size
    copies = F.array_compact(
        F.array(
            home,
            F.when(inside >= size - back, home + 1),
            F.when((inside < ahead) & (home > 0), home - 1),
        )
    )
    return (
        placed.withColumn("_home", home)
        .withColumn(BLOCK, F.explode(copies))
        .withColumn(OWN, F.col("_home") == F.col(BLOCK))
        .drop("_home")
    )


def reopen(s: Series, back: int = 0, ahead: int = 0) -> Series:
    """Borrow rows anew, so that frames may reach over running values."""
    s = s.flush()
    if not s.blocked:
        return s
    own = s.df.where(F.col(OWN)).drop(BLOCK, OWN)
    return s.with_df(_cut(own, s.size, back, ahead))


# --- frames -----------------------------------------------------------------


def full(s: Series, agg: Callable[[Column], Column], c: Column | str, n: int,
         need: int | None = None) -> Column:
    """Frame aggregate over n rows, null until ``need`` (default n) values are there."""
    c = F.col(c) if isinstance(c, str) else c
    frame = s.rows(n)
    return F.when(F.count(c).over(frame) >= (need or n), agg(c).over(frame))


def mean(s: Series, c, n: int) -> Column:
    return full(s, F.avg, c, n)


def total(s: Series, c, n: int) -> Column:
    return full(s, F.sum, c, n)


def std(s: Series, c, n: int) -> Column:
    return full(s, F.stddev_samp, c, n, n)


def highest(s: Series, c, n: int) -> Column:
    return full(s, F.max, c, n)


def lowest(s: Series, c, n: int) -> Column:
    return full(s, F.min, c, n)


def lag(s: Series, c, n: int = 1) -> Column:
    return F.lag(c, n).over(s.w)


def lead(s: Series, c, n: int = 1) -> Column:
    return F.lead(c, n).over(s.w)


def ratio(a, b) -> Column:
    """a/b as double, null where b is 0."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.try_divide(a.cast("double"), b.cast("double"))


def change(s: Series, c: str, n: int = 1) -> Column:
    """Relative change over n rows; gaps are not padded."""
    return ratio(F.col(c), lag(s, c, n)) - 1


def frame_corr(s: Series, x: str, y: str, n: int) -> tuple[Column, Column, Column]:
    """(correlation, covariance, variance of y) over n complete pairs.

    Built from moments so that a constant frame gives null instead of an error.
    """
    frame = s.rows(n)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    px, py = F.when(both, F.col(x)), F.when(both, F.col(y))
    enough = F.count(px).over(frame) >= n
    cov = F.covar_samp(px, py).over(frame)
    sx, sy = F.stddev_samp(px).over(frame), F.stddev_samp(py).over(frame)
    corr = F.when(enough & (sx > 0) & (sy > 0), ratio(cov, sx * sy))
    return corr, F.when(enough, cov), F.when(enough, F.var_samp(py).over(frame))


# --- unbounded frames --------------------------------------------------------

_RUN = {
    "sum": (F.sum, lambda a, b: a + b),
    "count": (F.count, lambda a, b: a + b),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def compounded(s: Series, name: str, change: Column, prefix: str) -> Series:
    """Running product of 1 + change: logarithms of the sizes, a count of negative factors for the sign, and zero from the
    first factor that is zero. Null changes count as none."""
    x = F.lit(1.0) + change
    s = running(s, **{f"{prefix}_log": ("sum", F.when(x != 0, F.log(F.abs(x)))), f"{prefix}_neg": ("sum", F.when(x < 0, 1.0).otherwise(0.0)),
                      f"{prefix}_zero": ("max", F.when(x == 0, 1.0).otherwise(0.0))})
    sign = F.when(F.col(f"{prefix}_neg") % 2 == 1, -1.0).otherwise(1.0)
    return s.add(**{name: F.when(F.col(f"{prefix}_zero") > 0, 0.0).otherwise(sign * F.exp(F.coalesce(f"{prefix}_log", F.lit(0.0))))})


def running(s: Series, **what: tuple[str, Column]) -> Series:
    """Add running aggregates from the first row of the key to the current row.

    ``what`` maps a column name to (kind, expression) with kind one of sum, count,
    max, min, last. In the blocked layout only block totals cross block borders, and
    the results hold on a block's own rows: ``reopen`` before framing them.
    """
    upto = s.w.rowsBetween(Window.unboundedPreceding, 0)
    if not s.blocked:
        return s.with_df(
            s.df.withColumns({k: _RUN[kind][0](c).over(upto) for k, (kind, c) in what.items()})
        )
    # Borrowed rows are left out: their block counts them, and an expression that
    # looks back may not be right on the first of them.
    df = s.df.withColumns({f"_in_{k}": s.owned(c) for k, (_, c) in what.items()})

    def total_of(kind: str, name: str) -> Column:
        c = F.col(name)
        return F.max_by(c, F.when(c.isNotNull(), F.col(POS))) if kind == "last" else _RUN[kind][0](c)

    totals = df.where(F.col(OWN)).groupBy(*s.keys).agg(
        *[total_of(kind, f"_in_{k}").alias(f"_tot_{k}") for k, (kind, _) in what.items()])
    before = Window.partitionBy(*s.by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    merge = {k: "sum" if kind == "count" else kind for k, (kind, _) in what.items()}
    carried = totals.select(*s.keys, *[
        _RUN[kind][0](F.col(f"_tot_{k}")).over(before).alias(f"_car_{k}") for k, kind in merge.items()])
    df = join_null_safe(df, carried, s.keys)
    df = df.withColumns({
        k: _merge(merge[k], F.col(f"_car_{k}"), _RUN[kind][0](F.col(f"_in_{k}")).over(upto))
        for k, (kind, _) in what.items()})
    return s.with_df(df.drop(*[f"{p}{k}" for k in what for p in ("_in_", "_car_")]))


def _merge(kind: str, earlier: Column, later: Column) -> Column:
    """Combine two running values, either of which may be null."""
    both = _RUN[kind][1](earlier, later)
    return both if kind == "last" else F.when(earlier.isNull(), later).when(later.isNull(), earlier).otherwise(both)


# --- exponential means -------------------------------------------------------


def ewm_reach(alpha: float) -> int:
    """Rows after which an older value weighs less than 1e-18, below double precision."""
    return math.ceil(41.5 / -math.log1p(-alpha)) if alpha < 1 else 1


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1)


def per_block(s: Series, fn: Callable, schema: Sequence[tuple[str, str]]) -> Series:
    """Run ``fn(pdf)`` on each ordered block; it returns the new columns as a dict.

    A block has at most ``block_rows`` rows plus the borrowed ones, so the pandas
    frame is bounded. Exponential means borrow ``ewm_reach`` rows per level.
    """
    have = s.df.schema
    out = T.StructType(list(have.fields) + [
        T.StructField(n, T.DoubleType() if t == "double" else T._parse_datatype_string(t))
        for n, t in schema
    ])
    sort, names = s.sort, [n for n, _ in schema]

    def run(pdf):
        pdf = pdf.sort_values(sort, kind="mergesort")
        for k, v in fn(pdf).items():
            pdf[k] = v
        return pdf[[f.name for f in have.fields] + names]

    return s.with_df(s.df.groupBy(*s.keys).applyInPandas(run, out))


def ewm_columns(s: Series, **what: tuple[str, float, bool]) -> Series:
    """Queue exponential means: name -> (column, alpha, adjust).

    Later entries may read earlier ones. Call ``flush`` before using them in
    expressions; ``close`` does it by itself.
    """

    def fn(pdf):
        made = {}
        for name, (src, alpha, adjust) in what.items():
            col = made[src] if src in made else pdf[src]
            made[name] = col.ewm(alpha=alpha, adjust=adjust).mean()
        return made

    return s.later(fn, [(k, "double") for k in what])


# --- inherently sequential rules ----------------------------------------------


def ordered_scan(
    df: DataFrame, by: Sequence[str], order: Sequence[str], make_state: Callable,
    step: Callable, inputs: Sequence[str], outputs: Sequence[tuple[str, str]],
) -> DataFrame:
    """Feed each key's rows in order through ``step(state, *inputs) -> (state, outputs)``.

    For rules whose next state depends on the last one in a non-associative way.
    Rows stream through the task batch by batch and only the state is held, so the
    memory is constant however long a key is; parallelism is the number of keys.
    """
    have = list(df.schema.fields)
    out = T.StructType(have + [
        T.StructField(n, T._parse_datatype_string(t)) for n, t in outputs
    ])
    by, inputs = list(by), list(inputs)
    names = [n for n, _ in outputs]

    def run(batches):
        key, state = object(), None
        for pdf in batches:
            made = []
            keys = list(zip(*[pdf[k] for k in by]))
            for k, row in zip(keys, zip(*[pdf[c] for c in inputs])):
                if k != key:
                    key, state = k, make_state()
                state, vals = step(state, *row)
                made.append(vals)
            for i, n in enumerate(names):
                pdf[n] = [m[i] for m in made]
            yield pdf

    placed = df.repartition(*by).sortWithinPartitions(*by, *order)
    return placed.mapInPandas(run, out)


def scan(
    df: DataFrame, by: Sequence[str], order: Sequence[str], make_state: Callable, step: Callable,
    inputs: Sequence[str], outputs: Sequence[tuple[str, str]], warm: int = 1000,
    max_rows: int | None = None, block_rows: int | None = None, guesses: int = 2,
) -> DataFrame:
    """A sequential rule over every key, in parallel inside large keys too.

    Small keys go through ``ordered_scan``. A large key is cut into blocks, and a block is summed up by the state it
    ends in for a state it starts from. All blocks are first run from a fresh state ``warm`` rows early: such rules
    soon forget where they started. The summaries of a key are then composed from its first block on; where the state that a
    block is reached in has no summary yet, the block is run from that state, and blocks behind it from the likeliest one,
    ``guesses`` times at most. Only states are kept until the whole way is known, so rows are written once, and a block is
    run a bounded number of times whatever the rule: the result is the sequential one.
    """
    size = block_rows or min(SCAN_ROWS, int(df.sparkSession.conf.get("spark.tidemark.blockRows", str(BLOCK_ROWS))))
    s = open_series(df, by, order, back=warm, max_rows=max_rows, block_rows=size)
    if not s.blocked:
        return ordered_scan(df, by, order, make_state, step, inputs, outputs)
    by, inputs, names, key_names = list(by), list(inputs), [n for n, _ in outputs], list(s.keys)
    have = [f for f in s.df.schema.fields if f.name != OWN]
    keys = T.StructType([s.df.schema[k] for k in s.keys])
    text = T.StringType()

    def started(pdf):
        """The state before the block's own rows, and those rows."""
        pdf = pdf.sort_values(POS)
        own = pdf[pdf[OWN]]
        start = pdf["_start"].iloc[0]
        if isinstance(start, str):
            return json.loads(start), own
        state = make_state()
        for row in zip(*[pdf[~pdf[OWN]][c] for c in inputs]):
            state, _ = step(state, *row)
        return state, own

    def summed(pdf):
        state, own = started(pdf)
        got = own.iloc[:1][key_names].copy()
        got["_entry"] = json.dumps(state)
        for row in zip(*[own[c] for c in inputs]):
            state, _ = step(state, *row)
        got["_exit"] = json.dumps(state)
        return got

    def composed(pdf):
        """The way through a key's blocks: the state each one is reached in, if known, and what to run next."""
        known: dict = {}
        for block, entry, leave in zip(pdf[BLOCK], pdf["_entry"], pdf["_exit"]):
            known.setdefault(int(block), {})[entry] = leave
        rows, sure, state = [], True, None
        for block in sorted(known):
            each = known[block]
            if state is None:
                state = next(iter(each))  # the first block starts fresh
            run = state not in each and (sure or len(each) <= guesses)
            rows.append((block, state if sure else None, state if run else None))
            sure = sure and state in each
            state = each[state] if state in each else list(each.values())[-1]
        got = pdf.iloc[[0] * len(rows)][by].reset_index(drop=True)
        got[BLOCK] = [r[0] for r in rows]
        got["_sure"], got["_start"] = [r[1] for r in rows], [r[2] for r in rows]
        return got

    # blocks lie in parts of their own, so that a later round reads the parts with open blocks only
    path = f"{shared_folder(df.sparkSession)}/blocks-{uuid.uuid4().hex}"
    s.df.withColumn("_part", F.pmod(F.col(BLOCK), F.lit(PARTS)).cast("int")).write.partitionBy("_part").parquet(path)
    rows = df.sparkSession.read.schema(T.StructType([*s.df.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(path)
    summary = T.StructType([*keys.fields, T.StructField("_entry", text), T.StructField("_exit", text)])
    way = T.StructType([*keys.fields, T.StructField("_sure", text), T.StructField("_start", text)])
    held = cut_lineage(rows.drop("_part").withColumn("_start", F.lit(None).cast("string")).groupBy(*s.keys).applyInPandas(summed, summary))
    while True:
        walk = cut_lineage(held.groupBy(*by).applyInPandas(composed, way))
        todo = walk.where(F.col("_start").isNotNull()).select(*s.keys, "_start")
        parts = [r[0] for r in todo.select(F.pmod(F.col(BLOCK), F.lit(PARTS)).cast("int")).distinct().collect()]  # PARTS at most
        if not parts:
            break
        again = join_null_safe(rows.where(F.col("_part").isin(parts)).drop("_part"), todo, s.keys).where(F.col("_start").isNotNull())
        held = cut_lineage(held.unionByName(again.groupBy(*s.keys).applyInPandas(summed, summary)))

    def written(pdf):
        state, own = started(pdf)
        made = []
        for row in zip(*[own[c] for c in inputs]):
            state, vals = step(state, *row)
            made.append(vals)
        own = own[[f.name for f in have]].copy()
        for i, n in enumerate(names):
            own[n] = [m[i] for m in made]
        return own

    out = T.StructType(have + [T.StructField(n, T._parse_datatype_string(t)) for n, t in outputs])
    starts = walk.select(*s.keys, F.col("_sure").alias("_start"))
    done = join_null_safe(rows.drop("_part"), starts, s.keys).groupBy(*s.keys).applyInPandas(written, out)
    return done.drop(POS, BLOCK)
