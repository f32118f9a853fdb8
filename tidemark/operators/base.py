"""Turns a rule over a laid-out series into a DataFrame operator."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame

from tidemark.series import open_series

LAYOUT = ("by", "order", "max_rows", "block_rows")


def series_operator(reach, ahead=None):
    """Decorate ``fn(series, **params) -> series``.

    ``reach`` (and ``ahead``) give, from the same parameters, how many rows the
    frames look back (ahead). The result takes a DataFrame plus the layout
    arguments of ``open_series``; ``op.on(series)`` reuses an open layout, which
    lets composite operators share one shuffle and one sort. Helper columns start
    with ``_x`` and are dropped.
    """

    def wrap(fn):
        def back(**kw):
            return reach(**kw) if callable(reach) else reach

        def front(**kw):
            return (ahead(**kw) if callable(ahead) else ahead) or 0

        @functools.wraps(fn)
        def op(df: DataFrame, **kw) -> DataFrame:
            layout = {k: kw.pop(k) for k in LAYOUT if k in kw}
            s = open_series(df, back=back(**kw), ahead=front(**kw), **layout)
            out = fn(s, **kw).close()
            return out.drop(*[c for c in out.columns if c.startswith("_x")])

        op.on, op.reach, op.ahead = fn, back, front
        return op

    return wrap
