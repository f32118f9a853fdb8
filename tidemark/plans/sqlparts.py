"""Text pieces shared by the SQL twins."""

from __future__ import annotations

P = "PARTITION BY symbol ORDER BY time"


def win(n: int, part: str = P) -> str:
    return f"({part} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(fn: str, col: str, n: int, part: str = P) -> str:
    return f"(CASE WHEN count({col}) OVER {win(n, part)} >= {n} THEN {fn}({col}) OVER {win(n, part)} END)"


def avg(col, n, part=P):
    return roll("avg", col, n, part)


def sd(col, n, part=P):
    return roll("stddev_samp", col, n, part)


def lag(col, n=1, part=P):
    return f"lag({col}, {n}) OVER ({part})"


def lead(col, n=1, part=P):
    return f"lead({col}, {n}) OVER ({part})"


def chg(col, n=1, part=P):
    return f"(CAST({col} AS DOUBLE) / nullif({lag(col, n, part)}, 0) - 1)"


def ema_cte(name: str, src: str, cols: dict[str, tuple[str, int]], adjust=False, part=P) -> str:
    """CTE with exponential means in closed form: out -> (column, span)."""
    sel = []
    for out, (col, span) in cols.items():
        r = f"(CAST({span - 1} AS DOUBLE) / {span + 1})"
        w0 = "1" if adjust else f"(CASE WHEN _k = 0 THEN 1 ELSE CAST(2 AS DOUBLE) / {span + 1} END)"
        num = f"pow({r}, _k) * sum({col} * {w0} * pow({r}, -_k)) OVER ({part})"
        den = f" / (pow({r}, _k) * sum(pow({r}, -_k)) OVER ({part}))" if adjust else ""
        sel.append(f"{num}{den} AS {out}")
    return (f"{name} AS (SELECT * EXCLUDE (_k), {', '.join(sel)} FROM "
            f"(SELECT *, row_number() OVER ({part}) - 1 AS _k FROM {src}))")



def gains(src: str, name: str = "g", col: str = "close", part=P) -> str:
    d = f"({col} - {lag(col, 1, part)})"
    return (f"{name} AS (SELECT *, CASE WHEN {d} > 0 THEN {d} ELSE 0 END AS gain, "
            f"CASE WHEN {d} < 0 THEN -{d} ELSE 0 END AS loss FROM {src})")


def rsi(n: int, part=P) -> str:
    g, lo = avg("gain", n, part), avg("loss", n, part)
    return (f"(CASE WHEN {lo} > 0 THEN 100 - 100 / (1 + {g} / {lo}) "
            f"WHEN {g} > 0 THEN CAST(100 AS DOUBLE) END)")


TR = ("greatest(high - low, abs(high - " + lag("close") + "), abs(low - " + lag("close") + "))")
