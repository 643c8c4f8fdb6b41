"""Building blocks of the SQL that stands beside each registered query."""

from __future__ import annotations

AGG = {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "std": "stddev_samp"}


def lag(x: str, k: int, by: str = "region") -> str:
    f, k = ("lag", k) if k >= 0 else ("lead", -k)
    return f"{f}({x}, {k}) over (partition by {by} order by ts)"


def frame(w: int, shift: int = 0, by: str = "region") -> str:
    return f"over (partition by {by} order by ts rows between {w - 1 + shift} preceding and {shift} preceding)"


def roll(agg: str, x: str, w: int, least: int | None = None, shift: int = 0) -> str:
    f = frame(w, shift)
    return f"case when count({x}) {f} >= {w if least is None else least} then {AGG[agg]}({x}) {f} end"


def flag(condition: str) -> str:
    return f"case when {condition} then 1.0 else 0.0 end"


def clip(x: str, low: float | None = None, high: float | None = None) -> str:
    y = f"({x})"
    y = f"least({y}, {high})" if high is not None else y
    y = f"greatest({y}, {low})" if low is not None else y
    return f"case when ({x}) is not null then {y} end"


def asinh(x: str) -> str:
    return f"asinh(({x}) / 100)"


def pct_rank(x: str, w: int, least: int | None = None) -> str:
    v = f"list({x}) filter (where {x} is not null) {frame(w)}"
    below, equal = (f"len(list_filter({v}, lambda e: e {op} {x}))" for op in ("<", "="))
    return f"case when {x} is not null and len({v}) >= {w if least is None else least} then ({below} + ({equal} + 1) / 2.0) / len({v}) end"


def quantile(x: str, q: float, w: int, least: int | None = None) -> str:
    return f"case when count({x}) {frame(w)} >= {w if least is None else least} then quantile_cont({x}, {q}) {frame(w)} end"


def turn(f: str, x: str, n: float) -> str:
    return f"{f}(2 * pi() * ({x}) / {n})"


TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') as ts"


def number(x: str) -> str:
    return f"round(({x})::double + 1e-9, 6) + 0.0"


def select(columns: dict[str, str], source: str, keys: str = f"{TS}, region") -> str:
    """Keys as they are, all other columns as rounded doubles."""
    return f"select {keys}, " + ", ".join(f'{number(x)} as "{n}"' for n, x in columns.items()) + f" from {source}"
