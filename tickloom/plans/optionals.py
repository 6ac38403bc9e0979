"""Optional outputs against other indicators' own SQL: the average inside one is the output of another."""

from __future__ import annotations

from collections.abc import Callable

from ..operators.registry import INFO
from . import oracles

#: Optional output -> (indicator, its options, its output, what stands for the close).
Twin = tuple[str, tuple[float, ...], str, str]
TYPICAL, MEDIAN, VOLUME, LINE = "(high + low + close) / 3", "(high + low) / 2", "volume", "ad"


def _plain(name: str, *options: float, output: str | None = None, x: str = "close") -> Twin:
    return name, options, output or name, x


def _averages(p: float) -> dict[str, Twin]:
    return {"tema": _plain("tema", p), "dema": _plain("dema", p), "ema": _plain("ema", p)}


def _ends(s: float, n: float, x: str = "close") -> dict[str, Twin]:
    return {"short_ema": _plain("ema", s, x=x), "long_ema": _plain("ema", n, x=x)}


def _ranges(p: float) -> dict[str, Twin]:
    return {"atr": _plain("atr", p), "tr": _plain("tr")}


_OF: dict[str, Callable[..., dict[str, Twin]]] = {
    "wma": lambda p: {"sma": _plain("sma", p)},
    "dema": lambda p: {"ema": _plain("ema", p)},
    "tema": lambda p: {k: v for k, v in _averages(p).items() if k != "tema"},
    "trix": _averages,
    "vidya": lambda s, n, a: {"short_sma": _plain("sma", s), "long_sma": _plain("sma", n), "short_stddev": _plain("stddev", s), "long_stddev": _plain("stddev", n)},
    "macd": lambda s, n, g: _ends(s, n),
    "ppo": _ends,
    "apo": _ends,
    "adosc": lambda s, n: _ends(s, n, LINE) | {"ad": _plain("ad")},
    "stochrsi": lambda p: {"rsi": _plain("rsi", p)},
    "cci": lambda p: {"sma": _plain("sma", p, x=TYPICAL), "md": _plain("md", p, x=TYPICAL), "typprice": _plain("typprice")},
    "ao": lambda: {"short_sma": _plain("sma", 5, x=MEDIAN), "long_sma": _plain("sma", 34, x=MEDIAN), "medprice": _plain("medprice")},
    "adx": lambda p: {"dx": _plain("dx", p)} | _ranges(p),
    "adxr": lambda p: {"adx": _plain("adx", p), "dx": _plain("dx", p)} | _ranges(p),
    "di": _ranges,
    "dx": _ranges,
    "atr": lambda p: {"tr": _plain("tr")},
    "natr": _ranges,
    "aroonosc": lambda p: {"aroon_down": _plain("aroon", p, output="aroon_down"), "aroon_up": _plain("aroon", p, output="aroon_up")},
    "stddev": lambda p: {"sma": _plain("sma", p)},
    "mfi": lambda p: {"typprice": _plain("typprice")},
    "vosc": lambda s, n: {"short_sma": _plain("sma", s, x=VOLUME), "long_sma": _plain("sma", n, x=VOLUME)},
    "emv": lambda: {"medprice": _plain("medprice")},
    "roc": lambda p: {"mom": _plain("mom", p)},
    "dpo": lambda p: {"sma": _plain("sma", p)},
    "md": lambda p: {"sma": _plain("sma", p)},
}
#: Indicators over a fitted line; the database's own regression finds it.
LINES = ("linreg", "tsf", "fosc")
TWINS: dict[str, dict[str, Twin]] = {k: f(*INFO[k].defaults) for k, f in _OF.items()} | {k: {} for k in (*LINES, "kvo")}


def bars(x: str) -> str:
    """The daily bars with another series in the close's place."""
    if x == "close":
        return oracles.DAILY
    if x == LINE:
        x = f"sum(CASE WHEN high - low > {oracles.EPS} THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts)"
    return f"SELECT symbol, ts, open, high, low, {x} AS close, volume FROM ({oracles.DAILY}) AS d"


def sql(name: str) -> str:
    if name in LINES:
        p = int(INFO[name].defaults[0])
        of = lambda f: f"{f}(close, i) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"
        # Over x = 1 .. p, bar i stands at x = p.
        values = {"linregslope": "b", "linregintercept": f"a + b * (i - {p})", "linreg": "a + b * i", "tsf": "a + b * (i + 1)"}
        shown = ", ".join(f"round(CASE WHEN i >= {p} THEN {values[k]} END + {oracles.SHIFT}, {oracles.DIGITS}) AS {k}" for k in INFO[name].optional)
        return f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM ({oracles.DAILY}) AS d), f AS (SELECT symbol, ts, i, {of('regr_slope')} AS b, {of('regr_intercept')} AS a FROM n) SELECT symbol, CAST(ts AS VARCHAR) AS ts, {shown} FROM f"
    if name == "kvo":
        return oracles.build(name, INFO[name].defaults, optional=True)
    twins = TWINS[name]
    parts = [f"(SELECT symbol, ts, {output} AS {k} FROM ({oracles.build(other, options or INFO[other].defaults, bars(x))}) AS q_{k}) AS t_{k}" for k, (other, options, output, x) in twins.items()]
    return f"SELECT symbol, ts, {', '.join(f't_{k}.{k}' for k in twins)} FROM {parts[0]}" + "".join(f" JOIN {p} USING (symbol, ts)" for p in parts[1:])
