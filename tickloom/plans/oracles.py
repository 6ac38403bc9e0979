"""The indicators as SQL over the same tables: plain windows, and recursion where a value depends on its predecessor."""

from __future__ import annotations

import math
import re

from ..operators.patterns import PATTERNS
from ..operators.registry import INFO

#: Shown values are rounded after a small shift, so that values whose last digit is 5 don't fall on either side of a tie.
SHIFT, DIGITS = 0.0000271828, 4
#: Outputs of any magnitude are shown on a scale where that rounding suits them: a factor, or their logarithm.
SCALED = {"emv": 1e-9}
LOGGED = ("nvi", "pvi")
EPS = "2.220446049250313e-16"

DAILY = """SELECT l_returnflag AS symbol, l_shipdate AS ts,
 arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
 arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume
 FROM lineitem GROUP BY ALL"""
HOURLY = """SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY event_type, date_trunc('hour', ts)"""
WEEKLY = """SELECT o_orderpriority AS symbol, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
 arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY o_orderpriority, date_trunc('week', o_orderdate)"""

LATTICE = """SELECT symbol, ts, close - b AS open, greatest(close - b, close) + u AS high, least(close - b, close) - w AS low, close, 1.0::DOUBLE AS volume FROM (
 SELECT symbol, ts, b, u, w, 1000 + sum(g + b) OVER (PARTITION BY symbol ORDER BY ts) AS close FROM (
 SELECT symbol, ts, ([0, 0, 0, 0.5, -0.5, 1, -1, 1.5, -1.5, 2.5, -2.5, -4, 4]::DOUBLE[])[c % 13 + 1] AS g,
  ([1, 1, 2, 2, 3, 0.5, 0, 0.5, -0.5, -1, -2, 5, 4]::DOUBLE[])[c // 13 % 13 + 1] * (CASE WHEN ts // 9 % 2 = 0 THEN 1 ELSE -1 END) AS b,
  ([0, 0, 0.5, 0.5, 1, 3, 0]::DOUBLE[])[d % 7 + 1] AS u, ([0, 0.5, 0, 0.5, 1, 3, 0]::DOUBLE[])[d // 7 % 7 + 1] AS w FROM (
 SELECT 's' || (l_suppkey % 40) AS symbol, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, l_partkey * 31 + CAST(round(l_extendedprice * 100) AS BIGINT) AS d,
  row_number() OVER (PARTITION BY l_suppkey % 40 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ts FROM lineitem)))"""

S = "OVER (PARTITION BY symbol ORDER BY ts)"


def frame(f: str, x: str, p: float) -> str:
    return f"{f}({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {int(p) - 1} PRECEDING AND CURRENT ROW)"


def lag(x: str, n: float = 1) -> str:
    return f"lag({x}, {int(n)}) {S}"


def weighted(x: str, weights: list[float]) -> str:
    """Sum of the last values, oldest first, times constant weights."""
    p = len(weights)
    return "(" + " + ".join(f"{w!r}::DOUBLE * {lag(x, p - 1 - k) if k < p - 1 else x}" for k, w in enumerate(weights)) + ")"


def rising(p: float) -> list[float]:
    p = int(p)
    return [(k + 1) / (p * (p + 1) / 2) for k in range(p)]


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) WHEN ({a}) > 0 THEN 'inf'::DOUBLE WHEN ({a}) < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END)"


def fit(x: str, p: float) -> tuple[str, str]:
    p = int(p)
    sx, sxx = p * (p + 1) / 2, p * (p + 1) * (2 * p + 1) / 6
    sy, sxy = frame("sum", x, p), weighted(x, [float(k + 1) for k in range(p)])
    b = f"(({p} * {sxy} - {sx} * {sy}) / {p * sxx - sx * sx})"
    return b, f"(({sy} - {b} * {sx}) / {p})"


def deviation(x: str, p: float) -> str:
    p = int(p)
    return f"((SELECT 0) + list_sum(list_transform({frame('list', x, p)}, lambda v: abs(v - ({frame('avg', x, p)})))) / {p})"


class Plan:
    """Named steps: each is a SELECT over the one before that adds columns; ``recurse`` adds state columns bar by bar."""

    def __init__(self, bars: str):
        self.steps = [f"bars AS ({bars})", f"t0 AS (SELECT *, row_number() {S} - 1 AS i FROM bars)"]
        self.last, self.n = "t0", 0

    def add(self, **columns: str) -> Plan:
        self.n += 1
        self.steps.append(f"t{self.n} AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM {self.last})")
        self.last = f"t{self.n}"
        return self

    def recurse(self, **columns: tuple[str, str]) -> Plan:
        """column = (value on bar 0, value on later bars); there r.x is the value before, b.x the bar's own."""
        self.n += 1
        base, t, r = self.last, f"t{self.n}", f"r{self.n}"
        first = ", ".join(f"CAST({v[0]} AS DOUBLE) AS {k}" for k, v in columns.items())
        later = ", ".join(f"CAST({v[1]} AS DOUBLE) AS {k}" for k, v in columns.items())
        self.steps.append(f"{r}(symbol, i, {', '.join(columns)}) AS (SELECT symbol, i, {first} FROM {base} WHERE i = 0 UNION ALL SELECT b.symbol, b.i, {later} FROM {r} AS r JOIN {base} AS b ON b.symbol = r.symbol AND b.i = r.i + 1)")
        self.steps.append(f"{t} AS (SELECT b.*, {', '.join(f'r.{k}' for k in columns)} FROM {base} AS b JOIN {r} AS r USING (symbol, i))")
        self.last = t
        return self

    def sql(self, outputs: dict[str, str]) -> str:
        scaled = {k: f"ln({v})" if k in LOGGED else f"({v}) * {SCALED[k]!r}::DOUBLE" if k in SCALED else v for k, v in outputs.items()}
        shown = ", ".join(f"round({v} + {SHIFT}, {DIGITS}) AS {'ln_' * (k in LOGGED)}{k}" for k, v in scaled.items())
        return f"WITH RECURSIVE {', '.join(self.steps)} SELECT symbol, CAST(ts AS VARCHAR) AS ts, {shown} FROM {self.last}"


def ema(x: str, p: float, key: str, start: int = 0) -> dict[str, tuple[str, str]]:
    """State of an exponential average that begins on bar ``start``. ``x``: written with b. in front of columns."""
    a = 2 / (p + 1)
    plain = x.replace("b.", "")
    return {key: (plain if not start else "NULL", f"CASE WHEN b.i <= {start} THEN {x} ELSE r.{key} * {1 - a!r}::DOUBLE + ({x}) * {a!r}::DOUBLE END")}


def wilder_sum(x: str, p: float, key: str) -> dict[str, tuple[str, str]]:
    return {key: (x.replace("b.", ""), f"CASE WHEN b.i < {p} THEN r.{key} + {x} ELSE r.{key} * {(p - 1) / p!r}::DOUBLE + {x} END")}


def build(name: str, o: tuple[float, ...], bars: str = DAILY, optional: bool = False) -> str:
    """An indicator's outputs over bars; for kvo, its optional ones as well can be had."""
    info = INFO[name]
    t = Plan(bars)
    x = "close"
    p = o[0] if o else 0
    first = info.first_row(*o)
    out: list[str] = []
    if name in ("sma", "wma", "trima", "vwma", "max", "min", "mom", "roc", "rocr", "qstick", "dpo", "md", "stddev", "bbands", "linreg", "tsf"):
        out = {
            "sma": lambda: [frame("avg", x, p)],
            "wma": lambda: [weighted(x, rising(p))],
            "trima": lambda: [weighted(x, [min(k + 1, p - k) / sum(min(j + 1, p - j) for j in range(int(p))) for k in range(int(p))])],
            "vwma": lambda: [f"{frame('sum', 'close * volume', p)} / {frame('sum', 'volume', p)}"],
            "max": lambda: [frame("max", x, p)],
            "min": lambda: [frame("min", x, p)],
            "mom": lambda: [f"{x} - {lag(x, p)}"],
            "roc": lambda: [f"({x} - {lag(x, p)}) / greatest({lag(x, p)}, {EPS})"],
            "rocr": lambda: [f"{x} / greatest({lag(x, p)}, {EPS})"],
            "qstick": lambda: [frame("avg", "close - open", p)],
            "dpo": lambda: [f"{lag(x, p // 2 + 1)} - {frame('avg', x, p)}"],
            "md": lambda: [deviation(x, p)],
            "stddev": lambda: [f"greatest({frame('stddev_pop', x, p)}, {EPS})"],
            "bbands": lambda: [f"{frame('avg', x, p)} {s} greatest({frame('stddev_pop', x, p)}, {EPS})" if s else frame("avg", x, p) for s in (f"- {o[1]} *", "", f"+ {o[1]} *")],
            "linreg": lambda: ["{1} + {0} * {2}".format(*fit(x, p), p)],
            "tsf": lambda: ["{1} + {0} * {2}".format(*fit(x, p), p + 1)],
        }[name]()
    elif name in ("avgprice", "medprice", "typprice", "wcprice", "bop", "marketfi"):
        out = [{"avgprice": "(open + high + low + close) / 4", "medprice": "(high + low) / 2", "typprice": "(high + low + close) / 3", "wcprice": "(2 * close + high + low) / 4", "bop": f"(close - open) / greatest(high - low, {EPS})", "marketfi": f"(high - low) / greatest(volume, {EPS})"}[name]]
    elif name == "hma":
        h = max(1, int(p) // 2)
        t.add(d=f"2 * {weighted(x, rising(h))} - {weighted(x, rising(p))}")
        out = [weighted("d", rising(math.isqrt(int(p))))]
    elif name == "stoch":
        t.add(lo=frame("min", "low", p), hi=frame("max", "high", p)).add(f=f"100 * (close - lo) / greatest(hi - lo, {EPS})").add(k=frame("avg", "f", o[1]))
        out = ["k", f"CASE WHEN i >= {p + o[1] + o[2]} THEN {frame('avg', 'k', o[2])} END"]
    elif name == "willr":
        t.add(lo=frame("min", "low", p), hi=frame("max", "high", p))
        out = [f"CASE WHEN hi - lo < {EPS} THEN 0 ELSE 100 * (hi - close) / (hi - lo) END"]
    elif name == "cci":
        t.add(tp="(high + low + close) / 3").add(m=frame("avg", "tp", p), d=deviation("tp", p))
        out = ["CASE WHEN d = 0 THEN 0 ELSE (tp - m) / (0.015 * d) END"]
    elif name == "cmo":
        t.add(d=f"{x} - {lag(x)}").add(u=frame("sum", "greatest(d, 0)", p), n=frame("sum", "greatest(-d, 0)", p))
        out = [div("100 * (u - n)", "u + n")]
    elif name == "ultosc":
        t.add(pc=lag("close")).add(b="CASE WHEN pc IS NOT NULL THEN close - least(low, pc) END", r="CASE WHEN pc IS NOT NULL THEN greatest(high, pc) - least(low, pc) END")
        t.add(**{f"q{k}": div(frame("sum", "b", n), frame("sum", "r", n)) for k, n in enumerate(o)})
        out = ["100.0 / 7 * (4 * q0 + 2 * q1 + q2)"]
    elif name == "ao":
        t.add(m="(high + low) / 2")
        out = [f"{frame('avg', 'm', 5)} - {frame('avg', 'm', 34)}"]
    elif name == "fosc":
        b, a = fit(x, p)
        t.add(f=f"{a} + {b} * {p + 1}").add(pf=lag("f"))
        out = [div(f"100 * ({x} - pf)", x)]
    elif name == "msw":
        n = int(p)
        t.add(r=weighted(x, [math.cos(2 * math.pi * (n - 1 - j) / n) for j in range(n)]), q=weighted(x, [math.sin(2 * math.pi * (n - 1 - j) / n) for j in range(n)]))
        t.add(f="CASE WHEN abs(r) > 0.001 THEN atan(q / r) WHEN q < 0 THEN -pi() ELSE pi() END + CASE WHEN r < 0 THEN pi() ELSE 0 END + pi() / 2")
        t.add(g="f + CASE WHEN f < 0 THEN 2 * pi() WHEN f > 2 * pi() THEN -2 * pi() ELSE 0 END")
        out = ["sin(g)", "sin(g + pi() / 4)"]
    elif name in ("aroon", "aroonosc"):
        t.add(h=frame("max", "{'x': high, 'n': i}", p + 1), l=frame("max", "{'x': -low, 'n': i}", p + 1))
        down, up = f"({p} - (i - l.n)) * 100 / {p}", f"({p} - (i - h.n)) * 100 / {p}"
        out = [down, up] if name == "aroon" else [f"{up} - {down}"]
    elif name == "tr":
        t.add(pc=lag("close"))
        out = ["greatest(high - low, abs(high - pc), abs(low - pc))"]
    elif name == "volatility":
        t.add(r=f"{x} / {lag(x)} - 1")
        out = [f"sqrt(252) * {frame('stddev_pop', 'r', p)}"]
    elif name == "vhf":
        t.add(d=f"abs({x} - {lag(x)})")
        out = [f"({frame('max', x, p)} - {frame('min', x, p)}) / greatest({frame('sum', 'd', p)}, {EPS})"]
    elif name in ("ad", "adosc"):
        t.add(f=f"CASE WHEN high - low > {EPS} THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END").add(ad=f"sum(f) {S}")
        out = ["ad"]
        if name == "adosc":
            t.recurse(**ema("b.ad", o[0], "a"), **ema("b.ad", o[1], "e"))
            out = ["a - e"]
    elif name == "obv":
        t.add(d=f"coalesce(sign(close - {lag('close')}) * volume, 0)")
        out = [f"sum(d) {S}"]
    elif name == "mfi":
        t.add(tp="(high + low + close) / 3").add(q=lag("tp"))
        u, d = (frame("sum", f"CASE WHEN tp {s} q THEN tp * volume ELSE 0 END", p) for s in "><")
        out = [f"100 * {u} / greatest({u} + {d}, {EPS})"]
    elif name == "vosc":
        a, b = frame("avg", "volume", o[0]), frame("avg", "volume", o[1])
        out = [f"CASE WHEN {b} = 0 THEN 0 ELSE 100 * ({a} - {b}) / {b} END"]
    elif name == "emv":
        t.add(m="(high + low) / 2")
        out = [f"(m - {lag('m')}) * 10000 * greatest(high - low, {EPS}) / greatest(volume, {EPS})"]
    elif name == "wad":
        t.add(pc=lag("close")).add(d="CASE WHEN close > pc THEN close - least(pc, low) WHEN close < pc THEN close - greatest(pc, high) ELSE 0 END")
        out = [f"sum(d) {S}"]
    elif name == "ema":
        t.recurse(**ema("b.close", p, "e"))
        out = ["e"]
    elif name in ("dema", "tema", "trix"):
        p = int(p)
        t.recurse(**ema("b.close", p, "e0")).recurse(**ema("b.e0", p, "e1", p - 1)).recurse(**ema("b.e1", p, "e2", 2 * p - 2))
        if name == "trix":
            t.add(before=lag("e2"))
        out = [{"dema": "2 * e0 - e1", "tema": "3 * e0 - 3 * e1 + e2", "trix": "100 * (e2 - before) / e2"}[name]]
    elif name == "zlema":
        n = max((int(p) - 1) // 2, 1)
        t.add(z=f"CASE WHEN i = {n - 1} THEN close ELSE 2 * close - {lag('close', n)} END").recurse(**ema("b.z", p, "e", n - 1))
        out = ["e"]
    elif name == "kama":
        t.add(d=f"abs(close - {lag('close')})", c=f"abs(close - {lag('close', p)})").add(path=frame("sum", "d", p)).add(sc=f"pow((2.0 / 3 - 2.0 / 31) * CASE WHEN path = 0 THEN 1 ELSE c / path END + 2.0 / 31, 2)")
        t.recurse(k=("close", f"CASE WHEN b.i < {p} THEN b.close ELSE r.k + b.sc * (b.close - r.k) END"))
        out = ["k"]
    elif name == "vidya":
        t.add(k=f"{o[2]} * greatest({frame('stddev_pop', x, o[0])}, {EPS}) / greatest({frame('stddev_pop', x, o[1])}, {EPS})")
        t.recurse(v=("close", f"CASE WHEN b.i < {o[1] - 1} THEN b.close ELSE (b.close - r.v) * b.k + r.v END"))
        out = ["v"]
    elif name == "wilders":
        t.add(m=frame("avg", x, p)).recurse(y=("m" if p == 1 else "NULL",  # with a period of 1 the first bar is the seed
             f"CASE WHEN b.i <= {p - 1} THEN b.m ELSE r.y * {(p - 1) / p!r}::DOUBLE + b.close * {1 - (p - 1) / p!r}::DOUBLE END"))
        out = ["y"]
    elif name in ("rsi", "stochrsi"):
        m = (p - 1) / p
        t.add(d=f"close - {lag('close')}").add(su=frame("avg", "greatest(d, 0)", p), sd=frame("avg", "greatest(-d, 0)", p))
        t.recurse(u=("NULL", f"CASE WHEN b.i <= {p} THEN b.su ELSE r.u * {m!r}::DOUBLE + greatest(b.d, 0) / {p} END"), n=("NULL", f"CASE WHEN b.i <= {p} THEN b.sd ELSE r.n * {m!r}::DOUBLE + greatest(-b.d, 0) / {p} END"))
        t.add(rsi=f"CASE WHEN i >= {p} THEN {div('100 * u', 'u + n')} END")
        out = ["rsi"]
        if name == "stochrsi":
            t.add(hi=frame("max", "rsi", p), lo=frame("min", "rsi", p))
            out = [f"CASE WHEN hi - lo < {EPS} THEN 0 ELSE 100 * (rsi - lo) / (hi - lo) END"]
    elif name == "macd":
        t.recurse(**ema("b.close", o[0], "a"), **ema("b.close", o[1], "e")).add(m="a - e").recurse(**ema("b.m", o[2], "g", int(o[1]) - 1))
        late = f"i >= {o[1] + o[2] - 2}"
        out = ["m", f"CASE WHEN {late} THEN g END", f"CASE WHEN {late} THEN m - g END"]
    elif name in ("apo", "ppo"):
        t.recurse(**ema("b.close", o[0], "a"), **ema("b.close", o[1], "e"))
        out = ["a - e" if name == "apo" else f"(a - e) * 100 / greatest(e, {EPS})"]
    elif name == "cvi":
        t.add(s=f"greatest(high - low, {EPS})").recurse(**ema("b.s", p, "e")).add(before=lag("e", p))
        out = ["100 * (e - before) / before"]
    elif name == "mass":
        t.add(s="high - low").recurse(**ema("b.s", 9, "a")).recurse(**ema("b.a", 9, "e", 8)).add(q=f"CASE WHEN i >= 16 THEN {div('a', 'e')} END")
        out = [frame("sum", "q", p)]
    elif name in ("atr", "natr"):
        t.add(pc=lag("close")).add(tr="CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END")
        t.recurse(a=(f"tr / {p}", f"CASE WHEN b.i < {p} THEN r.a + b.tr / {p} ELSE r.a * {(p - 1) / p!r}::DOUBLE + b.tr * {1 - (p - 1) / p!r}::DOUBLE END"))
        out = ["a" if name == "atr" else "100 * a / close"]
    elif name in ("dm", "di", "dx", "adx", "adxr"):
        t.add(pc=lag("close"), u0=f"greatest(coalesce(high - {lag('high')}, 0), 0)", d0=f"greatest(coalesce({lag('low')} - low, 0), 0)")
        t.add(tr="CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END", up="CASE WHEN d0 > u0 THEN 0 ELSE u0 END", dn="CASE WHEN u0 > d0 THEN 0 ELSE d0 END")
        t.recurse(**wilder_sum("b.up", p, "u"), **wilder_sum("b.dn", p, "d"), **wilder_sum("b.tr", p, "a"))
        if name == "dm":
            out = ["u", "d"]
        elif name == "di":
            out = ["CASE WHEN a = 0 THEN 0 ELSE 100 * u / a END", "CASE WHEN a = 0 THEN 0 ELSE 100 * d / a END"]
        else:
            t.add(x="CASE WHEN u + d = 0 THEN 0 ELSE 100 * abs(u - d) / (u + d) END")
            out = ["x"]
            if name != "dx":
                t.add(m=frame("avg", "x", p)).recurse(v=("NULL", f"CASE WHEN b.i <= {2 * p - 2} THEN b.m ELSE r.v * {(p - 1) / p!r}::DOUBLE + b.x * {1 - (p - 1) / p!r}::DOUBLE END"))
                out = ["v"]
                if name == "adxr":
                    out = [f"0.5 * (v + {lag('v', p - 1)})"]
    elif name == "fisher":
        t.add(m="(high + low) / 2").add(lo=frame("min", "m", p), hi=frame("max", "m", p)).add(z="0.66 * ((m - lo) / greatest(hi - lo, 0.001) - 0.5)")
        raw = "(b.z + 0.67 * r.v)"
        v = f"CASE WHEN b.i < {p - 1} THEN 0 WHEN {raw} > 0.99 THEN 0.999 WHEN {raw} < -0.99 THEN -0.999 ELSE {raw} END"
        t.recurse(v=("0", v)).recurse(f=("0", f"CASE WHEN b.i < {p - 1} THEN 0 ELSE 0.5 * (ln((1 + b.v) / (1 - b.v)) + r.f) END"))
        out = ["f", lag("f")]
    elif name in ("nvi", "pvi"):
        s = "<" if name == "nvi" else ">"
        t.add(pc=lag("close"), pv=lag("volume")).recurse(y=("1000", f"CASE WHEN b.volume {s} b.pv THEN r.y * (b.close / b.pc) ELSE r.y END"))
        out = ["y"]
    elif name == "kvo":
        t.add(hlc="high + low + close", g="high - low").add(q=lag("hlc"), pg=lag("g"))
        trend = "CASE WHEN r.tr <> 1 AND b.hlc > b.q THEN 1 WHEN r.tr <> -1 AND b.hlc < b.q THEN -1 ELSE r.tr END"
        t.recurse(tr=("-2", trend), cm=("0", f"CASE WHEN (r.tr <> 1 AND b.hlc > b.q) OR (r.tr <> -1 AND b.hlc < b.q) THEN b.pg ELSE r.cm END + greatest(b.g, {EPS})"))
        t.add(vf="CASE WHEN i > 0 THEN abs(g / cm * 2 - 1) * volume * 100 * tr END")
        t.recurse(**ema("b.vf", o[0], "a", 1), **ema("b.vf", o[1], "e", 1))
        if optional:
            return t.sql({"short_ema": f"CASE WHEN i >= {o[0]} THEN a END", "long_ema": f"CASE WHEN i >= {o[1]} THEN e END"})
        out = ["a - e"]
    elif name == "psar":
        af, most = o
        t.add(ph=lag("high"), pl=lag("low"), h2=lag("high", 2), l2=lag("low", 2))
        up = "CASE WHEN b.i = 1 THEN CAST(b.ph + b.pl <= b.high + b.low AS INT) ELSE r.up END"
        sar, ext, acc = f"CASE WHEN b.i > 1 THEN r.sar WHEN {up} = 1 THEN b.pl ELSE b.ph END", f"CASE WHEN b.i > 1 THEN r.ext WHEN {up} = 1 THEN b.ph ELSE b.pl END", f"CASE WHEN b.i > 1 THEN r.af ELSE {af} END"
        moved = f"(({sar}) + ({acc}) * (({ext}) - ({sar})))"
        s1 = f"CASE WHEN ({up}) = 1 THEN least({moved}, coalesce(b.l2, 'inf'::DOUBLE), b.pl) ELSE greatest({moved}, coalesce(b.h2, 0), b.ph) END"
        e1 = f"CASE WHEN ({up}) = 1 THEN greatest(({ext}), b.high) ELSE least(({ext}), b.low) END"
        a1 = f"CASE WHEN (({up}) = 1 AND b.high > ({ext})) OR (({up}) = 0 AND b.low < ({ext})) THEN least(({acc}) + {af}, {most}) ELSE ({acc}) END"
        flip = f"((({up}) = 1 AND b.low < ({s1})) OR (({up}) = 0 AND b.high > ({s1})))"
        t.recurse(up=("0", f"CASE WHEN {flip} THEN 1 - ({up}) ELSE ({up}) END"), sar=("0", f"CASE WHEN {flip} THEN ({e1}) ELSE ({s1}) END"), ext=("0", f"CASE WHEN {flip} THEN CASE WHEN ({up}) = 1 THEN b.low ELSE b.high END ELSE ({e1}) END"), af=(f"{af}", f"CASE WHEN {flip} THEN {af} ELSE ({a1}) END"))
        out = ["sar"]
    else:
        raise KeyError(name)
    return t.sql({k: f"CASE WHEN i >= {first} THEN {v} END" for k, v in zip(info.outputs, out)})


_TYPES = {
    "W2+": "type IN ('WhiteCandle', 'LongWhiteCandle', 'WhiteMarubozu', 'ClosingWhiteMarubozu', 'OpeningWhiteMarubozu')",
    "W3+": "type IN ('ShortWhiteCandle', 'WhiteCandle', 'LongWhiteCandle', 'WhiteMarubozu', 'ClosingWhiteMarubozu', 'OpeningWhiteMarubozu')",
    "B2+": "type IN ('BlackCandle', 'LongBlackCandle', 'BlackMarubozu', 'ClosingBlackMarubozu', 'OpeningBlackMarubozu')",
    "B3+": "type IN ('ShortBlackCandle', 'BlackCandle', 'LongBlackCandle', 'BlackMarubozu', 'ClosingBlackMarubozu', 'OpeningBlackMarubozu')",
    "Doji4": "type IN ('Doji', 'LongLeggedDoji', 'DragonflyDoji', 'GravestoneDoji')",
    "!Doji": "type NOT IN ('Doji', 'LongLeggedDoji', 'DragonflyDoji', 'GravestoneDoji', 'FourPriceDoji')",
}
_WORDS = {
    "G": "green", "R": "NOT green", "hollow": "open < close", "filled": "open >= close", "line=LONG": "long_line", "line=SHORT": "NOT long_line", "body=LONG": "long_body", "body=SHORT": "NOT long_body",
    "lower_wick_lt_body": "NOT (lower > 0 AND lower >= body)", "upper_wick_lt_body": "NOT (upper > 0 AND upper >= body)", "lower_wick_2x": "lower >= 2 * body", "upper_wick_2x": "upper >= 2 * body",
    "body_gap=UP": "bot > ptop", "body_gap=DOWN": "top < pbot", "wick_gap=UP": "low > ph", "wick_gap=DOWN": "high < pl",
    "open_above_prev_mid": "open > (ptop + pbot) / 2", "close_above_prev_mid": "close > (ptop + pbot) / 2", "open_in_prev_body": "open BETWEEN pbot AND ptop", "close_in_prev_body": "close BETWEEN pbot AND ptop",
    "high_in_prev_body": "high BETWEEN pbot AND ptop", "high_in_prev_line": "high BETWEEN pl AND ph", "low_in_prev_line": "low BETWEEN pl AND ph", "body_gt_prev_body": "body > ptop - pbot",
    "engulf_prev=BODY": "top >= ptop AND bot <= pbot AND (top > ptop OR bot < pbot)", "engulf_prev=LINE": "top >= ph AND bot <= pl",
    "inside_prev=BODY": "top <= ptop AND bot >= pbot AND (top < ptop OR bot > pbot)", "inside_prev=LINE": "high <= ph AND low >= pl AND (high < ph OR low > pl)",
}


def _template(words: str) -> str:
    parts = ["type <> 'Other'"]
    for w in words.split():
        if w in _TYPES:
            parts.append(_TYPES[w])
        elif w.startswith("NOT_"):
            parts.append(f"NOT ({_WORDS[w[4:]]})")
        elif w in _WORDS:
            parts.append(f"({_WORDS[w]})")
        else:
            names = ", ".join(f"'{x}'" for x in w.lstrip("!").split("|"))
            parts.append(f"type {'NOT ' * w.startswith('!')}IN ({names})")
    return " AND ".join(parts)


def candles(periods: tuple[int, int, int], forecast: str | None = None, bars: str = DAILY) -> str:
    """The candlestick scan: averages by recursion, types by CASE, patterns as a union over the bars before."""
    c, t, g = periods
    slow = t + g
    first = c + 4 if c > slow else slow + 5
    p = Plan(bars)
    p.add(span="high - low", body="abs(open - close)", pc=lag("close"), po=lag("open"), ph=lag("high"), pl=lag("low"))
    p.recurse(**ema("b.span", c, "el"), **ema("b.body", c, "eb"), **ema("b.close", t, "ef"), **ema("b.close", slow, "es"))
    p.add(ema_line=f"coalesce({lag('el')}, el)", ema_body=f"coalesce({lag('eb')}, eb)", ema="ef", way="CASE WHEN i = 0 THEN NULL WHEN ef > es THEN 1 WHEN ef < es THEN -1 END")
    p.add(trend="coalesce(last_value(way IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0)", top="greatest(open, close)", bot="least(open, close)", ptop="greatest(po, pc)", pbot="least(po, pc)", green="coalesce(close >= pc, true)", long_line="span >= (0.7::DOUBLE - 0.005::DOUBLE) * ema_line", long_body="body >= (0.7::DOUBLE - 0.005::DOUBLE) * ema_body")
    p.add(upper="high - top", lower="bot - low")
    p.add(up_long="upper > 0 AND upper >= body", down_long="lower > 0 AND lower >= body", stretched="long_line AND ((upper > 0 AND upper >= body * 3) OR (lower > 0 AND lower >= body * 3))", place="CASE WHEN span = 0 THEN NULL WHEN top = high THEN 100 WHEN bot = low THEN 0 ELSE ((top + bot) / 2 - low) / span * 100 END")
    p.add(type="""CASE WHEN body <= 0.03::DOUBLE * ema_body THEN CASE WHEN long_line THEN CASE WHEN place > 45 AND place < 55 THEN 'LongLeggedDoji' WHEN place = 100 THEN 'DragonflyDoji' WHEN place = 0 THEN 'GravestoneDoji' ELSE 'Doji' END WHEN upper = 0 AND lower = 0 THEN 'FourPriceDoji' ELSE 'Doji' END
 WHEN upper > 0 AND lower > 0 AND NOT up_long AND NOT down_long THEN CASE WHEN long_line AND body > 3 * ema_body THEN 'Long' WHEN long_line THEN '' ELSE 'Short' END || CASE WHEN open < close THEN 'WhiteCandle' ELSE 'BlackCandle' END
 WHEN upper = 0 AND lower = 0 THEN CASE WHEN open < close THEN 'WhiteMarubozu' ELSE 'BlackMarubozu' END
 WHEN upper = 0 AND NOT down_long THEN CASE WHEN open < close THEN 'ClosingWhiteMarubozu' ELSE 'OpeningBlackMarubozu' END
 WHEN lower = 0 AND NOT up_long THEN CASE WHEN open < close THEN 'OpeningWhiteMarubozu' ELSE 'ClosingBlackMarubozu' END
 WHEN (up_long OR down_long) AND NOT stretched THEN CASE WHEN open < close THEN 'WhiteSpinningTop' ELSE 'BlackSpinningTop' END
 WHEN (up_long OR down_long) AND NOT long_body THEN 'HighWave' ELSE 'Other' END""")
    templates: dict[str, str] = {}
    for name, kind, before, parts, extra in PATTERNS:
        for w in [*parts.split("; "), *([before] if before else [])]:
            templates.setdefault(w, f"f{len(templates)}")
    p.add(**{k: _template(w) for w, k in templates.items()})
    rows = []
    wanted_trend = {"BearishReversal": 1, "BullishContinuation": 1, "BullishReversal": -1, "BearishContinuation": -1}
    for name, kind, before, parts, extra in PATTERNS:
        if forecast and kind != forecast:
            continue
        bars_of = parts.split("; ")
        n = len(bars_of)
        conditions = [f"b{n - 1 - k}.{templates[w]}" for k, w in enumerate(bars_of)]
        if kind in wanted_trend:
            conditions.append(f"b{n}.trend = {wanted_trend[kind]}")
        if before:
            conditions.append(f"b{n}.{templates[before]}")
        if extra:
            text = re.sub(r"\b([ohlc])([1-4])\b", lambda m: f"b{n - int(m[2])}.{ {'o': 'open', 'h': 'high', 'l': 'low', 'c': 'close'}[m[1]] }", extra)
            text = re.sub(r"\b(ema_line|ema_body|ema)\b", r"b0.\1", text).replace("_type", "b0.type")
            conditions.append(f"({text})")
        joins = " ".join(f"JOIN x AS b{k} ON b{k}.symbol = b0.symbol AND b{k}.i = b0.i - {k}" for k in range(1, n + 1))
        rows.append(f"SELECT b0.symbol, CAST(b0.ts AS VARCHAR) AS ts, '{name}' AS pattern, '{kind}' AS forecast, CAST({n} AS INT) AS bars FROM x AS b0 {joins} WHERE b0.i >= {first} AND {' AND '.join(conditions)}")
    return f"WITH RECURSIVE {', '.join(p.steps)}, x AS MATERIALIZED (SELECT * FROM {p.last}) " + " UNION ALL ".join(rows)
