"""Indicators that a window frame can express, as columns.

Every function takes a ``Stage``, the options and the input columns, and returns its outputs (required, then optional) before warm-up is cut off. A window over a window's result needs a stage of its own: ``Stage.keep`` names the inner one as a column; all of them share one sort and one exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16
FRAMES: dict[str, Callable[..., list[Column]]] = {}


class Stage:
    def __init__(self, df: DataFrame, by: list[str], order: list[str], number: str):
        self.df, self.number = df, F.col(number)
        self.w = Window.partitionBy(*by).orderBy(*order)
        self.count = 0

    def keep(self, c: Column) -> Column:
        self.count += 1
        name = f"_stage_{self.count}"
        self.df = self.df.withColumn(name, c)
        return F.col(name)

    def over(self, c: Column, p: float) -> Column:
        return c.over(self.w.rowsBetween(-(int(p) - 1), 0))

    def sum(self, x: Column, p: float) -> Column:
        return self.over(F.sum(x), p)

    def avg(self, x: Column, p: float) -> Column:
        return self.over(F.avg(x), p)

    def max(self, x: Column, p: float) -> Column:
        return self.over(F.max(x), p)

    def min(self, x: Column, p: float) -> Column:
        """A NaN in the window makes NaN, as it does in ``max``, where Spark takes it for the greatest."""
        return F.when(F.isnan(self.max(x, p)), F.lit(math.nan)).otherwise(self.over(F.min(x), p))

    def sd(self, x: Column, p: float) -> Column:
        return F.greatest(self.over(F.stddev_pop(x), p), F.lit(EPS))

    def lag(self, x: Column, n: float = 1) -> Column:
        return F.lag(x, int(n)).over(self.w)

    def total(self, x: Column) -> Column:
        return F.sum(x).over(self.w.rowsBetween(Window.unboundedPreceding, 0))

    def list(self, x: Column, p: float) -> Column:
        return self.keep(self.over(F.collect_list(x), p))

    def dot(self, x: Column, weights: list[float]) -> Column:
        """Sum of the last values, oldest first, times constant weights."""
        return weigh(self.list(x, len(weights)), weights)


def weigh(values: Column, weights: list[float]) -> Column:
    parts = F.zip_with(values, F.array(*map(F.lit, map(float, weights))), lambda a, b: a * b)
    return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)


def rising(p: float) -> list[float]:
    p = int(p)
    return [(k + 1) / (p * (p + 1) / 2) for k in range(p)]


def frame(f: Callable) -> Callable:
    FRAMES[f.__name__.rstrip("_")] = f
    return f


@frame
def sma(t, o, x):
    return [t.avg(x, o[0])]


@frame
def wma(t, o, x):
    return [t.dot(x, rising(o[0])), t.avg(x, o[0])]


@frame
def trima(t, o, x):
    p = int(o[0])
    w = [min(k + 1, p - k) for k in range(p)]
    return [t.dot(x, [k / sum(w) for k in w])]


@frame
def hma(t, o, x):
    p = int(o[0])
    half = max(1, p // 2)
    values = t.list(x, p)
    d = t.keep(2 * weigh(F.slice(values, -half, half), rising(half)) - weigh(values, rising(p)))
    return [t.dot(d, rising(math.isqrt(p)))]


@frame
def vwma(t, o, c, v):
    total = t.sum(v, o[0])
    return [F.when(total == 0, 0.0).otherwise(t.sum(c * v, o[0]) / total)]


@frame
def stoch(t, o, h, l, c):
    k, slow, d = o
    lo = t.min(l, k)
    f = t.keep(100 * (c - lo) / F.greatest(t.max(h, k) - lo, F.lit(EPS)))
    v = t.keep(t.avg(f, slow))
    return [v, F.when(t.number >= k + slow + d, t.avg(v, d))]


@frame
def willr(t, o, h, l, c):
    hi, lo = t.max(h, o[0]), t.min(l, o[0])
    return [F.when(hi - lo < EPS, 0.0).otherwise(100 * (hi - c) / (hi - lo))]


def deviation(values: Column, m: Column, p: float) -> Column:
    return F.aggregate(F.transform(values, lambda x: F.abs(x - m)), F.lit(0.0), lambda a, b: a + b) / p


@frame
def cci(t, o, h, l, c):
    p = o[0]
    tp = t.keep((h + l + c) * (1 / 3))
    m, values = t.keep(t.avg(tp, p)), t.list(tp, p)
    d = t.keep(deviation(values, m, p))
    late = t.number >= p
    return [F.when(d == 0, 0.0).otherwise((tp - m) / (0.015 * d)), F.when(late, m), F.when(late, d), tp]


def divided(a: Column, b: Column) -> Column:
    """a / b by IEEE rules, where Spark's division by zero would give null or an error."""
    return F.when(b != 0, a / b).when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))


@frame
def cmo(t, o, x):
    d = t.keep(x - t.lag(x))
    u, n = t.sum(F.greatest(d, F.lit(0.0)), o[0]), t.sum(F.greatest(-d, F.lit(0.0)), o[0])
    return [divided(t.keep(100 * (u - n)), t.keep(u + n))]


@frame
def ultosc(t, o, h, l, c):
    pc = t.keep(t.lag(c))
    low = F.least(l, pc)
    b, r = t.keep(F.when(pc.isNotNull(), c - low)), t.keep(F.when(pc.isNotNull(), F.greatest(h, pc) - low))
    part = [divided(t.keep(t.sum(b, p)), t.keep(t.sum(r, p))) for p in o]
    return [100 / 7 * (4 * part[0] + 2 * part[1] + part[2])]


@frame
def ao(t, o, h, l):
    m = t.keep(0.5 * (h + l))
    a, b = t.avg(m, 5), t.avg(m, 34)
    return [a - b, F.when(t.number >= 5, a), F.when(t.number >= 34, b), m]


def fitted(t: Stage, x: Column, p: float) -> tuple[Column, Column]:
    """(slope, intercept) of the least squares line over x = 1..p."""
    p = int(p)
    sx, sxx = p * (p + 1) / 2, p * (p + 1) * (2 * p + 1) / 6
    d = p * sxx - sx * sx
    sy, sxy = t.sum(x, p), t.dot(x, [k + 1 for k in range(p)])
    b = t.keep((p * sxy - sx * sy) / d) if d else F.lit(0.0)
    return b, t.keep((sy - b * sx) / p)


@frame
def linreg(t, o, x):
    b, a = fitted(t, x, o[0])
    return [a + b * o[0], b, a]


@frame
def tsf(t, o, x):
    b, a = fitted(t, x, o[0])
    return [a + b * (o[0] + 1), a + b * o[0], b, a]


@frame
def fosc(t, o, x):
    p = o[0]
    b, a = fitted(t, x, p)
    f = t.keep(a + b * (p + 1))
    late = t.number >= p
    return [divided(100 * (x - t.keep(t.lag(f))), x), F.when(late, f), F.when(late, a + b * p), F.when(late, b), F.when(late, a)]


@frame
def msw(t, o, x):
    p = int(o[0])
    values = t.list(x, p)
    r = t.keep(weigh(values, [math.cos(2 * math.pi * (p - 1 - j) / p) for j in range(p)]))
    q = t.keep(weigh(values, [math.sin(2 * math.pi * (p - 1 - j) / p) for j in range(p)]))
    f = F.when(F.abs(r) > 0.001, F.atan(q / r)).otherwise(F.when(q < 0, -math.pi).otherwise(math.pi))
    f = f + F.when(r < 0, math.pi).otherwise(0.0) + math.pi / 2
    f = t.keep(f)
    f = f + F.when(f < 0, 2 * math.pi).when(f > 2 * math.pi, -2 * math.pi).otherwise(0.0)
    return [F.sin(f), F.sin(f + math.pi / 4)]


def since(t: Stage, h: Column, l: Column, p: float) -> tuple[Column, Column]:
    """Aroon down and up: bars since the least low and the greatest high of p + 1, the latest of equals."""
    low = t.over(F.max(F.struct((-l).alias("x"), t.number.alias("n"))), p + 1)["n"]
    high = t.over(F.max(F.struct(h.alias("x"), t.number.alias("n"))), p + 1)["n"]
    return (p - (t.number - low)) * 100 / p, (p - (t.number - high)) * 100 / p


@frame
def aroon(t, o, h, l):
    return list(since(t, h, l, o[0]))


@frame
def aroonosc(t, o, h, l):
    down, up = since(t, h, l, o[0])
    return [up - down, down, up]


@frame
def bbands(t, o, x):
    m, d = t.avg(x, o[0]), t.sd(x, o[0])
    return [m - o[1] * d, m, m + o[1] * d]


@frame
def tr(t, o, h, l, c):
    pc = t.lag(c)
    return [F.greatest(h - l, F.abs(h - pc), F.abs(l - pc))]


@frame
def stddev(t, o, x):
    return [t.sd(x, o[0]), t.avg(x, o[0])]


@frame
def volatility(t, o, x):
    r = t.keep(divided(x, t.lag(x)) - 1)
    return [math.sqrt(252) * t.over(F.stddev_pop(r), o[0])]


@frame
def vhf(t, o, x):
    d = t.keep(F.abs(x - t.lag(x)))
    return [(t.max(x, o[0]) - t.min(x, o[0])) / F.greatest(t.sum(d, o[0]), F.lit(EPS))]


@frame
def ad(t, o, h, l, c, v):
    return [t.total(F.when(h - l > EPS, ((c - l) - (h - c)) / (h - l) * v).otherwise(0.0))]


@frame
def obv(t, o, c, v):
    d = t.keep(F.coalesce(F.signum(c - t.lag(c)) * v, F.lit(0.0)))
    return [t.total(d)]


@frame
def mfi(t, o, h, l, c, v):
    tp = t.keep((h + l + c) * (1 / 3))
    last = t.keep(t.lag(tp))
    up = t.sum(F.when(tp > last, tp * v).otherwise(0.0), o[0])
    down = t.sum(F.when(tp < last, tp * v).otherwise(0.0), o[0])
    return [100 * up / F.greatest(up + down, F.lit(EPS)), tp]


@frame
def vosc(t, o, v):
    a, b = t.avg(v, o[0]), t.avg(v, o[1])
    return [F.when(b == 0, 0.0).otherwise(100 * (a - b) / b), F.when(t.number >= o[0], a), F.when(t.number >= o[1], b)]


@frame
def emv(t, o, h, l, v):
    m = t.keep(0.5 * (h + l))
    return [(m - t.lag(m)) * 10000 * F.greatest(h - l, F.lit(EPS)) / F.greatest(v, F.lit(EPS)), m]


@frame
def wad(t, o, h, l, c):
    pc = t.keep(t.lag(c))
    return [t.total(F.when(c > pc, c - F.least(pc, l)).when(c < pc, c - F.greatest(pc, h)).otherwise(0.0))]


@frame
def marketfi(t, o, h, l, v):
    return [(h - l) / F.greatest(v, F.lit(EPS))]


@frame
def avgprice(t, o, op, h, l, c):
    return [(op + h + l + c) * 0.25]


@frame
def medprice(t, o, h, l):
    return [0.5 * (h + l)]


@frame
def typprice(t, o, h, l, c):
    return [(h + l + c) * (1 / 3)]


@frame
def wcprice(t, o, h, l, c):
    return [(2 * c + h + l) * 0.25]


@frame
def max_(t, o, x):
    return [t.max(x, o[0])]


@frame
def min_(t, o, x):
    return [t.min(x, o[0])]


@frame
def mom(t, o, x):
    return [x - t.lag(x, o[0])]


@frame
def roc(t, o, x):
    d = x - t.lag(x, o[0])
    return [d / F.greatest(t.lag(x, o[0]), F.lit(EPS)), d]


@frame
def rocr(t, o, x):
    return [x / F.greatest(t.lag(x, o[0]), F.lit(EPS))]


@frame
def bop(t, o, op, h, l, c):
    return [(c - op) / F.greatest(h - l, F.lit(EPS))]


@frame
def dpo(t, o, x):
    p = int(o[0])
    m = t.avg(x, p)
    return [t.lag(x, p // 2 + 1) - m, F.when(t.number >= p, m)]


@frame
def md(t, o, x):
    m, values = t.keep(t.avg(x, o[0])), t.list(x, o[0])
    return [deviation(values, m, o[0]), m]


@frame
def qstick(t, o, op, c):
    return [t.avg(c - op, o[0])]
