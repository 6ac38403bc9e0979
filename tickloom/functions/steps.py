"""Indicators as step functions: one bar in, one row of outputs out, and a state that is plain JSON.

A step takes (state, options, inputs...) and returns its outputs, required ones first, then the optional ones, with None until each begins. ``state["i"]`` is the bar's 0-based number; the caller keeps it. The same steps serve the grouped kernels (operators that depend on their own last value), resumable streams for every indicator, and tests against the window expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

EPS = 2.220446049250313e-16
Row = tuple
STEPS: dict[str, Callable[..., Row]] = {}


def step(f: Callable) -> Callable:
    STEPS[f.__name__.rstrip("_")] = f
    return f


def roll(s: dict, key: str, x: float, p: int) -> list[float]:
    """The last p values under ``key``, x included."""
    w = s.setdefault(key, [])
    w.append(x)
    if len(w) > p:
        del w[0]
    return w


def ema_of(s: dict, key: str, x: float, p: float) -> float:
    """An exponential average that begins with its first value."""
    last = s.get(key)
    a = 2.0 / (p + 1.0)
    s[key] = y = x if last is None else last * (1.0 - a) + x * a
    return y


def mean(w: list[float]) -> float:
    return sum(w) / len(w)


def spread(w: list[float]) -> float:
    """Population standard deviation, at least EPS."""
    m = mean(w)
    return max(math.sqrt(sum((x - m) ** 2 for x in w) / len(w)), EPS)


def ratio(a: float, b: float) -> float:
    """a / b by IEEE rules."""
    if b:
        return a / b
    return math.nan if not a or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1.0, b)


def top(w: list[float]) -> float:
    """The greatest; NaN if one of them is."""
    return math.nan if any(x != x for x in w) else max(w)


def low(w: list[float]) -> float:
    return math.nan if any(x != x for x in w) else min(w)


def when(ok: bool, *values: float) -> Row:
    return values if ok else (None,) * len(values)


def true_range(s: dict, h: float, l: float, c: float) -> float:
    pc = s.get("pc")
    s["pc"] = c
    return h - l if pc is None else max(h - l, abs(h - pc), abs(l - pc))


# Moving averages


@step
def sma(s, o, x):
    w = roll(s, "w", x, int(o[0]))
    return when(s["i"] >= o[0], mean(w))


@step
def ema(s, o, x):
    return when(s["i"] >= o[0], ema_of(s, "e", x, o[0]))


def weighted(w: list[float]) -> float:
    n = len(w)
    return sum((k + 1) * x for k, x in enumerate(w)) / (n * (n + 1) / 2)


@step
def wma(s, o, x):
    w = roll(s, "w", x, int(o[0]))
    return when(s["i"] >= o[0], weighted(w), mean(w))


def chain(s: dict, x: float, p: int, levels: int) -> list[float | None]:
    """Averages of averages; each begins when the one before has had p bars."""
    out, v = [], x
    for k in range(levels):
        if s["i"] < k * (p - 1):
            out.append(None)
            continue
        v = ema_of(s, f"e{k}", v, p)
        out.append(v)
    return out


@step
def dema(s, o, x):
    p = int(o[0])
    a, b = chain(s, x, p, 2)
    return when(s["i"] >= 2 * p - 2, 2 * a - (b or 0.0)) + when(s["i"] >= p, a)


@step
def tema(s, o, x):
    p = int(o[0])
    a, b, c = chain(s, x, p, 3)
    i = s["i"]
    return when(i >= 3 * p - 3, 3 * a - 3 * (b or 0.0) + (c or 0.0)) + when(i >= 2 * p - 2, 2 * a - (b or 0.0)) + when(i >= p, a)


@step
def trima(s, o, x):
    p = int(o[0])
    w = roll(s, "w", x, p)
    return when(s["i"] >= p - 1, sum(min(k + 1, p - k) * v for k, v in enumerate(w)) / triangle(p))


def triangle(p: int) -> float:
    return float(sum(min(k + 1, p - k) for k in range(p)))


@step
def hma(s, o, x):
    p = int(o[0])
    q = math.isqrt(p)
    w = roll(s, "w", x, p)
    if s["i"] < p - 1:
        return (None,)
    d = roll(s, "d", 2 * weighted(w[-max(1, p // 2) :]) - weighted(w), q)
    return when(s["i"] >= p + q, weighted(d))


@step
def zlema(s, o, x):
    lag = max((int(o[0]) - 1) // 2, 1)
    w = roll(s, "w", x, lag + 1)
    if s["i"] < lag - 1:
        return (None,)
    if s["i"] == lag - 1:
        s["e"] = x
        return (None,)
    return (ema_of(s, "e", 2 * x - w[0], o[0]),)


@step
def kama(s, o, x):
    p = int(o[0])
    w = roll(s, "w", x, p + 1)
    if s["i"] < p:
        s["k"] = x
        return (None,)
    path = sum(abs(b - a) for a, b in zip(w, w[1:]))
    er = abs(x - w[0]) / path if path else 1.0
    s["k"] += ((2 / 3 - 2 / 31) * er + 2 / 31) ** 2 * (x - s["k"])
    return (s["k"],)


@step
def vidya(s, o, x):
    short, long, alpha = int(o[0]), int(o[1]), o[2]
    w = roll(s, "w", x, long)
    last = s.get("v", s.get("px"))
    s["px"] = x
    a, b = w[-short:], w
    sa, sb = spread(a), spread(b)
    i = s["i"]
    if i >= long - 1:
        k = alpha * sa / sb
        s["v"] = (x - last) * k + last
    return when(i >= long - 1, s.get("v")) + when(i >= short, mean(a)) + when(i >= long, mean(b)) + when(i >= short, sa) + when(i >= long, sb)


@step
def vwma(s, o, c, v):
    a, b = roll(s, "cv", c * v, int(o[0])), roll(s, "v", v, int(o[0]))
    total = sum(b)
    return when(s["i"] >= o[0], sum(a) / total if total else 0.0)


@step
def wilders(s, o, x):
    p = int(o[0])
    if s["i"] < p:
        w = roll(s, "w", x, p)
        if s["i"] == p - 1:
            s["y"] = mean(w)
            s["w"] = []
        return (None,)
    m = (p - 1) / p
    s["y"] = s["y"] * m + x * (1 - m)
    return (s["y"],)


# Oscillators


def rsi_of(s: dict, p: int, x: float) -> float | None:
    """From bar p on, where it comes from the seeds."""
    px, s["px"] = s.get("px"), x
    if px is None:
        s["u"] = s["d"] = 0.0
        return None
    u, d = max(x - px, 0.0), max(px - x, 0.0)
    if s["i"] <= p:
        s["u"] += u / p
        s["d"] += d / p
        if s["i"] < p:
            return None
    else:
        s["u"] = s["u"] * ((p - 1) / p) + u / p
        s["d"] = s["d"] * ((p - 1) / p) + d / p
    return ratio(100 * s["u"], s["u"] + s["d"])


@step
def rsi(s, o, x):
    r = rsi_of(s, int(o[0]), x)
    return when(s["i"] >= o[0] + 1, r)


@step
def macd(s, o, x):
    short, long, sig = o
    a, b = ema_of(s, "a", x, short), ema_of(s, "b", x, long)
    i, line = s["i"], a - b
    if i >= long - 1:
        g = ema_of(s, "g", line, sig)
    ok, late = i >= long - 1, i >= long + sig - 2
    return when(ok, line) + (when(late, g, line - g) if ok else (None, None)) + when(i >= short, a) + when(i >= long, b)


@step
def stoch(s, o, h, l, c):
    k, slow, d = map(int, o)
    hi, lo = top(roll(s, "h", h, k)), low(roll(s, "l", l, k))
    i = s["i"]
    if i < k + 1:
        return (None, None)
    f = roll(s, "f", 100 * (c - lo) / max(hi - lo, EPS), slow)
    if i < k + slow:
        return (None, None)
    v = mean(f)
    return (v,) + when(i >= k + slow + d, mean(roll(s, "k", v, d)))


@step
def stochrsi(s, o, x):
    p = int(o[0])
    r = rsi_of(s, p, x)
    if r is None:
        return (None, None)
    w = roll(s, "w", r, p)
    width = max(w) - min(w)
    return when(s["i"] >= 2 * p, 0.0 if width < EPS else 100 * (r - min(w)) / width) + when(s["i"] >= p + 1, r)


@step
def willr(s, o, h, l, c):
    p = int(o[0])
    hi, lo = top(roll(s, "h", h, p)), low(roll(s, "l", l, p))
    return when(s["i"] >= p, 0.0 if hi - lo < EPS else 100 * (hi - c) / (hi - lo))


@step
def cci(s, o, h, l, c):
    p = int(o[0])
    t = (h + l + c) * (1 / 3)
    w = roll(s, "w", t, p)
    m = mean(w)
    d = sum(abs(x - m) for x in w) / p
    i = s["i"]
    return when(i >= 2 * p - 2, (t - m) / (0.015 * d) if d else 0.0) + when(i >= p, m, d) + (t,)


@step
def cmo(s, o, x):
    p = int(o[0])
    px, s["px"] = s.get("px"), x
    if px is None:
        return (None,)
    u, d = sum(roll(s, "u", max(x - px, 0.0), p)), sum(roll(s, "d", max(px - x, 0.0), p))
    return when(s["i"] >= p + 1, ratio(100 * (u - d), u + d))


@step
def ultosc(s, o, h, l, c):
    short, mid, long = map(int, o)
    pc, s["pc"] = s.get("pc"), c
    if pc is None:
        return (None,)
    b, t = roll(s, "b", c - min(l, pc), long), roll(s, "t", max(h, pc) - min(l, pc), long)
    part = [ratio(sum(b[-n:]), sum(t[-n:])) for n in (short, mid, long)]
    return when(s["i"] >= long, 100 / 7 * (4 * part[0] + 2 * part[1] + part[2]))


@step
def ao(s, o, h, l):
    m = 0.5 * (h + l)
    w = roll(s, "w", m, 34)
    a, b = mean(w[-5:]), mean(w)
    i = s["i"]
    return when(i >= 34, a - b) + when(i >= 5, a) + when(i >= 34, b) + (m,)


@step
def fisher(s, o, h, l):
    p = int(o[0])
    m = 0.5 * (h + l)
    w = roll(s, "w", m, p)
    if s["i"] < p - 1:
        return (None, None)
    lo = min(w)
    v = 0.66 * ((m - lo) / max(max(w) - lo, 0.001) - 0.5) + 0.67 * s.get("v", 0.0)
    v = 0.999 if v > 0.99 else -0.999 if v < -0.99 else v
    last = s.get("f", 0.0)
    s["v"], s["f"] = v, 0.5 * (math.log((1 + v) / (1 - v)) + last)
    return (s["f"], last)


def line(w: list[float]) -> tuple[float, float]:
    """(slope, intercept) over x = 1..p."""
    p = len(w)
    sx, sxx = p * (p + 1) / 2, p * (p + 1) * (2 * p + 1) / 6
    sy, sxy = sum(w), sum((k + 1) * y for k, y in enumerate(w))
    d = p * sxx - sx * sx
    b = (p * sxy - sx * sy) / d if d else 0.0
    return b, (sy - b * sx) / p


@step
def linreg(s, o, x):
    w = roll(s, "w", x, int(o[0]))
    b, a = line(w)
    return when(s["i"] >= o[0], a + b * o[0], b, a)


@step
def tsf(s, o, x):
    w = roll(s, "w", x, int(o[0]))
    b, a = line(w)
    return when(s["i"] >= o[0], a + b * (o[0] + 1), a + b * o[0], b, a)


@step
def fosc(s, o, x):
    p = o[0]
    last = s.get("t")
    b, a = line(roll(s, "w", x, int(p)))
    s["t"] = t = a + b * (p + 1)
    return when(s["i"] >= p + 1, ratio(100 * (x - last), x) if last is not None else None) + when(s["i"] >= p, t, a + b * p, b, a)


@step
def msw(s, o, x):
    p = int(o[0])
    w = roll(s, "w", x, p)
    if s["i"] < p:
        return (None, None)
    r = sum(math.cos(2 * math.pi * j / p) * y for j, y in enumerate(reversed(w)))
    q = sum(math.sin(2 * math.pi * j / p) * y for j, y in enumerate(reversed(w)))
    f = math.atan(q / r) if abs(r) > 0.001 else math.pi * (-1 if q < 0 else 1)
    f += (math.pi if r < 0 else 0) + math.pi / 2
    f += 2 * math.pi if f < 0 else -2 * math.pi if f > 2 * math.pi else 0
    return (math.sin(f), math.sin(f + math.pi / 4))


@step
def trix(s, o, x):
    p = int(o[0])
    a, b, c = chain(s, x, p, 3)
    i = s["i"]
    last, s["t"] = s.get("t"), c
    return when(i >= 3 * p - 2 and last is not None, ratio(100 * (c - last), c) if last is not None else None) + when(i >= 3 * p - 3, 3 * a - 3 * (b or 0.0) + (c or 0.0)) + when(i >= 2 * p - 2, 2 * a - (b or 0.0)) + when(i >= p, a)


# Trend


@step
def ppo(s, o, x):
    a, b = ema_of(s, "a", x, o[0]), ema_of(s, "b", x, o[1])
    i = s["i"]
    return when(i >= o[1], (a - b) * 100 / max(b, EPS)) + when(i >= o[0], a) + when(i >= o[1], b)


@step
def apo(s, o, x):
    a, b = ema_of(s, "a", x, o[0]), ema_of(s, "b", x, o[1])
    i = s["i"]
    return when(i >= o[1] - 1, a - b) + when(i >= o[0], a) + when(i >= o[1], b)


def moves(s: dict, h: float, l: float) -> tuple[float, float]:
    """Upward and downward movement of one bar; the smaller gives way."""
    ph, pl = s.get("ph"), s.get("pl")
    s["ph"], s["pl"] = h, l
    if ph is None:
        return 0.0, 0.0
    up, down = max(h - ph, 0.0), max(pl - l, 0.0)
    return (up, 0.0) if up > down else (0.0, down) if down > up else (up, down)


def summed(s: dict, key: str, x: float, p: int) -> float:
    """A sum over the first p bars, then Wilder's un-normalised smoothing."""
    s[key] = y = s.get(key, 0.0) + x if s["i"] < p else s[key] * ((p - 1) / p) + x
    return y


@step
def dm(s, o, h, l):
    p = int(o[0])
    up, down = moves(s, h, l)
    return when(s["i"] >= p, summed(s, "u", up, p), summed(s, "d", down, p))


def di_of(s: dict, p: int, h: float, l: float, c: float) -> tuple[float, float, float, float]:
    t = true_range(s, h, l, c)
    up, down = moves(s, h, l)
    return summed(s, "u", up, p), summed(s, "d", down, p), summed(s, "a", t, p), t


@step
def di(s, o, h, l, c):
    p = int(o[0])
    u, d, a, t = di_of(s, p, h, l, c)
    plus, minus = ratio(u * 100, a), ratio(d * 100, a)
    i = s["i"]
    return when(i >= p, 0.0 if plus != plus else plus, 0.0 if minus != minus else minus, a / p) + when(i >= 1, t)


def dx_of(u: float, d: float) -> float:
    x = ratio(100 * abs(u - d), u + d)
    return 0.0 if x != x else x


@step
def dx(s, o, h, l, c):
    p = int(o[0])
    u, d, a, t = di_of(s, p, h, l, c)
    i = s["i"]
    return when(i >= p, dx_of(u, d), a / p) + when(i >= 1, t)


def adx_of(s: dict, p: int, h: float, l: float, c: float) -> tuple[float | None, float, float, float]:
    """The index from bar 2p-2 on, where it is its seed."""
    u, d, a, t = di_of(s, p, h, l, c)
    x, i = dx_of(u, d), s["i"]
    if p - 1 <= i <= 2 * p - 2:
        s["x"] = s.get("x", 0.0) + x / p
    elif i > 2 * p - 2:
        s["x"] = s["x"] * ((p - 1) / p) + x * (1 - (p - 1) / p)
    return (s["x"] if i >= 2 * p - 2 else None), x, a, t


@step
def adx(s, o, h, l, c):
    p = int(o[0])
    v, x, a, t = adx_of(s, p, h, l, c)
    i = s["i"]
    return when(i >= 2 * p - 1, v) + when(i >= p, x, a / p) + when(i >= 1, t)


@step
def adxr(s, o, h, l, c):
    p = int(o[0])
    v, x, a, t = adx_of(s, p, h, l, c)
    i = s["i"]
    w = roll(s, "w", v, p) if v is not None else []
    return when(i >= 3 * p - 3, 0.5 * (v + w[0]) if w else None) + when(i >= 2 * p - 1, v) + when(i >= p, x, a / p) + when(i >= 1, t)


def aroon_of(s: dict, p: int, h: float, l: float) -> tuple[float, float]:
    hs, ls = roll(s, "h", h, p + 1), roll(s, "l", l, p + 1)
    n = len(hs) - 1
    since = lambda w, f: n - max(k for k, x in enumerate(w) if x == f(w))
    return (p - since(ls, min)) * 100 / p, (p - since(hs, max)) * 100 / p


@step
def aroon(s, o, h, l):
    return when(s["i"] >= o[0], *aroon_of(s, int(o[0]), h, l))


@step
def aroonosc(s, o, h, l):
    down, up = aroon_of(s, int(o[0]), h, l)
    return when(s["i"] >= o[0], up - down, down, up)


@step
def psar(s, o, h, l):
    af, most = o
    hs, ls = roll(s, "h", h, 3), roll(s, "l", l, 3)
    if s["i"] == 0:
        return (None,)
    if s["i"] == 1:
        s["up"] = hs[0] + ls[0] <= h + l
        s["sar"], s["ext"] = (ls[0], hs[0]) if s["up"] else (hs[0], ls[0])
        s["af"] = af
    sar, ext, up, a = s["sar"], s["ext"], s["up"], s["af"]
    sar += a * (ext - sar)
    if up:
        sar = min(sar, *ls[:-1])
        if h > ext:
            ext, a = h, min(a + af, most)
    else:
        sar = max(sar, *hs[:-1])
        if l < ext:
            ext, a = l, min(a + af, most)
    if (up and l < sar) or (not up and h > sar):
        up, sar, a = not up, ext, af
        ext = h if up else l
    s["sar"], s["ext"], s["up"], s["af"] = sar, ext, up, a
    return (sar,)


# Volatility and volume


@step
def bbands(s, o, x):
    w = roll(s, "w", x, int(o[0]))
    m, d = mean(w), spread(w)
    return when(s["i"] >= o[0], m - o[1] * d, m, m + o[1] * d)


def atr_of(s: dict, p: int, h: float, l: float, c: float) -> tuple[float, float]:
    t = true_range(s, h, l, c)
    if s["i"] < p:
        s["a"] = s.get("a", 0.0) + t / p
    else:
        s["a"] = s["a"] * ((p - 1) / p) + t * (1 - (p - 1) / p)
    return s["a"], t


@step
def atr(s, o, h, l, c):
    a, t = atr_of(s, int(o[0]), h, l, c)
    return when(s["i"] >= o[0], a) + when(s["i"] >= 1, t)


@step
def natr(s, o, h, l, c):
    a, t = atr_of(s, int(o[0]), h, l, c)
    return when(s["i"] >= o[0], ratio(100 * a, c), a) + when(s["i"] >= 1, t)


@step
def tr(s, o, h, l, c):
    t = true_range(s, h, l, c)
    return when(s["i"] >= 1, t)


@step
def stddev(s, o, x):
    w = roll(s, "w", x, int(o[0]))
    return when(s["i"] >= o[0], spread(w), mean(w))


@step
def volatility(s, o, x):
    p = int(o[0])
    px, s["px"] = s.get("px"), x
    if px is None:
        return (None,)
    w = roll(s, "w", ratio(x, px) - 1, p)
    m = mean(w)
    return when(s["i"] >= p + 1, math.sqrt(252) * math.sqrt(sum((r - m) ** 2 for r in w) / len(w)))


@step
def vhf(s, o, x):
    p = int(o[0])
    w = roll(s, "w", x, p + 1)
    path = sum(abs(b - a) for a, b in zip(w, w[1:]))
    own = w[-p:]
    return when(s["i"] >= p, (max(own) - min(own)) / max(path, EPS))


@step
def cvi(s, o, h, l):
    p = int(o[0])
    e = ema_of(s, "e", max(h - l, EPS), p)
    w = roll(s, "w", e, p + 1)
    return when(s["i"] >= 2 * p - 1, ratio(100 * (e - w[0]), w[0]))


def ad_of(s: dict, h: float, l: float, c: float, v: float) -> float:
    s["ad"] = s.get("ad", 0.0) + (((c - l) - (h - c)) / (h - l) * v if h - l > EPS else 0.0)
    return s["ad"]


@step
def ad(s, o, h, l, c, v):
    return (ad_of(s, h, l, c, v),)


@step
def adosc(s, o, h, l, c, v):
    x = ad_of(s, h, l, c, v)
    a, b = ema_of(s, "a", x, o[0]), ema_of(s, "b", x, o[1])
    i = s["i"]
    return when(i >= o[1] - 1, a - b) + when(i >= o[0], a) + when(i >= o[1], b) + (x,)


@step
def obv(s, o, c, v):
    pc, s["pc"] = s.get("pc"), c
    s["y"] = s.get("y", 0.0) + (0.0 if pc is None or c == pc else v if c > pc else -v)
    return when(s["i"] >= 1, s["y"])


@step
def mfi(s, o, h, l, c, v):
    p = int(o[0])
    t = (h + l + c) * (1 / 3)
    last, s["t"] = s.get("t"), t
    if last is None:
        return (None, t)
    up, down = sum(roll(s, "u", t * v if t > last else 0.0, p)), sum(roll(s, "d", t * v if t < last else 0.0, p))
    return when(s["i"] >= p, 100 * up / max(up + down, EPS)) + (t,)


def index_of(s: dict, c: float, v: float, chosen: bool) -> Row:
    pc, pv = s.get("pc"), s.get("pv")
    s["pc"], s["pv"] = c, v
    y = s.get("y", 1000.0)
    if pv is not None and (v > pv if chosen else v < pv):
        y *= ratio(c, pc)
    s["y"] = y
    return when(s["i"] >= 1, y)


@step
def nvi(s, o, c, v):
    return index_of(s, c, v, False)


@step
def pvi(s, o, c, v):
    return index_of(s, c, v, True)


@step
def vosc(s, o, v):
    w = roll(s, "w", v, int(o[1]))
    a, b = mean(w[-int(o[0]) :]), mean(w)
    i = s["i"]
    return when(i >= o[1], 100 * (a - b) / b if b else 0.0) + when(i >= o[0], a) + when(i >= o[1], b)


@step
def kvo(s, o, h, l, c, v):
    hlc, dm = h + l + c, h - l
    last = s.get("hlc")
    if last is None:
        s["hlc"], s["ph"], s["pl"], s["trend"], s["cm"] = hlc, h, l, -2.0, 0.0
        return (None, None, None)
    if s["trend"] != 1.0 and hlc > last:
        s["trend"], s["cm"] = 1.0, s["ph"] - s["pl"]
    elif s["trend"] != -1.0 and hlc < last:
        s["trend"], s["cm"] = -1.0, s["ph"] - s["pl"]
    s["cm"] += max(dm, EPS)
    s["hlc"], s["ph"], s["pl"] = hlc, h, l
    vf = abs(ratio(dm, s["cm"]) * 2 - 1) * v * 100 * s["trend"]
    a, b = ema_of(s, "a", vf, o[0]), ema_of(s, "b", vf, o[1])
    i = s["i"]
    return when(i >= o[1], a - b) + when(i >= o[0], a) + when(i >= o[1], b)


@step
def emv(s, o, h, l, v):
    m = 0.5 * (h + l)
    last, s["m"] = s.get("m"), m
    return when(last is not None, (m - last) * 10000 * max(h - l, EPS) / max(v, EPS) if last is not None else None) + (m,)


@step
def wad(s, o, h, l, c):
    pc, s["pc"] = s.get("pc"), c
    if pc is not None:
        s["y"] = s.get("y", 0.0) + (c - min(pc, l) if c > pc else c - max(pc, h) if c < pc else 0.0)
    return when(s["i"] >= 1, s.get("y"))


@step
def marketfi(s, o, h, l, v):
    return ((h - l) / max(v, EPS),)


# Prices and statistics


@step
def avgprice(s, o, op, h, l, c):
    return ((op + h + l + c) * 0.25,)


@step
def medprice(s, o, h, l):
    return (0.5 * (h + l),)


@step
def typprice(s, o, h, l, c):
    return ((h + l + c) * (1 / 3),)


@step
def wcprice(s, o, h, l, c):
    return ((2 * c + h + l) * 0.25,)


@step
def max_(s, o, x):
    w = roll(s, "w", x, int(o[0]))
    return when(s["i"] >= o[0] - 1, top(w))


@step
def min_(s, o, x):
    w = roll(s, "w", x, int(o[0]))
    return when(s["i"] >= o[0] - 1, low(w))


@step
def mom(s, o, x):
    w = roll(s, "w", x, int(o[0]) + 1)
    return when(s["i"] >= o[0], x - w[0])


@step
def roc(s, o, x):
    w = roll(s, "w", x, int(o[0]) + 1)
    return when(s["i"] >= o[0], (x - w[0]) / max(w[0], EPS), x - w[0])


@step
def rocr(s, o, x):
    w = roll(s, "w", x, int(o[0]) + 1)
    return when(s["i"] >= o[0], x / max(w[0], EPS))


@step
def bop(s, o, op, h, l, c):
    return ((c - op) / max(h - l, EPS),)


@step
def dpo(s, o, x):
    p = int(o[0])
    back = p // 2 + 1
    w = roll(s, "w", x, max(p, back + 1))
    m = mean(w[-p:])
    return when(s["i"] >= p, w[-1 - back] - m if len(w) > back else None) + when(s["i"] >= p, m)


@step
def mass(s, o, h, l):
    a = ema_of(s, "a", h - l, 9)
    i = s["i"]
    if i < 8:
        return (None,)
    b = ema_of(s, "b", a, 9)
    if i < 16:
        return (None,)
    return when(i >= o[0] + 15, sum(roll(s, "w", ratio(a, b), int(o[0]))))


@step
def md(s, o, x):
    w = roll(s, "w", x, int(o[0]))
    m = mean(w)
    return when(s["i"] >= o[0], sum(abs(v - m) for v in w) / len(w), m)


@step
def qstick(s, o, op, c):
    w = roll(s, "w", c - op, int(o[0]))
    return when(s["i"] >= o[0], mean(w))
