"""The recursive indicators over whole arrays: the same outputs and the same states as their steps, a run of bars at a time.

A scan takes (state, options, bar numbers, inputs...) for consecutive bars of one series and returns (values, whether there is one) for each output. Linear recurrences run in blocks: inside a block a product with powers of the factor, from block to block one number. What is recursive in another way loops over plain numbers. States are those of the steps, so that either can go on from the other. Runs with a NaN or an infinity are left to the steps, which let them through bar by bar.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from .steps import EPS

Out = tuple[np.ndarray, np.ndarray]
SCANS: dict[str, Callable[..., list[Out]]] = {}
BLOCK = 128


def scan(f: Callable) -> Callable:
    SCANS[f.__name__] = f
    return f


@lru_cache(256)
def _powers(b: float) -> tuple[np.ndarray, np.ndarray]:
    """What each value of a block adds to the later ones, and what the value before the block does."""
    k = np.arange(BLOCK)
    gap = k[:, None] - k[None, :]
    return np.where(gap >= 0, b ** np.maximum(gap, 0), 0.0).T.copy(), b ** (k + 1.0)


def added(first: float, x: np.ndarray) -> np.ndarray:
    """Running sums from ``first`` on, in the order in which they come."""
    return np.cumsum(np.concatenate([[first], x]))[1:]


def recur(x: np.ndarray, b: float, last: float, plain: bool = False) -> np.ndarray:
    """y[t] = b * y[t - 1] + x[t]. ``plain``: one after the other, for outputs that jump at the last digit."""
    n = len(x)
    if plain or n < BLOCK:
        out = np.empty(n)
        for k, v in enumerate(x.tolist()):
            out[k] = last = b * last + v
        return out
    inside, carry = _powers(b)
    blocks = -(-n // BLOCK)
    z = np.zeros(blocks * BLOCK)
    z[:n] = x
    y = z.reshape(blocks, BLOCK) @ inside
    for k in range(blocks):
        y[k] += carry * last
        last = y[k, -1]
    return y.reshape(-1)[:n]


def divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return a / b


def average(s: dict, key: str, x: np.ndarray, p: float) -> np.ndarray:
    """An exponential average that begins with its first value."""
    if not len(x):
        return np.zeros(0)
    a = 2.0 / (p + 1.0)
    last = s.get(key)
    y = recur(x * a, 1.0 - a, last) if last is not None else np.concatenate([x[:1], recur(x[1:] * a, 1.0 - a, float(x[0]))])
    s[key] = float(y[-1])
    return y


def chain(s: dict, x: np.ndarray, i: np.ndarray, p: int, levels: int) -> list[np.ndarray]:
    """Averages of averages; each begins when the one before has had p bars."""
    out, v = [], x
    for k in range(levels):
        start = min(max(0, k * (p - 1) - int(i[0])), len(i))
        y = np.full(len(i), np.nan)
        y[start:] = average(s, f"e{k}", v[start:], p)
        out.append(y)
        v = y
    return out


def before(s: dict, key: str, x: np.ndarray) -> np.ndarray:
    """Each bar's predecessor; the first bar of a series is its own."""
    last = s.get(key)
    s[key] = float(x[-1])
    return np.concatenate([x[:1] if last is None else [last], x[:-1]])


def past(s: dict, key: str, x: np.ndarray, p: int) -> tuple[np.ndarray, int]:
    """The last values under ``key`` and the new ones behind them, and how many are old."""
    old = s.get(key, [])
    whole = np.concatenate([np.array(old, float), x])
    s[key] = whole[-p:].tolist()
    return whole, len(old)


def windows(whole: np.ndarray, n: int, p: int) -> np.ndarray:
    """The last p values at each of the last n; where there are fewer, zeros stand in front."""
    short = max(0, p - 1 + n - len(whole))
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(short), whole]), p)[-n:] if n else np.zeros((0, p))


def spreads(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, population standard deviation of at least EPS) of each window, some rows at a time."""
    m, d = np.empty(len(w)), np.empty(len(w))
    step = max(1, 1_000_000 // w.shape[1])
    for at in range(0, len(w), step):
        x = w[at : at + step]
        m[at : at + step] = x.mean(1)
        d[at : at + step] = np.sqrt(((x - m[at : at + step, None]) ** 2).mean(1))
    return m, np.maximum(d, EPS)


def later(i: np.ndarray, first: float) -> int:
    """How many of the bars come before bar ``first``."""
    return int(min(max(0, math.ceil(first) - int(i[0])), len(i)))


def wilder_sum(s: dict, key: str, x: np.ndarray, i: np.ndarray, p: int) -> np.ndarray:
    """A sum over the first p bars, then smoothing that isn't normalised."""
    k = later(i, p)
    y = np.empty(len(x))
    y[:k] = added(s.get(key, 0.0), x[:k])
    last = float(y[k - 1]) if k else s.get(key, 0.0)
    y[k:] = recur(x[k:], (p - 1) / p, last)
    s[key] = float(y[-1])
    return y


def seeded(s: dict, key: str, x: np.ndarray, i: np.ndarray, p: int, first: int, last: int, weight: float) -> np.ndarray:
    """A mean of p values that is gathered from bar ``first`` to bar ``last``, then smoothing with ``weight`` for the new value. NaN before."""
    a, b = later(i, first), later(i, last + 1)
    y = np.full(len(x), np.nan)
    if b > a:
        y[a:b] = added(s.get(key, 0.0), x[a:b] / p)
        s[key] = float(y[b - 1])
    if b < len(x):
        y[b:] = recur(x[b:] * weight, (p - 1) / p, s[key])
        s[key] = float(y[-1])
    return y


def true_range(s: dict, h: np.ndarray, l: np.ndarray, c: np.ndarray) -> np.ndarray:
    first = s.get("pc") is None
    pc = before(s, "pc", c)
    t = np.maximum(h - l, np.maximum(np.abs(h - pc), np.abs(l - pc)))
    if first:
        t[0] = h[0] - l[0]
    return t


def moves(s: dict, h: np.ndarray, l: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.maximum(h - before(s, "ph", h), 0.0), np.maximum(before(s, "pl", l) - l, 0.0)
    return np.where(down > up, 0.0, up), np.where(up > down, 0.0, down)


# Averages


@scan
def ema(s, o, i, x):
    return [(average(s, "e", x, o[0]), i >= o[0])]


@scan
def dema(s, o, i, x):
    p = int(o[0])
    a, b = chain(s, x, i, p, 2)
    return [(2 * a - b, i >= 2 * p - 2), (a, i >= p)]


@scan
def tema(s, o, i, x):
    p = int(o[0])
    a, b, c = chain(s, x, i, p, 3)
    return [(3 * a - 3 * b + c, i >= 3 * p - 3), (2 * a - b, i >= 2 * p - 2), (a, i >= p)]


@scan
def trix(s, o, i, x):
    p = int(o[0])
    a, b, c = chain(s, x, i, p, 3)
    last = s.get("t")
    pc = np.concatenate([[np.nan if last is None else last], c[:-1]])
    s["t"] = None if math.isnan(c[-1]) else float(c[-1])
    return [(divided(100 * (c - pc), c), (i >= 3 * p - 2) & ~np.isnan(pc)), (3 * a - 3 * b + c, i >= 3 * p - 3), (2 * a - b, i >= 2 * p - 2), (a, i >= p)]


@scan
def zlema(s, o, i, x):
    lag = max((int(o[0]) - 1) // 2, 1)
    whole, k = past(s, "w", x, lag + 1)
    a = later(i, lag)
    if a and i[a - 1] == lag - 1:
        s["e"] = float(x[a - 1])
    y = np.full(len(x), np.nan)
    at = k + np.arange(a, len(x))
    y[a:] = average(s, "e", 2 * x[a:] - whole[at - lag], o[0])
    return [(y, i >= lag)]


@scan
def kama(s, o, i, x):
    p = int(o[0])
    whole, _ = past(s, "w", x, p + 1)
    a = later(i, p)
    if a:
        s["k"] = float(x[a - 1])
    y = np.full(len(x), np.nan)
    if a < len(x):
        w = windows(whole, len(x), p + 1)[a:]
        path = np.abs(np.diff(w, axis=1)).sum(1)
        er = np.where(path > 0, divided(np.abs(x[a:] - w[:, 0]), path), 1.0)
        rate = ((2 / 3 - 2 / 31) * er + 2 / 31) ** 2
        last, out = s["k"], []
        for v, r in zip(x[a:].tolist(), rate.tolist()):
            last += r * (v - last)
            out.append(last)
        y[a:] = out
        s["k"] = last
    return [(y, i >= p)]


@scan
def vidya(s, o, i, x):
    short, long, alpha = int(o[0]), int(o[1]), o[2]
    whole, _ = past(s, "w", x, long)
    px = before(s, "px", x)
    ma, sa = spreads(windows(whole, len(x), short))
    mb, sb = spreads(windows(whole, len(x), long))
    a = later(i, long - 1)
    y = np.full(len(x), np.nan)
    if a < len(x):
        last, out = s.get("v", float(px[a])), []
        for v, k in zip(x[a:].tolist(), (alpha * sa[a:] / sb[a:]).tolist()):
            last = (v - last) * k + last
            out.append(last)
        y[a:] = out
        s["v"] = last
    return [(y, i >= long - 1), (ma, i >= short), (mb, i >= long), (sa, i >= short), (sb, i >= long)]


@scan
def wilders(s, o, i, x):
    p = int(o[0])
    a = later(i, p)
    y = np.full(len(x), np.nan)
    if a:
        whole, _ = past(s, "w", x[:a], p)
        if i[a - 1] == p - 1:
            s["y"], s["w"] = float(whole.mean()), []
    if a < len(x):
        y[a:] = recur(x[a:] * (1 - (p - 1) / p), (p - 1) / p, s["y"])
        s["y"] = float(y[-1])
    return [(y, i >= p)]


# Oscillators


def strength(s: dict, p: int, i: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The relative strength index from bar p on; NaN before."""
    if i[0] == 0:
        s["u"] = s["d"] = 0.0
    d = x - before(s, "px", x)
    parts = []
    for key, v in (("u", np.maximum(d, 0.0)), ("d", np.maximum(-d, 0.0))):
        k = later(i, p + 1)
        y = np.empty(len(x))
        y[:k] = added(s[key], v[:k] / p)
        y[k:] = recur(v[k:] / p, (p - 1) / p, float(y[k - 1]) if k else s[key], plain=True)
        s[key] = float(y[-1])
        parts.append(y)
    r = divided(100 * parts[0], parts[0] + parts[1])
    r[: later(i, p)] = np.nan
    return r


@scan
def rsi(s, o, i, x):
    return [(strength(s, int(o[0]), i, x), i >= o[0] + 1)]


@scan
def stochrsi(s, o, i, x):
    p = int(o[0])
    r = strength(s, p, i, x)
    a = later(i, p)
    y = np.full(len(x), np.nan)
    if a < len(x):
        whole, _ = past(s, "w", r[a:], p)
        w = windows(whole, len(x) - a, p)
        low, width = w.min(1), w.max(1) - w.min(1)
        y[a:] = np.where(width < EPS, 0.0, divided(100 * (r[a:] - low), width))
    return [(y, i >= 2 * p), (r, i >= p + 1)]


@scan
def macd(s, o, i, x):
    short, long, sig = o
    a, b = average(s, "a", x, short), average(s, "b", x, long)
    line, k = a - b, later(i, long - 1)
    g = np.full(len(x), np.nan)
    g[k:] = average(s, "g", line[k:], sig)
    late = i >= long + sig - 2
    return [(line, i >= long - 1), (g, late), (line - g, late), (a, i >= short), (b, i >= long)]


@scan
def ppo(s, o, i, x):
    a, b = average(s, "a", x, o[0]), average(s, "b", x, o[1])
    return [((a - b) * 100 / np.maximum(b, EPS), i >= o[1]), (a, i >= o[0]), (b, i >= o[1])]


@scan
def apo(s, o, i, x):
    a, b = average(s, "a", x, o[0]), average(s, "b", x, o[1])
    return [(a - b, i >= o[1] - 1), (a, i >= o[0]), (b, i >= o[1])]


@scan
def fisher(s, o, i, h, l):
    p = int(o[0])
    m = 0.5 * (h + l)
    whole, _ = past(s, "w", m, p)
    a = later(i, p - 1)
    f, g = np.full(len(m), np.nan), np.full(len(m), np.nan)
    if a < len(m):
        w = windows(whole, len(m), p)[a:]
        low = w.min(1)
        part = 0.66 * ((m[a:] - low) / np.maximum(w.max(1) - low, 0.001) - 0.5)
        v, last, out = s.get("v", 0.0), s.get("f", 0.0), [s.get("f", 0.0)]
        for x in part.tolist():
            v = x + 0.67 * v
            v = 0.999 if v > 0.99 else -0.999 if v < -0.99 else v
            last = 0.5 * (math.log((1 + v) / (1 - v)) + last)
            out.append(last)
        s["v"], s["f"] = v, last
        f[a:], g[a:] = out[1:], out[:-1]
    return [(f, i >= p - 1), (g, i >= p - 1)]


# Direction


@scan
def dm(s, o, i, h, l):
    p = int(o[0])
    up, down = moves(s, h, l)
    return [(wilder_sum(s, "u", up, i, p), i >= p), (wilder_sum(s, "d", down, i, p), i >= p)]


def directions(s, p, i, h, l, c):
    t = true_range(s, h, l, c)
    up, down = moves(s, h, l)
    return wilder_sum(s, "u", up, i, p), wilder_sum(s, "d", down, i, p), wilder_sum(s, "a", t, i, p), t


def index(u: np.ndarray, d: np.ndarray) -> np.ndarray:
    x = divided(100 * np.abs(u - d), u + d)
    return np.where(np.isnan(x), 0.0, x)


@scan
def di(s, o, i, h, l, c):
    p = int(o[0])
    u, d, a, t = directions(s, p, i, h, l, c)
    plus, minus = divided(u * 100, a), divided(d * 100, a)
    return [(np.where(np.isnan(plus), 0.0, plus), i >= p), (np.where(np.isnan(minus), 0.0, minus), i >= p), (a / p, i >= p), (t, i >= 1)]


@scan
def dx(s, o, i, h, l, c):
    p = int(o[0])
    u, d, a, t = directions(s, p, i, h, l, c)
    return [(index(u, d), i >= p), (a / p, i >= p), (t, i >= 1)]


def rating(s, p, i, h, l, c):
    u, d, a, t = directions(s, p, i, h, l, c)
    x = index(u, d)
    return seeded(s, "x", x, i, p, p - 1, 2 * p - 2, 1 - (p - 1) / p), x, a, t


@scan
def adx(s, o, i, h, l, c):
    p = int(o[0])
    v, x, a, t = rating(s, p, i, h, l, c)
    return [(v, i >= 2 * p - 1), (x, i >= p), (a / p, i >= p), (t, i >= 1)]


@scan
def adxr(s, o, i, h, l, c):
    p = int(o[0])
    v, x, a, t = rating(s, p, i, h, l, c)
    k = later(i, 2 * p - 2)
    y = np.full(len(v), np.nan)
    if k < len(v):
        whole, _ = past(s, "w", v[k:], p)
        y[k:] = 0.5 * (v[k:] + windows(whole, len(v) - k, p)[:, 0])
    return [(y, i >= 3 * p - 3), (v, i >= 2 * p - 1), (x, i >= p), (a / p, i >= p), (t, i >= 1)]


@scan
def psar(s, o, i, h, l):
    first, most = o
    hs, ls = [*s.get("h", []), *h.tolist()], [*s.get("l", []), *l.tolist()]
    old, n = len(s.get("h", [])), int(i[0])
    out = np.full(len(h), np.nan)
    sar, ext, up, a = s.get("sar", 0.0), s.get("ext", 0.0), s.get("up", True), s.get("af", first)
    for k in range(old, len(hs)):
        hi, lo = hs[k], ls[k]
        at, n = n, n + 1
        if at == 0:
            continue
        if at == 1:
            up = hs[k - 1] + ls[k - 1] <= hi + lo
            sar, ext = (ls[k - 1], hs[k - 1]) if up else (hs[k - 1], ls[k - 1])
            a = first
        sar += a * (ext - sar)
        back = slice(max(0, k - 2), k)
        if up:
            sar = min(sar, *ls[back])
            if hi > ext:
                ext, a = hi, min(a + first, most)
        else:
            sar = max(sar, *hs[back])
            if lo < ext:
                ext, a = lo, min(a + first, most)
        if (up and lo < sar) or (not up and hi > sar):
            up, sar, a = not up, ext, first
            ext = hi if up else lo
        out[k - old] = sar
    s["h"], s["l"] = hs[-3:], ls[-3:]
    if n > 1:
        s["sar"], s["ext"], s["up"], s["af"] = sar, ext, up, a
    return [(out, i >= 1)]


# Volatility and volume


def ranged(s, p, i, h, l, c):
    t = true_range(s, h, l, c)
    return seeded(s, "a", t, i, p, 0, p - 1, 1 - (p - 1) / p), t


@scan
def atr(s, o, i, h, l, c):
    a, t = ranged(s, int(o[0]), i, h, l, c)
    return [(a, i >= o[0]), (t, i >= 1)]


@scan
def natr(s, o, i, h, l, c):
    a, t = ranged(s, int(o[0]), i, h, l, c)
    return [(divided(100 * a, c), i >= o[0]), (a, i >= o[0]), (t, i >= 1)]


@scan
def cvi(s, o, i, h, l):
    p = int(o[0])
    e = average(s, "e", np.maximum(h - l, EPS), p)
    whole, _ = past(s, "w", e, p + 1)
    first = windows(whole, len(e), p + 1)[:, 0]
    return [(divided(100 * (e - first), first), i >= 2 * p - 1)]


@scan
def adosc(s, o, i, h, l, c, v):
    flow = np.where(h - l > EPS, divided((c - l) - (h - c), h - l) * v, 0.0)
    x = added(s.get("ad", 0.0), flow)
    s["ad"] = float(x[-1])
    a, b = average(s, "a", x, o[0]), average(s, "b", x, o[1])
    return [(a - b, i >= o[1] - 1), (a, i >= o[0]), (b, i >= o[1]), (x, i >= 0)]


def volume_index(s, i, c, v, chosen):
    pc, pv = before(s, "pc", c), before(s, "pv", v)
    own = chosen(v, pv)
    own[0] &= i[0] > 0
    y = np.cumprod(np.concatenate([[s.get("y", 1000.0)], np.where(own, divided(c, pc), 1.0)]))[1:]
    s["y"] = float(y[-1])
    return [(y, i >= 1)]


@scan
def nvi(s, o, i, c, v):
    return volume_index(s, i, c, v, np.less)


@scan
def pvi(s, o, i, c, v):
    return volume_index(s, i, c, v, np.greater)


@scan
def kvo(s, o, i, h, l, c, v):
    hlc, dm = h + l + c, h - l
    force = np.zeros(len(h))
    start = 0
    if s.get("hlc") is None:
        s["hlc"], s["ph"], s["pl"], s["trend"], s["cm"] = float(hlc[0]), float(h[0]), float(l[0]), -2.0, 0.0
        start = 1
    last, trend, cm, width = s["hlc"], s["trend"], s["cm"], s["ph"] - s["pl"]
    trends, cms = [], []
    for x, d in zip(hlc[start:].tolist(), dm[start:].tolist()):
        if trend != 1.0 and x > last:
            trend, cm = 1.0, width
        elif trend != -1.0 and x < last:
            trend, cm = -1.0, width
        cm += max(d, EPS)
        last, width = x, d
        trends.append(trend)
        cms.append(cm)
    s["hlc"], s["ph"], s["pl"], s["trend"], s["cm"] = float(hlc[-1]), float(h[-1]), float(l[-1]), trend, cm
    force[start:] = np.abs(divided(dm[start:], np.array(cms, float)) * 2 - 1) * v[start:] * 100 * np.array(trends, float)
    a, b = np.full(len(h), np.nan), np.full(len(h), np.nan)
    a[start:], b[start:] = average(s, "a", force[start:], o[0]), average(s, "b", force[start:], o[1])
    return [(a - b, i >= o[1]), (a, i >= o[0]), (b, i >= o[1])]


@scan
def mass(s, o, i, h, l):
    p = int(o[0])
    a = average(s, "a", h - l, 9)
    k, m = later(i, 8), later(i, 16)
    b = np.full(len(a), np.nan)
    b[k:] = average(s, "b", a[k:], 9)
    y = np.full(len(a), np.nan)
    if m < len(a):
        whole, _ = past(s, "w", divided(a[m:], b[m:]), p)
        y[m:] = windows(whole, len(a) - m, p).sum(1)
    return [(y, i >= p + 15)]
