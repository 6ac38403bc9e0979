"""Candlestick patterns: features as columns, one Boolean expression for each pattern, generated from a table.

Four averages (of the line, the body, the close and the close again, slower) and the trend they give depend on their own last values. They, and what a bar needs from those before it, come from two passes over rows that are dealt and sorted once: the first adds averages and the bar before, the second shifts masks. Everything else is a row's own arithmetic. Every condition is computed from prices: gaps, positions and engulfing have their plain meanings, whatever other patterns are asked for.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scans import recur
from .indicators import Series, heads
from .patterns import PATTERNS

BULL, BEAR = ("BullishReversal", "BullishContinuation", "BullishReversalOrContinuation"), ("BearishReversal", "BearishContinuation", "BearishReversalOrContinuation")
FORECASTS = ("BearishReversal", "BearishContinuation", "BearishReversalOrContinuation", "BullishReversal", "BullishContinuation", "BullishReversalOrContinuation")
#: The trend before a pattern that its forecast supposes.
TREND = {"BearishReversal": 1, "BullishContinuation": 1, "BullishReversal": -1, "BearishContinuation": -1}

# Tolerances and proportions of the features.
LONG = 0.7 - 0.005
DOJI = 0.03
LONG_BODY = 3.0
LONG_WICK = 3.0

DOJIS = ("Doji", "LongLeggedDoji", "DragonflyDoji", "GravestoneDoji", "FourPriceDoji")
WHITES = ("WhiteMarubozu", "ClosingWhiteMarubozu", "OpeningWhiteMarubozu")
BLACKS = ("BlackMarubozu", "ClosingBlackMarubozu", "OpeningBlackMarubozu")
TYPES = {
    "W2+": ("WhiteCandle", "LongWhiteCandle", *WHITES),
    "W3+": ("ShortWhiteCandle", "WhiteCandle", "LongWhiteCandle", *WHITES),
    "B2+": ("BlackCandle", "LongBlackCandle", *BLACKS),
    "B3+": ("ShortBlackCandle", "BlackCandle", "LongBlackCandle", *BLACKS),
    "Doji4": tuple(d for d in DOJIS if d != "FourPriceDoji"),
    "Doji": DOJIS,
}


@dataclass(frozen=True)
class Pattern:
    """``bars``: the template of each bar, oldest first, as words; ``before``: a condition on the bar before; ``extra``: a further condition over o1, h1, l1, c1, ... and ema, ema_line."""

    name: str
    forecast: str
    bars: tuple[str, ...]
    before: str = ""
    extra: str = ""


def _table() -> list[Pattern]:
    return [Pattern(name, forecast, tuple(b.strip() for b in bars.split(";")), before, extra) for name, forecast, before, bars, extra in PATTERNS]


ALL = _table()


def first_row(candle_period: int, trend_period: int, trend_signal_period: int) -> int:
    """The 0-based number of the first bar that patterns are given for."""
    slow = trend_period + trend_signal_period
    return candle_period + 4 if candle_period > slow else slow + 5


def _averages(periods: tuple[int, int, int], by: int, ohlc: list[int], names: list[str]):
    """A pass that adds each bar's number in its series, line and body averages before the bar, the trend average with it, the trend (1, -1, 0 before any), and the prices of the bar before."""
    c, t, s = periods
    weights = [2.0 / (n + 1) for n in (c, c, t, t + s)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, n, last, trend, before = None, 0, [0.0] * 4, 0, [math.nan] * 4
        for b in batches:
            if not b.num_rows:
                continue
            o, h, l, x = (b.column(k).to_numpy(zero_copy_only=False) for k in ohlc)
            numbers, trends = np.empty(b.num_rows, np.int64), np.empty(b.num_rows, np.int32)
            shown, back = np.empty((4, b.num_rows)), np.empty((4, b.num_rows))
            starts = heads([b.column(k) for k in range(by)], b.num_rows)
            for a, z in zip(starts, [*starts[1:], b.num_rows]):
                key = tuple(b.column(k)[a].as_py() for k in range(by))
                own = (h[a:z] - l[a:z], np.abs(o[a:z] - x[a:z]), x[a:z], x[a:z])
                if key != current:
                    current, n, trend, before = key, 0, 0, [math.nan] * 4
                    last = [float(v[0]) for v in own]
                first = int(n == 0)
                y = []
                for k, (v, w) in enumerate(zip(own, weights)):
                    y.append(np.concatenate([[last[k]], recur(v[first:] * w, 1 - w, last[k], plain=True)]))
                    last[k] = float(y[-1][-1])
                # On a series' first bar the averages are its own values.
                for k in range(2):
                    shown[k, a:z] = np.concatenate([y[k][:1], y[k][:-1]]) if first else y[k][:-1]
                fast, slow = (v if first else v[1:] for v in y[2:])
                shown[2, a:z] = fast
                way = np.sign(fast - slow)
                at = np.maximum.accumulate(np.where(way != 0, np.arange(z - a), -1))
                trends[a:z] = np.where(at >= 0, way[np.maximum(at, 0)], trend)
                trend = int(trends[z - 1])
                numbers[a:z] = np.arange(n, n + z - a)
                for k, v in enumerate((o, h, l, x)):
                    back[k, a:z] = np.concatenate([[before[k]], v[a : z - 1]])
                before = [float(v[z - 1]) for v in (o, h, l, x)]
                n += z - a
            none = numbers == 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers), *(pa.array(v) for v in shown[:3]), pa.array(trends), *(pa.array(v, mask=none) for v in back)], names=names)

    return run


def _shifted(number: int, columns: dict[int, int], names: list[str]):
    """A pass that adds columns as they were 1, 2, ... bars before (``columns``: place -> how many); null where the series hasn't as many. ``number``: where a bar's number in its series is."""
    most = max(columns.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            n, out = b.column(number).to_numpy(), []
            for at, times in columns.items():
                x = b.column(at).to_numpy(zero_copy_only=False)
                whole = np.concatenate([held.get(at, np.zeros(most, x.dtype)), x])
                out += [pa.array(whole[most - k : len(whole) - k], mask=n < k) for k in range(1, times + 1)]
                held[at] = whole[-most:]
            yield pa.RecordBatch.from_arrays([*b.columns, *out], names=names)

    return run


def _features(own: Series, periods: tuple[int, int, int]) -> DataFrame:
    """The bars, dealt and sorted, with what patterns are made of, and the candle's type."""
    prices = own.df.withColumnsRenamed(dict(zip(own.inputs, ("_o", "_h", "_l", "_c"))))
    columns = [*own.by, *(c for c in prices.columns if c not in own.by)]
    dealt = (prices.repartition(*own.by) if own.by else prices.repartition(1)).sortWithinPartitions(*own.by, *own.order).select(*columns)
    more = {"_n": "long", "_ema_line": "double", "_ema_body": "double", "_ema": "double", "_trend": "int"} | dict.fromkeys(("_po", "_ph", "_pl", "_pc"), "double")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema] + [f"{k} {v}" for k, v in more.items()])
    d = dealt.mapInArrow(_averages(periods, len(own.by), [columns.index(k) for k in ("_o", "_h", "_l", "_c")], [*columns, *more]), schema)
    o, h, l, c = F.col("_o"), F.col("_h"), F.col("_l"), F.col("_c")
    d = d.withColumns({"_top": F.greatest(o, c), "_bot": F.least(o, c), "_ptop": F.greatest("_po", "_pc"), "_pbot": F.least("_po", "_pc"), "_body": F.abs(o - c), "_pbody": F.abs(F.col("_po") - F.col("_pc"))})
    top, bot, body = F.col("_top"), F.col("_bot"), F.col("_body")
    up, down = h - top, bot - l
    long_wick = lambda wick, times: (wick > 0) & (wick >= body * times)
    d = d.withColumns({
        "_green": F.coalesce(c >= F.col("_pc"), F.lit(True)), "_hollow": o < c,
        "_long_line": h - l >= LONG * F.col("_ema_line"), "_long_body": body >= LONG * F.col("_ema_body"),
        "_up_long": long_wick(up, 1.0), "_down_long": long_wick(down, 1.0), "_up_3": long_wick(up, LONG_WICK), "_down_3": long_wick(down, LONG_WICK),
        "_up_2": up >= 2 * body, "_down_2": down >= 2 * body,
    })
    place = F.when(h == l, None).when(top == h, 100.0).when(bot == l, 0.0).otherwise(((top + bot) / 2 - l) / (h - l) * 100)
    doji = F.when(F.col("_long_line"), F.when((place > 45) & (place < 55), "LongLeggedDoji").when(place == 100, "DragonflyDoji").when(place == 0, "GravestoneDoji").otherwise("Doji")).when((up == 0) & (down == 0), "FourPriceDoji").otherwise("Doji")
    short = ~F.col("_up_long") & ~F.col("_down_long")
    hollow = F.col("_hollow")
    basic = F.when(F.col("_long_line") & (body > LONG_BODY * F.col("_ema_body")), F.when(hollow, "LongWhiteCandle").otherwise("LongBlackCandle")).when(F.col("_long_line"), F.when(hollow, "WhiteCandle").otherwise("BlackCandle")).otherwise(F.when(hollow, "ShortWhiteCandle").otherwise("ShortBlackCandle"))
    marubozu = (
        F.when((up == 0) & (down == 0), F.when(hollow, "WhiteMarubozu").otherwise("BlackMarubozu"))
        .when((up == 0) & ~F.col("_down_long"), F.when(hollow, "ClosingWhiteMarubozu").otherwise("OpeningBlackMarubozu"))
        .when((down == 0) & ~F.col("_up_long"), F.when(hollow, "OpeningWhiteMarubozu").otherwise("ClosingBlackMarubozu"))
    )
    stretched = F.col("_long_line") & (F.col("_up_3") | F.col("_down_3"))
    spinning = F.when(~short & ~stretched, F.when(hollow, "WhiteSpinningTop").otherwise("BlackSpinningTop")).when(~short & stretched & ~F.col("_long_body"), "HighWave")
    return d.withColumn("_type", F.when(body <= DOJI * F.col("_ema_body"), doji).when((up > 0) & (down > 0) & short, basic).otherwise(F.coalesce(marubozu, spinning, F.lit("Other"))))


def _kinds(kinds: Sequence[str]) -> str:
    return "_type in (" + ", ".join(f"'{t}'" for t in kinds) + ")"


def _between(x: str, low: str, high: str) -> str:
    return f"({x} >= {low} and {x} <= {high})"


MIDDLE = "((_ptop + _pbot) / 2)"
#: What the words of a template say about a bar.
MEANING = {
    "G": "_green", "R": "not _green", "hollow": "_hollow", "filled": "not _hollow",
    "line=LONG": "_long_line", "line=SHORT": "not _long_line", "body=LONG": "_long_body", "body=SHORT": "not _long_body",
    "lower_wick_lt_body": "not _down_long", "upper_wick_lt_body": "not _up_long", "lower_wick_2x": "_down_2", "upper_wick_2x": "_up_2",
    "body_gap=UP": "_bot > _ptop", "body_gap=DOWN": "_top < _pbot", "wick_gap=UP": "_l > _ph", "wick_gap=DOWN": "_h < _pl",
    "open_above_prev_mid": f"_o > {MIDDLE}", "close_above_prev_mid": f"_c > {MIDDLE}", "open_in_prev_body": _between("_o", "_pbot", "_ptop"), "close_in_prev_body": _between("_c", "_pbot", "_ptop"),
    "high_in_prev_body": _between("_h", "_pbot", "_ptop"), "low_in_prev_body": _between("_l", "_pbot", "_ptop"), "high_in_prev_line": _between("_h", "_pl", "_ph"), "low_in_prev_line": _between("_l", "_pl", "_ph"),
    "high_above_prev_mid": f"_h > {MIDDLE}", "low_above_prev_mid": f"_l > {MIDDLE}",
    "engulf_prev=BODY": "_top >= _ptop and _bot <= _pbot and (_top > _ptop or _bot < _pbot)",
    "engulf_prev=LINE": "_top >= _ph and _bot <= _pl",
    "inside_prev=BODY": "_top <= _ptop and _bot >= _pbot and (_top < _ptop or _bot > _pbot)",
    "inside_prev=LINE": "_h <= _ph and _l >= _pl and (_h < _ph or _l > _pl)",
    "body_gt_prev_body": "_body > _pbody",
}


def _word(word: str) -> str:
    """A word of a template as a condition on the bar."""
    if word.startswith("!"):
        return "not " + _kinds(sorted({t for part in word[1:].split("|") for t in TYPES.get(part, (part,))}))
    if word.startswith("NOT_"):
        return f"not ({_word(word[4:])})"
    if word in MEANING:
        return MEANING[word]
    # 'Doji' by itself is the plain kind; '!Doji' is all of them.
    return _kinds([t for part in word.split("|") for t in ((part,) if part == "Doji" else TYPES.get(part, (part,)))])


def scan(df: DataFrame, candle_period: int = 5, trend_period: int = 1, trend_signal_period: int = 1, forecast: str | Sequence[str] | None = None, names: Sequence[str] | None = None, by: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",)) -> DataFrame:
    """The bars with ``patterns``: the names of all patterns that end on the bar, by number of bars, then forecast, then name; null while the averages warm up. ``forecast``: only those with these forecasts."""
    for k, v in (("candle_period", candle_period), ("trend_period", trend_period), ("trend_signal_period", trend_signal_period)):
        if v < 1:
            raise ValueError(f"{k} is {v}")
    wished = None if forecast is None else {forecast} if isinstance(forecast, str) else set(forecast)
    if wished and (unknown := wished - set(FORECASTS)):
        raise ValueError(f"no such forecast: {sorted(unknown)}")
    chosen = [p for p in ALL if (wished is None or p.forecast in wished) and (names is None or p.name in names)]
    chosen.sort(key=lambda p: (len(p.bars), FORECASTS.index(p.forecast), p.name))
    own = Series(df, ["open", "high", "low", "close"], list(by), list(order))
    d = _features(own, (candle_period, trend_period, trend_signal_period))
    # Each template once, as a bit of its bar's masks; patterns then look back at masks.
    bits: dict[str, int] = {}
    for p in chosen:
        for t in (*p.bars, *([p.before] if p.before else [])):
            bits.setdefault(t, len(bits))
    # Conditions are written as SQL: one text is parsed at once, where columns would be put together call by call.
    words = {x: f"_w{k}" for k, x in enumerate(sorted({x for t in bits for x in t.split()}))}
    d = d.withColumns({n: F.expr(f"coalesce({_word(x)}, false)") for x, n in words.items()})
    masks = []
    for at in range(0, len(bits), 60):
        parts = [f"if({' and '.join(words[x] for x in t.split())}, {1 << k - at}L, 0L)" for t, k in bits.items() if at <= k < at + 60]
        masks.append(F.expr(f"if(_type <> 'Other', {' | '.join(parts)}, 0L)").alias(f"_m{at // 60}"))
    kept = ["_n", "_type", "_ema", "_ema_line", "_ema_body", "_trend", "_o", "_h", "_l", "_c"]
    d = d.select(*own.names.values(), *kept, *masks)
    back = {f"_m{m}": 4 for m in range(len(masks))} | {"_trend": 4} | {f"_{x}": 3 for x in "ohlc"}
    places = {d.columns.index(c): n for c, n in back.items()}
    kinds = dict(d.dtypes)
    lags = {f"{c}_{k}": kinds[c] for c, n in back.items() for k in range(1, n + 1)}
    schema = ", ".join([f"`{c}` {k}" for c, k in d.dtypes] + [f"{c} {k}" for c, k in lags.items()])
    d = d.mapInArrow(_shifted(d.columns.index("_n"), places, [*d.columns, *lags]), schema)

    def bit(template: str, back: int) -> str:
        m, k = divmod(bits[template], 60)
        return f"(_m{m}{f'_{back}' if back else ''} & {1 << k}L) <> 0"

    def condition(p: Pattern) -> str:
        n = len(p.bars)
        parts = [f"_trend_{n} = {TREND[p.forecast]}"] if p.forecast in TREND else []
        parts += [bit(p.before, n)] if p.before else []
        parts += [bit(t, k) for k, t in enumerate(reversed(p.bars))]
        parts += [f"({extra_sql(p.extra, n)})"] if p.extra else []
        return " and ".join(parts)

    found = F.expr("array_compact(array(" + ", ".join(f"if({condition(p)}, '{p.name}', null)" for p in chosen) + "))") if chosen else F.array().cast("array<string>")
    start = first_row(candle_period, trend_period, trend_signal_period)
    return d.select(*own.restored(), F.when(F.col("_n") >= start, found).alias("patterns"))


def extra_sql(extra: str, n: int) -> str:
    """A condition over o1, h1, ... (bar 1 is the oldest of n) in terms of columns and their lags."""

    def column(m: re.Match) -> str:
        k = n - int(m[2])
        return f"_{m[1]}_{k}" if k else f"_{m[1]}"

    return re.sub(r"\bema_line\b", "_ema_line", re.sub(r"\bema_body\b", "_ema_body", re.sub(r"\bema\b", "_ema", re.sub(r"\b([ohlc])([1-4])\b", column, extra))))


def exploded(scanned: DataFrame, by: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",)) -> DataFrame:
    """(by..., order..., pattern, forecast, bars): a row for each pattern found."""
    kinds = F.create_map(*(x for p in ALL for x in (F.lit(p.name), F.struct(F.lit(p.forecast).alias("forecast"), F.lit(len(p.bars)).alias("bars")))))
    e = scanned.select(*(F.col(f"`{c}`").alias(f"u{k}") for k, c in enumerate([*by, *order])), F.explode("patterns").alias("pattern")).withColumn("kind", kinds[F.col("pattern")])
    return e.select(*(F.col(f"u{k}").alias(c) for k, c in enumerate([*by, *order])), "pattern", F.col("kind.forecast").alias("forecast"), F.col("kind.bars").alias("bars"))


def catalog() -> list[tuple[str, str, int]]:
    return [(p.name, p.forecast, len(p.bars)) for p in ALL]
