"""What each indicator is: names, inputs, options, outputs and where its outputs begin."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Info:
    """``first``: options to the 0-based number of the first bar that has the first output. ``recursive``: a value depends on its predecessor, so that no window frame can express it."""

    name: str
    full_name: str
    kind: str
    inputs: tuple[str, ...]
    options: tuple[str, ...]
    defaults: tuple[float, ...]
    outputs: tuple[str, ...]
    optional: tuple[str, ...]
    first: Callable[..., int]
    recursive: bool = False

    def check(self, options: tuple[float, ...]) -> tuple[float, ...]:
        """The options, or the defaults, as floats; ValueError if they can't be."""
        own = tuple(map(float, options)) if options else self.defaults
        if len(own) != len(self.options):
            raise ValueError(f"{self.name} takes {len(self.options)} options {self.options}, not {len(own)}")
        named = dict(zip(self.options, own))
        if not all(map(math.isfinite, own)):
            raise ValueError(f"{self.name}: options must be finite")
        for k, x in named.items():
            if "period" in k and x < 1 or "period" not in k and x <= 0:
                raise ValueError(f"{self.name}: {k} is {x}")
        order = [named[k] for k in ("short_period", "medium_period", "long_period") if k in named]
        strict = self.name != "ultosc"
        if any(a >= b if strict else a > b for a, b in zip(order, order[1:])):
            raise ValueError(f"{self.name}: periods must rise, not {order}")
        if self.name == "vidya" and named["alpha"] >= 1:
            raise ValueError("vidya: alpha must lie between 0 and 1")
        if self.name == "psar" and named["acceleration_factor"] > named["max_acceleration_factor"]:
            raise ValueError("psar: the step is above its maximum")
        return own

    def first_row(self, *options: float) -> int:
        return int(self.first(*self.check(options)))

    def min_data(self, *options: float) -> int:
        """Bars from which at least one output comes."""
        return self.first_row(*options) + 1

    def output_length(self, bars: int, *options: float) -> int:
        return max(0, bars - self.first_row(*options))

    def min_data_accuracy(self, decimals: int, *options: float) -> int:
        """Bars after which a recursive average no longer shows its seed to ``decimals`` places: the weight left to it is below half a unit there, for values of up to eight digits (volumes) or three."""
        own = self.check(options)
        if not self.recursive or not own:
            return self.min_data(*options)
        digits = 8 if "volume" in self.inputs else 3
        alpha = 2 / (max(x for k, x in zip(self.options, own) if "period" in k) + 1) if any("period" in k for k in self.options) else own[0]
        if alpha >= 1:
            return self.min_data(*options)
        return self.min_data(*options) + math.ceil(math.log(0.5 * 10.0 ** -(decimals + digits)) / math.log(1 - alpha))


REAL, HL, HLC, HLCV, CV, OHLC = ("real",), ("high", "low"), ("high", "low", "close"), ("high", "low", "close", "volume"), ("close", "volume"), ("open", "high", "low", "close")
P, SL = ("period",), ("short_period", "long_period")

# The catalogue.
_ROWS = (
    ("sma", "Simple Moving Average", "Trend", REAL, P, (14,), ("sma",), (), lambda p: p, False),
    ("ema", "Exponential Moving Average", "Trend", REAL, P, (14,), ("ema",), (), lambda p: p, True),
    ("wma", "Weighted Moving Average", "Trend", REAL, P, (14,), ("wma",), ("sma",), lambda p: p, False),
    ("dema", "Double Exponential Moving Average", "Trend", REAL, P, (14,), ("dema",), ("ema",), lambda p: 2 * p - 2, True),
    ("tema", "Triple Exponential Moving Average", "Trend", REAL, P, (14,), ("tema",), ("dema", "ema"), lambda p: 3 * p - 3, True),
    ("trima", "Triangular Moving Average", "Trend", REAL, P, (14,), ("trima",), (), lambda p: p - 1, False),
    ("hma", "Hull Moving Average", "Trend", REAL, P, (14,), ("hma",), (), lambda p: p + math.isqrt(int(p)), False),
    ("zlema", "Zero Lag Exponential Moving Average", "Trend", REAL, P, (14,), ("zlema",), (), lambda p: max((int(p) - 1) // 2, 1), True),
    ("kama", "Kaufman's Adaptive Moving Average", "Trend", REAL, P, (14,), ("kama",), (), lambda p: p, True),
    ("vidya", "Variable Index Dynamic Average", "Trend", REAL, (*SL, "alpha"), (5, 20, 0.2), ("vidya",), ("short_sma", "long_sma", "short_stddev", "long_stddev"), lambda s, n, a: n - 1, True),
    ("vwma", "Volume Weighted Moving Average", "Trend", CV, P, (14,), ("vwma",), (), lambda p: p, False),
    ("wilders", "Wilder's Smoothing", "Trend", REAL, P, (14,), ("wilders",), (), lambda p: p, True),
    ("rsi", "Relative Strength Index", "Momentum", REAL, P, (14,), ("rsi",), (), lambda p: p + 1, True),
    ("macd", "Moving Average Convergence Divergence", "Trend", REAL, (*SL, "signal_period"), (12, 26, 9), ("macd_line", "signal_line", "histogram"), ("short_ema", "long_ema"), lambda s, n, g: n - 1, True),
    ("stoch", "Stochastic Oscillator", "Momentum", HLC, ("k_period", "k_slow_period", "d_period"), (14, 3, 3), ("stoch_k", "stoch_d"), (), lambda k, s, d: k + s, False),
    ("stochrsi", "Stochastic RSI", "Momentum", REAL, P, (14,), ("stochrsi",), ("rsi",), lambda p: 2 * p, True),
    ("willr", "Williams %R", "Momentum", HLC, P, (14,), ("willr",), (), lambda p: p, False),
    ("cci", "Commodity Channel Index", "Momentum", HLC, P, (14,), ("cci",), ("sma", "md", "typprice"), lambda p: 2 * p - 2, False),
    ("cmo", "Chande Momentum Oscillator", "Momentum", REAL, P, (14,), ("cmo",), (), lambda p: p + 1, False),
    ("ultosc", "Ultimate Oscillator", "Momentum", HLC, ("short_period", "medium_period", "long_period"), (7, 14, 28), ("ultosc",), (), lambda s, m, n: n, False),
    ("ao", "Awesome Oscillator", "Momentum", HL, (), (), ("ao",), ("short_sma", "long_sma", "medprice"), lambda: 34, False),
    ("fisher", "Fisher Transform", "Momentum", HL, P, (14,), ("fisher", "fisher_signal"), (), lambda p: p - 1, True),
    ("fosc", "Forecast Oscillator", "Trend", REAL, P, (14,), ("fosc",), ("tsf", "linreg", "linregslope", "linregintercept"), lambda p: p + 1, False),
    ("msw", "Mesa Sine Wave", "Cycle", REAL, P, (14,), ("msw_sine", "msw_lead"), (), lambda p: p, False),
    ("trix", "Triple Exponential Oscillator (TRIX)", "Trend", REAL, P, (14,), ("trix",), ("tema", "dema", "ema"), lambda p: 3 * p - 2, True),
    ("ppo", "Percentage Price Oscillator", "Momentum", REAL, SL, (12, 26), ("ppo",), ("short_ema", "long_ema"), lambda s, n: n, True),
    ("apo", "Absolute Price Oscillator", "Momentum", ("close",), SL, (12, 26), ("apo",), ("short_ema", "long_ema"), lambda s, n: n - 1, True),
    ("adx", "Average Directional Index", "Trend", HLC, P, (14,), ("adx",), ("dx", "atr", "tr"), lambda p: 2 * p - 1, True),
    ("adxr", "Average Directional Movement Rating", "Trend", HLC, P, (14,), ("adxr",), ("adx", "dx", "atr", "tr"), lambda p: 3 * p - 3, True),
    ("dm", "Directional Movement", "Trend", HL, P, (14,), ("plus_dm", "minus_dm"), (), lambda p: p, True),
    ("di", "Directional Indicator", "Trend", HLC, P, (14,), ("plus_di", "minus_di"), ("atr", "tr"), lambda p: p, True),
    ("dx", "Directional Movement Index", "Trend", HLC, P, (14,), ("dx",), ("atr", "tr"), lambda p: p, True),
    ("aroon", "Aroon", "Trend", HL, P, (14,), ("aroon_down", "aroon_up"), (), lambda p: p, False),
    ("aroonosc", "Aroon Oscillator", "Trend", HL, P, (14,), ("aroonosc",), ("aroon_down", "aroon_up"), lambda p: p, False),
    ("psar", "Parabolic SAR", "Trend", HL, ("acceleration_factor", "max_acceleration_factor"), (0.02, 0.2), ("psar",), (), lambda a, m: 1, True),
    ("bbands", "Bollinger Bands", "Volatility", REAL, ("period", "std_dev"), (20, 2), ("bbands_lower", "bbands_middle", "bbands_upper"), (), lambda p, k: p, False),
    ("atr", "Average True Range", "Volatility", HLC, P, (14,), ("atr",), ("tr",), lambda p: p, True),
    ("natr", "Normalized Average True Range", "Volatility", HLC, P, (14,), ("natr",), ("atr", "tr"), lambda p: p, True),
    ("tr", "True Range", "Volatility", HLC, (), (), ("tr",), (), lambda: 1, False),
    ("stddev", "Standard Deviation", "Volatility", REAL, P, (14,), ("stddev",), ("sma",), lambda p: p, False),
    ("volatility", "Volatility Indicator", "Volatility", REAL, P, (14,), ("volatility",), (), lambda p: p + 1, False),
    ("vhf", "Vertical Horizontal Filter", "Trend", REAL, P, (14,), ("vhf",), (), lambda p: p, False),
    ("cvi", "Chaikin Volatility Indicator", "Volatility", HL, P, (14,), ("cvi",), (), lambda p: 2 * p - 1, True),
    ("ad", "Accumulation/Distribution Line", "Volume", HLCV, (), (), ("ad",), (), lambda: 0, False),
    ("adosc", "Accumulation/Distribution Oscillator", "Volume", HLCV, SL, (3, 10), ("adosc",), ("short_ema", "long_ema", "ad"), lambda s, n: n - 1, True),
    ("obv", "On-Balance Volume", "Volume", CV, (), (), ("obv",), (), lambda: 1, False),
    ("mfi", "Money Flow Index", "Volume", HLCV, P, (14,), ("mfi",), ("typprice",), lambda p: p, False),
    ("nvi", "Negative Volume Index", "Volume", CV, (), (), ("nvi",), (), lambda: 1, True),
    ("pvi", "Positive Volume Index", "Volume", CV, (), (), ("pvi",), (), lambda: 1, True),
    ("vosc", "Volume Oscillator", "Volume", ("volume",), SL, (5, 10), ("vosc",), ("short_sma", "long_sma"), lambda s, n: n, False),
    ("kvo", "Klinger Volume Oscillator", "Volume", HLCV, SL, (34, 55), ("kvo",), ("short_ema", "long_ema"), lambda s, n: n, True),
    ("emv", "Ease of Movement", "Volume", ("high", "low", "volume"), (), (), ("emv",), ("medprice",), lambda: 1, False),
    ("wad", "Williams Accumulation/Distribution", "Trend", HLC, (), (), ("wad",), (), lambda: 1, False),
    ("marketfi", "Market Facilitation Index", "Volume", ("high", "low", "volume"), (), (), ("marketfi",), (), lambda: 0, False),
    ("avgprice", "Average Price", "Price", OHLC, (), (), ("avgprice",), (), lambda: 0, False),
    ("medprice", "Median Price", "Price", HL, (), (), ("medprice",), (), lambda: 0, False),
    ("typprice", "Typical Price", "Price", HLC, (), (), ("typprice",), (), lambda: 0, False),
    ("wcprice", "Weighted Close Price", "Price", HLC, (), (), ("wcprice",), (), lambda: 0, False),
    ("max", "maximum", "Price", REAL, P, (14,), ("max",), (), lambda p: p - 1, False),
    ("min", "minimum", "Price", REAL, P, (14,), ("min",), (), lambda p: p - 1, False),
    ("mom", "Momentum", "Momentum", REAL, P, (14,), ("mom",), (), lambda p: p, False),
    ("roc", "Rate of Change", "Momentum", REAL, P, (14,), ("roc",), ("mom",), lambda p: p, False),
    ("rocr", "Rate of Change Ratio", "Momentum", REAL, P, (14,), ("rocr",), (), lambda p: p, False),
    ("bop", "Balance of Power", "Momentum", OHLC, (), (), ("bop",), (), lambda: 0, False),
    ("linreg", "Linear Regression", "Trend", REAL, P, (14,), ("linreg",), ("linregslope", "linregintercept"), lambda p: p, False),
    ("tsf", "Time Series Forecast", "Trend", REAL, P, (14,), ("tsf",), ("linreg", "linregslope", "linregintercept"), lambda p: p, False),
    ("dpo", "Detrended Price Oscillator", "Cycle", REAL, P, (14,), ("dpo",), ("sma",), lambda p: p, False),
    ("mass", "Mass Index", "Trend", HL, P, (25,), ("mass",), (), lambda p: p + 15, True),
    ("md", "Mean Deviation", "Volatility", REAL, P, (14,), ("md",), ("sma",), lambda p: p, False),
    ("qstick", "QStick", "Momentum", ("open", "close"), P, (14,), ("qstick",), (), lambda p: p, False),
)

INFO: dict[str, Info] = {r[0]: Info(r[0], r[1], r[2], r[3], r[4], tuple(map(float, r[5])), r[6], r[7], r[8], r[9]) for r in _ROWS}


def catalog(spark: SparkSession) -> DataFrame:
    """The catalogue as a table, with first rows under default options."""
    rows = [(i.name, i.full_name, i.kind, list(i.inputs), list(i.options), list(i.defaults), list(i.outputs), list(i.optional), i.first_row(), i.recursive) for i in INFO.values()]
    return spark.createDataFrame(rows, "name string, full_name string, kind string, inputs array<string>, options array<string>, defaults array<double>, outputs array<string>, optional_outputs array<string>, first_row int, recursive boolean")
