"""Indicators over streams of bars: state for each series, kept by Structured Streaming."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator, Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.steps import STEPS
from ..operators.indicators import inputs_of, wanted
from ..operators.registry import INFO


def mark(v: object) -> int | float | str:
    """A bar's order as a plain value that compares as the order does: nanoseconds for times, days for dates, numbers and texts as they are. Decimals keep their digits as text; ``later`` compares them as numbers."""
    if isinstance(v, datetime.datetime):
        return pd.Timestamp(v).value
    if isinstance(v, datetime.date):
        return v.toordinal()
    if isinstance(v, (Decimal, str)):
        return str(v)
    return v.item() if hasattr(v, "item") else v


def later(v: object, last: int | float | str) -> bool:
    return v > Decimal(last) if isinstance(v, Decimal) else mark(v) > last


def stream(bars: DataFrame, name: str, *options: float, by: str = "symbol", order: str = "ts", columns: dict[str, str] | None = None, optional: Sequence[str] | bool = ()) -> DataFrame:
    """(by, order, inputs..., outputs...) for every bar of a streaming DataFrame, in append mode.

    A series' state (the steps' JSON, and the last bar's order) lives in the state store. A micro-batch's bars are sorted in the order column's own type (times, dates, numbers or texts); a bar that isn't later than the last one seen is late, and dropped. Bars with null inputs are dropped.
    """
    info = INFO[name]
    o = info.check(options)
    inputs = inputs_of(info, columns)
    outputs, every = wanted(info, optional), [*info.outputs, *info.optional]
    at = [every.index(k) for k in outputs]
    run_step = STEPS[name]
    used = list(dict.fromkeys([by, order, *inputs]))
    own = bars.select(*used).dropna()
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in used] + [f"`{k}` double" for k in outputs])

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        text, last = state.get if state.exists else (json.dumps({"i": -1}), None)
        s = json.loads(text)
        new = pd.concat(list(parts)).sort_values(order, kind="stable").drop_duplicates(order)
        if last is not None:
            newest = json.loads(last)
            new = new[[later(v, newest) for v in new[order]]]
        rows = []
        for x in new[inputs].itertuples(index=False, name=None):
            s["i"] += 1
            r = run_step(s, o, *map(float, x))
            rows.append([r[k] for k in at])
        if len(new):
            last = json.dumps(mark(new[order].iloc[-1]))
        state.update((json.dumps(s), last))
        out = new[used].reset_index(drop=True)
        for k, c in enumerate(outputs):
            out[c] = pd.array([r[k] for r in rows], dtype="Float64")
        yield out

    return own.groupBy(by).applyInPandasWithState(update, schema, "state string, last string", "append", "NoTimeout")


def chunked(bars: DataFrame, name: str, *options: float, states: DataFrame | None = None, **more) -> tuple[DataFrame, DataFrame]:
    """(outputs, states) of one chunk, for foreachBatch and a state table. Read the outputs from where they were written before the states are taken from them."""
    from ..operators.indicators import resume

    out = resume(bars, name, *options, states=states, **more)
    by = more.get("by", "symbol")
    keys = [by] if isinstance(by, str) else list(by)
    return out.drop("state"), out.where(F.col("state").isNotNull()).select(*keys, "state")
